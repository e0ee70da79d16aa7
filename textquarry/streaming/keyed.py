"""State by key with timers and expiry: the anchored rate limit and a session's memory over streams.

Events wait in their key's state until the watermark has passed them, and are then taken in the order of event time, so
late ones within the watermark fall where they belong and the stream gives what the table gives.  A timer a key wakes it
for its next waiting event, or, when none waits, for the end of its state: idle keys leave nothing behind.

Streams of these need the state store that keeps single values of a key, ``use_store``.

Defined cases: rows without a key are one key; an event that comes after the watermark has passed its time is dropped by
Spark; events of one time go by ``event_id`` (or ``turn``); repeated rows count each; events without a time are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import is_follow_up
from ..operators import jobs
from .events import LIMIT, WINDOW

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Rows ``(..., t, ord)`` of a key in the order of ``t`` (microseconds), then ``ord``, once the watermark has passed them.

    ``kept`` is the schema of a key's state, ``row`` that of what waits; ``taken`` gives the new state and the output of a
    row, ``until`` the time at which a state that is not touched ends.
    """

    kept = row = ""

    def taken(self, key: tuple, state: tuple | None, row: Row) -> tuple[tuple, Row]:
        raise NotImplementedError

    def until(self, state: tuple) -> int:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kept)
        self.waiting = handle.getMapState("waiting", "t long, ord long", f"n long, {self.row}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        for r in rows:
            at = (r["t"], r["ord"])
            n = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
            self.waiting.updateValue(at, (n + 1, *[r[c.split()[0]] for c in self.row.split(", ")]))
        yield from self._due(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._due(key, timerValues)

    def _due(self, key: tuple, times) -> Iterator[Row]:
        passed = times.getCurrentWatermarkInMs()
        state = tuple(self.state.get()) if self.state.exists() else None
        left = None
        for at in sorted(tuple(k) for k in self.waiting.keys()):
            if at[0] >= passed * 1000:
                left = at[0]
                break
            n, *values = self.waiting.getValue(at)
            row = Row(**dict(zip([c.split()[0] for c in self.row.split(", ")], values)), t=at[0], ord=at[1])
            for _ in range(n):
                state, out = self.taken(key, state, row)
                yield out
            self.waiting.removeKey(at)
        if state is not None and left is None and self.until(state) <= passed * 1000:
            state = None
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = left if left is not None else None if state is None else self.until(state)
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), passed) + 1)

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    kept, row = "since long, n long", "event_id long"

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window * 1_000_000

    def taken(self, key, state, row):
        since, n = state if state is not None and row.t - state[0] < self.window else (row.t, 0)
        return (since, n + 1), Row(event_id=row.event_id, user_id=key[0], place=n + 1, allowed=self.limit <= 0 or n + 1 <= self.limit)

    def until(self, state):
        return state[0] + self.window


class Memory(InOrder):
    kept, row = "at long, turns array<long>, questions array<string>, answers array<string>", "question string, answer string"

    def __init__(self, n: int, idle: int) -> None:
        self.n, self.idle = n, idle * 1_000_000

    def taken(self, key, state, row):
        if state is not None and row.t - state[0] >= self.idle:
            state = None
        held = [list(x) for x in state[1:]] if state is not None else [[], [], []]
        out = Row(session=key[0], turn=row.ord, question=row.question, turns=held[0], questions=held[1], answers=held[2])
        new = [(x + [v])[-self.n :] for x, v in zip(held, (row.ord, row.question, row.answer))]
        return (row.t, *new), out

    def until(self, state):
        return state[0] + self.idle


def _timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    return rows.where(F.col(at).isNotNull()).withWatermark(at, late).withColumn("t", F.unix_micros(at))


def rate_limited_stream(events: DataFrame, limit: int = LIMIT, window: int = WINDOW, late: str = "1 minute") -> DataFrame:
    """``events.rate_limited`` over a stream of ``(event_id, user_id, ts)`` whose events are up to ``late`` behind."""
    rows = _timed(events, "ts", late).withColumn("ord", F.col("event_id"))
    schema = "event_id long, user_id long, place long, allowed boolean"
    return rows.groupBy("user_id").transformWithState(RateLimit(limit, window), schema, "Append", "EventTime")


def remembered_stream(turns: DataFrame, n: int = 3, idle: int = 3600, late: str = "1 minute") -> DataFrame:
    """``session, turn, question, follow_up, turns, questions, answers``: each turn of a stream ``(session, turn, question, answer, ts)``
    with the last ``n`` before it; a session that is idle for so many seconds is forgotten."""
    rows = _timed(turns, "ts", late).withColumn("ord", F.col("turn"))
    schema = "session long, turn long, question string, turns array<long>, questions array<string>, answers array<string>"
    found = rows.groupBy("session").transformWithState(Memory(n, idle), schema, "Append", "EventTime")
    return found.withColumn("follow_up", is_follow_up(F.col("question")))


def remembered(turns: DataFrame, n: int = 3, idle: int = 3600) -> DataFrame:
    """The same over a table."""
    from pyspark.sql import Window

    along = Window.partitionBy("session").orderBy("ts", "turn")
    apart = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(along) >= idle * 1_000_000
    rows = turns.where("ts IS NOT NULL").withColumn("opens", F.coalesce(apart, F.lit(False)).cast("int"))
    rows = rows.withColumn("part", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy("session", "part").orderBy("ts", "turn").rowsBetween(-n, -1)
    held = F.collect_list(F.struct("turn", "question", "answer")).over(before)
    rows = rows.withColumn("held", held)
    return rows.select("session", "turn", "question", F.col("held.turn").alias("turns"), F.col("held.question").alias("questions"), F.col("held.answer").alias("answers"), is_follow_up(F.col("question")).alias("follow_up"))


class JobStates(InOrder):
    """``jobs.job_steps`` of one job, event by event; a job's state ends with it, or when nothing comes for ``idle`` seconds."""

    kept, row = "at long, rank long, progress double, now string", "event string, rank long, share double"

    def __init__(self, idle: int) -> None:
        self.idle = idle * 1_000_000

    def taken(self, key, state, row):
        reached, progress, now = state[1:] if state is not None else (None, 0.0, None)
        legal = row.rank is not None and (row.rank == 0 if reached is None else reached < jobs.LAST and row.rank > 0 and row.rank >= reached)
        if legal:
            reached, now = row.rank, row.event
            progress = max(progress, row.share) if row.share is not None else progress
        status = now if now is None or now == "queued" or now in jobs.ENDS else "running"
        stage = None if now in (None, "queued") else "ready" if now == "succeeded" else now
        return (row.t, reached, progress, now), Row(job_id=key[0], seq=row.ord, event=row.event, legal=legal, state=status, stage=stage, progress=progress)

    def until(self, state):
        return state[0] + self.idle


def job_steps_stream(events: DataFrame, idle: int = 86_400, late: str = "1 minute") -> DataFrame:
    """The same over a stream of ``(job_id, at, seq, event, done, total)``."""
    told = jobs.share(F.col("event"), F.col("done"), F.col("total"))
    rows = _timed(events, "at", late).withColumn("ord", F.col("seq"))
    rows = rows.withColumns({"rank": jobs.rank(F.col("event")).cast("long"), "share": told})
    schema = "job_id long, seq long, event string, legal boolean, state string, stage string, progress double"
    return rows.groupBy("job_id").transformWithState(JobStates(idle), schema, "Append", "EventTime")
