"""Event-time windows and the anchored rate limit, over tables; ``keyed`` and ``reindex`` have what streams need besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

WINDOW, LIMIT = 60, 30


def counted(events: DataFrame, window: Column, *keys: str, late: str | None = None, at: str = "ts") -> DataFrame:
    """Counts and sums by a time window; ``late`` is the watermark of a stream."""
    rows = events.withWatermark(at, late) if late else events
    done = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return done.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def tumbling(events: DataFrame, size: str = "1 hour", **how) -> DataFrame:
    return counted(events, F.window("ts", size), "event_type", **how)


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", **how) -> DataFrame:
    return counted(events, F.window("ts", size, step), "event_type", **how)


def sessions(events: DataFrame, gap: str = "30 minutes", **how) -> DataFrame:
    return counted(events, F.session_window("ts", gap), "user_id", **how)


def _window_starts(times: DataFrame, window: int) -> DataFrame:
    """``u, b, start`` of the windows over ``times(u, b, t)``, distinct and with ``b`` the minute (or whatever
    ``window`` is) that ``t`` lies in.

    An event ``window`` or more after the one before it opens a window whatever came earlier.  Every other event may
    be one that opens the next window after some event: each has a pointer to the first event ``window`` or more after
    it, which lies in one of the next two minutes unless it opens one anyway.  From the windows known, pointers are
    followed, and pointers that double in length reach all windows of a run in as many rounds as its number of
    windows has bits.  No step holds more than a minute of a user in one task.
    """
    ends = written(times.groupBy("u", "b").agg(F.min("t").alias("low"), F.max("t").alias("high")), "minutes")
    minute = Window.partitionBy("u", "b").orderBy("t")
    last = ends.select("u", (F.col("b") + 1).alias("b"), F.col("high").alias("last"))
    before = F.coalesce(F.lag("t").over(minute), F.col("last"))
    marked = times.join(last, ["u", "b"], "left").select("u", "b", "t", F.coalesce(F.col("t") - before >= window, F.lit(True)).alias("opens"))
    marked = written(marked, "opens")
    # Every event asks for the first one from a window later on, within the minute of that time.
    asked = times.select("u", (F.col("b") + 1).alias("b"), (F.col("t") + window).alias("t"), F.lit(True).alias("asks"))
    given = times.select("u", "b", "t", F.lit(False).alias("asks"))
    following = F.min(F.when(~F.col("asks"), F.col("t"))).over(Window.partitionBy("u", "b").orderBy(F.desc("t")))
    found = asked.unionByName(given).select("u", "b", "t", "asks", following.alias("to")).where("asks")
    after = ends.select("u", (F.col("b") - 1).alias("b"), F.col("low").alias("low"))
    found = found.join(after, ["u", "b"], "left").select("u", (F.col("t") - window).alias("t"), F.coalesce("to", "low").alias("to"))
    rest = marked.where("NOT opens").select("u", F.col("t").alias("to"))
    jumps = written(found.where("to IS NOT NULL").join(rest, ["u", "to"]).select("u", "t", "to"), "jumps")
    starts = written(marked.where("opens").select("u", "t"), "starts")
    while not jumps.isEmpty():
        reached = starts.join(jumps, ["u", "t"]).select("u", F.col("to").alias("t"))
        starts = written(starts.unionByName(reached).distinct(), "starts")
        onward = jumps.select("u", F.col("t").alias("to"), F.col("to").alias("end"))
        jumps = written(jumps.join(onward, ["u", "to"]).select("u", "t", F.col("end").alias("to")), "jumps")
    return starts.select("u", _minute(F.col("t"), window).alias("b"), F.col("t").alias("start"))


def _minute(t: Column, window: int) -> Column:
    return ((t - F.pmod(t, F.lit(window))) / window).cast("long")


def rate_limited(events: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """``event_id, user_id, place, allowed``: windows start at a key's first event that is not in one.

    ``place`` counts within the window.  Limits of 0 or less allow all.  A minute has one window's start at most, so
    an event's window is that of its minute, if it starts by then, or that of the minute before.
    """
    size = window * 1_000_000
    # A struct, so that rows without a key are one key.
    rows = events.select("event_id", F.struct("user_id").alias("u"), F.unix_micros("ts").alias("t")).withColumn("b", _minute(F.col("t"), size))
    rows = written(rows, "events")
    timed = rows.where("t IS NOT NULL")
    starts = written(_window_starts(timed.select("u", "b", "t").distinct(), size), "windows")
    own = starts.withColumnRenamed("start", "own")
    earlier = starts.select("u", (F.col("b") + 1).alias("b"), F.col("start").alias("earlier"))
    timed = timed.join(own, ["u", "b"], "left").join(earlier, ["u", "b"], "left")
    start = F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("earlier"))
    place = F.row_number().over(Window.partitionBy("u", "start").orderBy("t", "event_id"))
    placed = timed.withColumn("start", start).select("event_id", "u.user_id", place.cast("long").alias("place"))
    # An event without a time is in no other's window.
    placed = placed.unionByName(rows.where("t IS NULL").select("event_id", "u.user_id", F.lit(1).cast("long").alias("place")))
    return placed.select("event_id", "user_id", "place", (F.lit(True) if limit <= 0 else F.col("place") <= limit).alias("allowed"))
