"""Streams give what tables give, leave no state behind, and may run a batch again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textquarry.operators import incremental, jobs
from textquarry.operators.index import Index
from textquarry.streaming import events as tables
from textquarry.streaming import keyed, reindex

START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, source, make, folder, name, batches):
    """Rows of ``make`` over a stream of ``batches``, and the rows of its state at the end."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(source.schema).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    left = q.lastProgress
    return spark.read.parquet(f"{folder}/out"), left


def dealt(rows, n, rng, late):
    """Batches of rows that come up to ``late`` seconds out of order."""
    order = sorted(rows, key=lambda r: (r[-1] + timedelta(seconds=rng.random() * late)))
    size = -(-len(order) // n)
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_rate_limit_of_late_events(spark, tmp_path, store):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 2, 3, None]), START + timedelta(seconds=rng.randrange(1800))) for i in range(400)]
    rows += [(1000 + i, 4, START + timedelta(seconds=700)) for i in range(5)]
    schema = "event_id long, user_id long, ts timestamp"
    table = spark.createDataFrame(rows, schema)
    # Long after all others, so that the watermark passes them; the second ends the state of the first.
    ends = [[(9001, 99, START + timedelta(days=1))], [(9002, 98, START + timedelta(days=2))]]
    batches = [spark.createDataFrame(b, schema) for b in [*dealt(rows, 3, rng, 50), *ends]]
    got, progress = run(spark, table, lambda s: keyed.rate_limited_stream(s, 4, 120), str(tmp_path), "limited", batches)
    want = tables.rate_limited(table, 4, 120)
    assert sorted(map(repr, got.where("event_id < 9000").collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert any(not r.allowed for r in want.collect())
    assert progress.stateOperators[0].numRowsTotal <= 12  # what the last two keys hold


def test_sessions_are_remembered_and_forgotten(spark, tmp_path, store):
    rng = random.Random(2)
    rows = []
    for session in (1, 2, None):
        at = START
        for turn in range(12):
            at += timedelta(seconds=rng.choice([5, 40, 4000]))
            rows.append((session, turn, rng.choice(["what about it?", "where is main defined"]), f"answer {turn}", at))
    schema = "session long, turn long, question string, answer string, ts timestamp"
    table = spark.createDataFrame(rows, schema)
    ends = [[(9, 0, "q", "a", START + timedelta(days=30))]]
    batches = [spark.createDataFrame(b, schema) for b in [*dealt(rows, 2, rng, 30), *ends]]
    got, progress = run(spark, table, lambda s: keyed.remembered_stream(s, 3, 3600), str(tmp_path), "memory", batches)
    want = keyed.remembered(table, 3, 3600)
    assert sorted(map(repr, got.where("session IS NULL OR session < 9").select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert any(r.turns for r in want.collect()) and progress.stateOperators[0].numRowsTotal <= 8


def folded(rows):
    """The state machine in plain Python: ``(job, seq, event, legal, state, stage, progress)``."""
    out, now = [], {}
    for job, at, seq, event, done, total in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        reached, progress = now.get(job, (None, 0.0))
        order = [*jobs.STAGES, *jobs.ENDS]
        place = min(order.index(event), jobs.LAST) if event in order else None
        legal = place is not None and (place == 0 if reached is None else order.index(reached) < jobs.LAST and place > 0 and place >= order.index(reached))
        if legal:
            low, high = {b[0]: b[1:] for b in jobs.BANDS}.get(event, (1.0, 1.0) if event == "succeeded" else (0.0, 0.0))
            reached, progress = event, max(progress, low + (high - low) * min(max(done / total if total else 0.0, 0.0), 1.0))
        now[job] = reached, progress
        state = reached if reached in (None, "queued", *jobs.ENDS) else "running"
        stage = None if reached in (None, "queued") else "ready" if reached == "succeeded" else reached
        out.append((job, seq, event, legal, state, stage, round(progress, 9)))
    return sorted(out)


def test_job_states_over_tables_and_streams(spark, tmp_path, store):
    rng = random.Random(5)
    rows, seq = [], 0
    for job in range(12):
        at = START
        for event in rng.sample([*jobs.STAGES, *jobs.ENDS, "nonsense"], 7) if job % 2 else ["queued", "cloning", "parsing", "parsing", "embedding", "parsing", "succeeded", "failed"]:
            at += timedelta(seconds=rng.randrange(30))
            seq += 1
            rows.append((job, at, seq, event, rng.randrange(12), rng.choice([0, 10])))
    schema = "job_id long, at timestamp, seq long, event string, done long, total long"
    table = spark.createDataFrame(rows, schema)
    want = folded(rows)
    shown = lambda df: sorted((r.job_id, r.seq, r.event, r.legal, r.state, r.stage, round(r.progress, 9)) for r in df.collect())
    assert shown(jobs.job_steps(table)) == want and any(not w[3] for w in want)
    steps = {}
    for r in jobs.job_steps(table).orderBy("job_id", "at", "seq").collect():
        assert r.progress >= steps.get(r.job_id, 0.0)
        steps[r.job_id] = r.progress
    states = {r.job_id: r for r in jobs.job_states(table).collect()}
    assert (states[0].state, states[0].stage, states[0].progress, states[0].n_illegal) == ("succeeded", "ready", 1.0, 2)
    ends = [[(99, START + timedelta(days=9), 9999, "queued", 0, 0)]]
    batches = [spark.createDataFrame(b, schema) for b in [rows[::2], rows[1::2], *ends]]
    got, progress = run(spark, table, lambda s: keyed.job_steps_stream(s, late="1 day"), str(tmp_path), "jobs", batches)
    assert shown(got.where("job_id < 99")) == want and progress.stateOperators[0].numRowsTotal <= 6


CHANGES = "path string, text string, gone boolean, at long"
FIRST = [("a.py", "def one():\n    return 1\n", False, 1), ("b.md", "# Zebra\nStripes.\n", False, 1), ("c.txt", "plain words\n", False, 1)]
SECOND = [("a.py", "def two():\n    return 2\n", False, 2), ("c.txt", None, True, 2), ("d.txt", "fresh words", False, 3), ("d.txt", "older words", False, 2)]


def files_of(index):
    return sorted((r.path, r.text, r.loc) for r in index.files.collect())


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A batch that fails before its version is named is run again, and one that ended is not."""
    folder = f"file://{tmp_path}/index"
    one, two = (spark.createDataFrame(c, CHANGES) for c in (FIRST, SECOND))
    reindex.refresh(one, 0, folder)
    versions = lambda: spark.read.parquet(f"{folder}/versions").count()

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        reindex.refresh(two, 1, folder, fails)
    assert versions() == 1 and len(files_of(Index.opened(spark, folder))) == 3
    reindex.refresh(two, 1, folder)
    reindex.refresh(two, 1, folder)
    reindex.refresh(one, 0, folder)
    assert versions() == 2
    index = Index.opened(spark, folder)
    assert files_of(index) == [("a.py", SECOND[0][1], 2), ("b.md", FIRST[1][1], 2), ("d.txt", "fresh words", 1)]
    # As a whole tree that is read anew tells it.
    anew = Index.build(index.files)
    key = lambda i: sorted((r.chunk_id, r.path, r.content) for r in i.chunks.collect())
    assert key(index) == key(anew)
    assert incremental.diff(anew.files, index.files).where("status <> 'unchanged'").isEmpty()


def test_an_index_follows_a_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    for changes in (FIRST, SECOND):
        spark.createDataFrame(changes, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in")
        reindex.keep_current(source, folder, f"{tmp_path}/c").awaitTermination(300)
    assert [f[0] for f in files_of(Index.opened(spark, folder))] == ["a.py", "b.md", "d.txt"]
    assert spark.read.parquet(f"{folder}/versions").where(F.col("batch").isNotNull()).count() == 2
