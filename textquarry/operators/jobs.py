"""States of index jobs from their events: checked transitions, and progress that never falls.

A job is queued, runs through its stages in order (some may be left out), and succeeds or fails; nothing follows that.  An
event that would go back, or comes before the job is queued or after its end, is reported and changes nothing.  As such
an event never ranks above what was reached, the greatest rank before an event is the state that it meets: windows do,
no job's events are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in order, and where each one's progress begins and ends.
BANDS = [("queued", 0.0, 0.0), ("cloning", 0.0, 0.15), ("parsing", 0.15, 0.5), ("linking", 0.5, 0.55), ("embedding", 0.55, 0.9), ("summarizing", 0.9, 0.98)]
STAGES = [b[0] for b in BANDS]
ENDS = {"succeeded": "ready", "failed": "failed"}
LAST = len(BANDS)


def rank(event: Column) -> Column:
    """The place of a stage; both ends are last; null for what is no event."""
    found = F.array_position(F.array(*map(F.lit, STAGES)), event)
    return F.when(event.isin(*ENDS), LAST).when(found > 0, found - 1).cast("int")


def share(event: Column, done: Column, total: Column) -> Column:
    """Progress by the band of a stage and how much of it is done."""
    part = F.least(F.greatest(F.coalesce(done / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    bands = F.when(event == "succeeded", 1.0)
    for name, low, high in BANDS:
        bands = bands.when(event == name, low + (high - low) * part)
    return bands


def job_steps(events: DataFrame) -> DataFrame:
    """``job_id, at, seq, event, legal, state, stage, progress``: each event and what the job is after it, for
    ``events(job_id, at, seq, event, done, total)``; ``seq`` orders events of one time."""
    along = Window.partitionBy("job_id").orderBy("at", "seq")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("rank", rank(F.col("event")))
    queued = F.max(F.when(F.col("rank") == 0, 1)).over(before)
    rows = rows.withColumn("queued", F.coalesce(queued, F.lit(0)))
    counts = F.when((F.col("queued") == 1) | (F.col("rank") == 0), F.col("rank"))
    rows = rows.withColumn("counts", counts).withColumn("reached", F.max("counts").over(before))
    first = F.col("reached").isNull()
    legal = F.when(first, F.col("rank") == 0).otherwise((F.col("reached") < LAST) & (F.col("rank") > 0) & (F.col("rank") >= F.col("reached")))
    rows = rows.withColumn("legal", F.coalesce(legal, F.lit(False)))
    own = lambda c: F.when(F.col("legal"), c)
    event = F.last(own(F.col("event")), ignorenulls=True).over(upto)
    progress = F.max(own(share(F.col("event"), F.col("done"), F.col("total")))).over(upto)
    rows = rows.withColumn("now", event).withColumn("progress", F.coalesce(progress, F.lit(0.0)))
    state = F.when(F.col("now").isin("queued", *ENDS), F.col("now")).when(F.col("now").isNotNull(), "running")
    stage = F.when(F.col("now") == "queued", None).when(F.col("now") == "succeeded", "ready").otherwise(F.col("now"))
    return rows.select("job_id", "at", "seq", "event", "legal", state.alias("state"), stage.alias("stage"), "progress")


def job_states(events: DataFrame) -> DataFrame:
    """``job_id, state, stage, progress, updated_at, n_events, n_illegal``: every job as it is now."""
    last = F.max(F.struct("at", "seq", "state", "stage", "progress")).alias("last")
    rows = job_steps(events).groupBy("job_id").agg(last, F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("legal")).alias("n_illegal"), F.max(F.when(F.col("legal"), F.col("at"))).alias("updated_at"))
    return rows.select("job_id", "last.state", "last.stage", "last.progress", "updated_at", "n_events", "n_illegal")
