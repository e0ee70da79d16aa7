"""An index kept current by a stream of files: what changed, what went, and versions that a replayed batch does not repeat.

A stream of files lists what arrives; it cannot tell what was removed.  So each batch is compared, by path and content hash,
with the files of the last version: ``changes`` of a stream say of a path that it is there, with a text, or gone.  A batch's
number is stored with the version that it made, in one write; a batch that is run again after a failure finds its number
and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index

FILES = ["path", "text", "content_hash", "loc"]


def latest(changes: DataFrame) -> DataFrame:
    """The last of ``changes(path, text, gone, at)`` of each path; of one time a removal comes last."""
    last = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("gone"), F.desc("text"))
    return changes.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def applied(files: DataFrame | None, changes: DataFrame) -> DataFrame:
    """``files`` after ``changes``: paths that are gone are gone, changed texts replace those before."""
    last = latest(changes)
    lines = F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + (~F.endswith("text", F.lit("\n"))).cast("int"))
    fresh = last.where("NOT gone").select("path", "text", F.sha2("text", 256).alias("content_hash"), lines.cast("long").alias("loc"))
    if files is None:
        return fresh
    return files.select(FILES).join(last.select("path"), "path", "left_anti").unionByName(fresh)


def _opened(df: DataFrame, folder: str) -> Index | None:
    try:
        return Index.opened(df.sparkSession, folder)
    except ValueError:
        return None


def done(df: DataFrame, folder: str, batch: int) -> bool:
    """Whether a version of this batch, or of a later one, is there."""
    try:
        return not df.sparkSession.read.parquet(f"{folder.rstrip('/')}/versions").where(F.col("batch") >= batch).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def refresh(changes: DataFrame, batch: int, folder: str, before_commit: Callable[[], None] | None = None) -> None:
    """One batch: a new version of the index in ``folder``, unless this batch made one already."""
    if done(changes, folder, batch):
        return
    index = _opened(changes, folder)
    files = applied(None if index is None else index.files, changes)
    made = Index.build(files) if index is None else index.refreshed(files)
    made.saved(folder, batch, before_commit)


def keep_current(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run ``refresh`` on each micro-batch of ``changes(path, text, gone, at)``."""
    return stream.writeStream.foreachBatch(lambda df, n: refresh(df, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
