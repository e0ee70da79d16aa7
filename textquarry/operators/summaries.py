"""Summaries from files up: each directory from its children's, the deepest first, cached by content.

The summarizer is a column expression over what it may read; the default is extractive, the first sentence.  A
directory's is that of its first child, by path, that has one.  No directory's children are gathered for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent_directory
from ..sources.scratch import written
from .digests import combined

MIN_LINES, MAX_CHARS = 20, 6000
SENTENCE = r"(?s)^\s*(.*?[.!?])(?:\s|$)"


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, SENTENCE, 1))


def file_summaries(files: DataFrame, summarise: Callable[[Column], Column] = first_sentence, least: int = MIN_LINES, most: int | None = None) -> DataFrame:
    """``scope, target_path, content, source_hash`` of ``files(path, text, content_hash, loc)`` long enough.

    ``most`` is for a model whose input costs, such as ``MAX_CHARS``: what a summary may read of a text.
    """
    text = F.col("text") if most is None else F.substring("text", 1, most)
    return files.where(F.col("loc") >= least).select(F.lit("file").alias("scope"), F.col("path").alias("target_path"), summarise(text).alias("content"), F.col("content_hash").alias("source_hash"))


def _level(found: DataFrame, d: int, summarise: Callable[[Column], Column] | None, most: int, only: DataFrame | None = None) -> DataFrame:
    """The directories at depth ``d`` from their children in ``found``; of ``only(dir)``, if that is given."""
    below = found.where(F.col("target_path") != ".").withColumn("dir", parent_directory(F.col("target_path")))
    at = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    below = below.where(at == d)
    if only is not None:
        below = below.join(only, "dir", "left_semi")
    below = below.withColumn("line", F.concat_ws(": ", "target_path", "content"))
    level = combined(below, "source_hash", F.col("target_path"), F.when(F.col("line").rlike(SENTENCE), F.col("line")))
    content = F.coalesce(first_sentence(F.col("note")), F.lit(""))
    if summarise is not None:
        # Lines that begin within the first ``most`` characters: what is gathered is bounded.
        order = ["target_path", "content", "source_hash"]
        before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("dir").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        read = below.withColumn("before", before).where(F.col("before") < most).withColumn("line", F.substring("line", 1, most))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda c: c["line"]), "\n")
        level = level.join(read.groupBy("dir").agg(F.substring(body, 1, most).alias("body")), "dir")
        content = summarise(F.col("body"))
    scope = F.when(F.col("dir") == ".", "repo").otherwise("directory")
    return level.select(scope.alias("scope"), F.col("dir").alias("target_path"), content.alias("content"), F.col("hash").alias("source_hash"))


def hierarchy(summaries: DataFrame, depth: int, summarise: Callable[[Column], Column] | None = None, most: int = MAX_CHARS) -> DataFrame:
    """File summaries with those of all directories up to ``depth`` levels and of the root ``.``.

    A ``summarise`` of the user's reads the lines of all children in order, as one text of ``most`` characters at most.
    """
    found = summaries
    for d in range(depth, -1, -1):
        found = found.unionByName(_level(found, d, summarise, most))
    return found


def dirty_directories(before: DataFrame, after: DataFrame) -> DataFrame:
    """``dir``: every directory above a file summary that came, went or changed between the two."""
    same = ["target_path", "content", "source_hash"]
    old, new = (df.where("scope = 'file'").select(*same).distinct() for df in (before, after))
    null_safe = [old[c].eqNullSafe(new[c]) for c in same]
    changed = old.join(new, null_safe, "left_anti").select("target_path").union(new.join(old, null_safe, "left_anti").select("target_path"))
    parts = F.split("target_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return changed.distinct().select(F.explode(above).alias("dir")).distinct()


def refreshed_hierarchy(before: DataFrame, summaries: DataFrame, depth: int, summarise: Callable[[Column], Column] | None = None, most: int = MAX_CHARS) -> DataFrame:
    """``hierarchy(summaries, depth)`` from that of an earlier snapshot: directories without a changed file below stay as they
    are, and the others are made anew from their children, the deepest first."""
    dirty = written(dirty_directories(before, summaries), "dirty")
    kept = before.where("scope <> 'file'").join(dirty, F.col("target_path") == F.col("dir"), "left_anti")
    found = summaries.unionByName(kept.select(summaries.columns))
    for d in range(depth, -1, -1):
        found = found.unionByName(_level(found, d, summarise, most, dirty))
    return found


def stale(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """What of ``wanted`` has no cached summary of the same scope, path and content."""
    return wanted.join(cached.select("scope", "target_path", "source_hash"), ["scope", "target_path", "source_hash"], "left_anti")
