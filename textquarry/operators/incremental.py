"""Snapshots: what changed, and an index brought up to date from that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status`` of two snapshots ``(path, content_hash)``: added, changed, unchanged or removed."""
    o, n = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def refreshed(index: DataFrame, files: DataFrame, status: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index of the new snapshot: rows of unchanged paths stay, the others' are built from their files."""
    kept = index.join(status.where("status = 'unchanged'").select("path"), "path", "left_semi")
    fresh = build(files.join(status.where("status IN ('added', 'changed')").select("path"), "path", "left_semi"))
    return kept.unionByName(fresh)


def without_dangling(refs: DataFrame, present: DataFrame) -> DataFrame:
    """References whose target is gone point nowhere; the references stay."""
    alive = present.select(F.col("symbol_id").alias("there")).distinct()
    rows = refs.join(alive, F.col("resolved_symbol_id") == F.col("there"), "left")
    return rows.withColumn("resolved_symbol_id", F.col("there")).drop("there")
