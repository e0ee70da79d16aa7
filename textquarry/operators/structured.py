"""Joins over symbols, references and files: lookups, resolution, nearest and enclosing matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def definitions(symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """All definitions of ``names(q, name)``, ranked: exported first, then by path and line."""
    found = names.join(symbols, "name").join(files.select("file_id", "path"), "file_id")
    order = Window.partitionBy("q", "name").orderBy(F.desc("is_exported"), "path", "start_line")
    return found.withColumn("rank", F.row_number().over(order).cast("long"))


def located(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of ``candidates(q, priority, name)`` the first name that has a definition, with all of them."""
    # The names are chosen before they meet their definitions, of which one name may have any number.
    defined = candidates.join(symbols.select("name").distinct(), "name", "left_semi")
    first = defined.groupBy("q").agg(F.min("priority").alias("priority"))
    return defined.join(first, ["q", "priority"]).join(symbols, "name")


def references(refs: DataFrame, symbols: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """Places that refer to ``names(q, name)``, with the symbol they stand in, if any."""
    target = symbols.select(F.col("symbol_id").alias("resolved_symbol_id"), "name")
    caller = symbols.select(F.col("symbol_id").alias("from_symbol_id"), F.col("name").alias("caller"))
    place = files.select(F.col("file_id").alias("from_file_id"), "path")
    return refs.join(target.join(names, "name"), "resolved_symbol_id").join(place, "from_file_id").join(caller, "from_symbol_id", "left")


def smallest_enclosing(points: DataFrame, ranges: DataFrame, key: str, *more: str) -> DataFrame:
    """For ``points(key, point_id, line)`` the smallest of ``ranges(key, range_id, start, end)`` around it, with ``more`` columns of it.

    Ranges are laid out over their lines, of which each keeps the smallest, so the join is by key and line: a file
    with very many lines and ranges is as many groups, and no point meets a range that does not hold it.
    """
    laid = ranges.where("start <= end").select(F.col(key).alias("of"), F.explode(F.sequence("start", "end")).alias("at"), F.struct((F.col("end") - F.col("start")).alias("size"), "start", "range_id", *more).alias("r"))
    best = laid.groupBy("of", "at").agg(F.min("r").alias("r"))
    # Never broadcast: ranges of a small compressed table are many times what its size tells.
    found = points.join(best.hint("merge"), (F.col(key) == F.col("of")) & (F.col("line") == F.col("at")), "left")
    return found.select(key, "point_id", "line", F.col("r.range_id").alias("range_id"), *[F.col(f"r.{c}").alias(c) for c in more])


def resolved(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolve ``calls(file, name)``: to the only definition in the file, else to the only one anywhere."""
    near = symbols.groupBy(F.col("file").alias("f"), F.col("name").alias("n1")).agg(F.count(F.lit(1)).alias("near"), F.min("symbol_id").alias("near_id"))
    wide = symbols.groupBy(F.col("name").alias("n2")).agg(F.count(F.lit(1)).alias("wide"), F.min("symbol_id").alias("wide_id"))
    rows = calls.join(near, (F.col("file") == F.col("f")) & (F.col("name") == F.col("n1")), "left").join(wide, F.col("name") == F.col("n2"), "left")
    chosen = F.when(F.col("near") == 1, F.col("near_id")).when(F.col("near") > 1, F.lit(None)).when(F.col("wide") == 1, F.col("wide_id"))
    return rows.withColumn("resolved", chosen).drop("f", "n1", "near", "near_id", "n2", "wide", "wide_id")


def nearest_start(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For ``left(keys, left_id, at)`` the row of ``right(keys, right_id, start)`` that starts nearest.

    Only the neighbours below and above can be nearest, so each side is found by one ordered pass over the
    union of both sides, and no pairs are formed.
    """
    a = left.select(*keys, "left_id", F.col("at").alias("x"), F.lit(None).cast(right.schema["right_id"].dataType).alias("right_id"))
    b = right.select(*keys, F.lit(None).cast(left.schema["left_id"].dataType).alias("left_id"), F.col("start").alias("x"), "right_id")
    both = a.unionByName(b)
    value = F.when(F.col("right_id").isNotNull(), F.struct("x", "right_id"))
    ordered = Window.partitionBy(*keys).orderBy("x", F.desc_nulls_last("right_id"))
    # Ties go to the smallest id: coming from below, ids are met largest first; from above, smallest first.
    below = F.last(value, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upward = Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc_nulls_last("right_id"))
    above = F.last(value, ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("below", below).withColumn("above", above).where("left_id IS NOT NULL")
    down, up = F.abs(F.col("x") - F.col("below.x")), F.abs(F.col("above.x") - F.col("x"))
    lower = F.col("above").isNull() | (down < up) | ((down == up) & (F.col("below.right_id") <= F.col("above.right_id")))
    nearest = F.when(F.col("below").isNull(), F.col("above")).when(lower, F.col("below")).otherwise(F.col("above"))
    return rows.select(*keys, "left_id", nearest["right_id"].alias("right_id"), F.abs(nearest["x"] - F.col("x")).alias("distance"))


def by_manifest(dependencies: DataFrame) -> DataFrame:
    """``manifest, n, names``: dependencies grouped by manifest, names in order.

    Equal names are counted before they move; a manifest gathers its different names and repeats them in its text alone.
    """
    counted = dependencies.groupBy("manifest", "name").agg(F.count(F.lit(1)).alias("times"))
    each = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "times"))))
    names = F.array_join(F.transform(each, lambda x: F.substring(F.repeat(F.concat(F.lit(", "), x["name"]), x["times"].cast("int")), 3, (1 << 31) - 1)), ", ")
    return counted.groupBy("manifest").agg(F.sum("times").alias("n"), names.alias("names"))


def best_summary(summaries: DataFrame, paths: DataFrame) -> DataFrame:
    """For ``paths(path)`` the summary of the narrowest scope."""
    scope = F.when(F.col("scope") == "file", 0).when(F.col("scope") == "directory", 1).otherwise(2)
    found = paths.join(summaries, F.col("path") == F.col("target_path"))
    return found.groupBy("path").agg(F.min_by(F.struct("scope", "content"), scope).alias("s")).select("path", "s.scope", "s.content")
