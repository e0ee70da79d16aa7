"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the keys are cut into equal ranges, as many as
the square root of the source's rows, so that neither the ranges nor their rows grow large, and a source
with a third of all rows spreads like any other.  Word counts are summed by range, prefix sums over the
ranges find the one in which a source's budget ends, and prefix sums over that range's rows find the
document.  From then on a document's share follows from its key and its source's cut alone.

Targets: sources share ``share`` times all words by weight; a target stops at ``max_epochs`` times its
source's words and the excess goes to the others by weight.  This is the level ``x`` at which
``sum(min(cap, x * weight))`` meets the total, found over the sources sorted by ``cap / weight``.

Defined cases: a null text has no words and takes nothing; a null source is a source of its own, the last
in order; null identifiers count as one identifier ``null``; rows that repeat an identifier share a key,
and if the cut falls among rows equal in identifier and size they take the same part of it, rounded down;
an empty table, or one without words, gives targets of zero; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, whole_rows, word_count, written

#: Keys are this many bits of an MD5 digest.
KEY_BITS = 60


def random_key(identifier: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(identifier.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """One row per source: its words, rows, weight and target.  ``sizes`` has ``source`` and ``size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    order = Window.orderBy(F.asc_nulls_last("source"))  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (everything * F.lit(float(share)) - before) / weight_left)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    t = t.withColumn("level", free["level"])
    return t.select("source", "source_size", "source_rows", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def cuts(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole epochs, and the key, identifier and size at which the last epoch ends.

    ``keyed`` has ``source``, ``id``, ``size`` and ``key``.  ``part`` is what each row at the cut takes.
    """
    budget = F.round("target").cast("long")
    t = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    t = t.withColumn("bits", F.ceil(F.log2(F.col("source_rows")) / 2).cast("int"))
    t = written(t.withColumnRenamed("source", "of"), "budgets")
    block = F.expr(f"shiftright(key, {KEY_BITS} - bits)")
    rows = keyed.join(broadcast_if_small(t.select("of", "bits", "rest")), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", block)
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = ends.where("before <= rest and rest < before + words").select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    last = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    same = last.groupBy("source", "key", "id", "size", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    cut = same.where("start <= rest and rest < start + size * n")
    cut = cut.select(F.col("source").alias("cut_of"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).alias("part"))
    found = t.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of", "bits", "rest", "source_rows")
    return broadcast_if_small(written(found, "cuts"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    size = word_count(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), size.alias("size"))
    return written(rows.withColumn("key", random_key(F.col("id"), seed)), "sizes")


def _taken() -> Column:
    """Words that a row with ``key``, ``id`` and ``size`` takes, given its source's cut."""
    before = F.struct("key", "id", "size") < F.struct(F.col("cut_key"), F.col("cut_id"), F.col("cut_size"))
    at = (F.col("key") == F.col("cut_key")) & F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("size") == F.col("cut_size"))
    last = F.when(at, F.col("part")).when(before, F.col("size")).otherwise(F.lit(0))
    return (F.col("epochs") * F.col("size") + last).cast("long")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    The document at a source's cut takes its leading words only, so that a source takes its target to the word.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    cut = cuts(keyed, source_targets(keyed, weights, share, max_epochs))
    return keyed.join(cut, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture's rows with the input's columns; a document taken for two epochs comes twice.

    Documents stay whole here: the one at the cut comes when at least half its words fall before the cut.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    cut = cuts(keyed, source_targets(keyed, weights, share, max_epochs))
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = whole_rows(docs, source=F.col(f"`{source_col}`"), id=own, size=word_count(text), key=random_key(own, seed))
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.round(_taken() / F.col("size"))).otherwise(F.lit(1)).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")
