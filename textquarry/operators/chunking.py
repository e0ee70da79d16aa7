"""Chunks of texts: overlapping character windows and markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate

SIZE, OVERLAP, MAX_TOKENS = 1500, 200, 800


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _running(counts: Column) -> Column:
    """For each of an array of counts the sum of those before it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    return F.aggregate(counts, start, step, lambda s: s["out"])


def window_chunks(docs: DataFrame, *keys: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters; the last one reaches the end.  Lines count from 1.

    A text is cut once into pieces of a step's length; a window is a few pieces, and its line the breaks before it.
    """
    step, n = max(size - overlap, 1), F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    rows = docs.where(n > 0).select(*keys, last.alias("last"), F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1)).alias("pieces"))
    rows = rows.withColumn("before", _running(F.transform("pieces", lambda x: _breaks(x).cast("long"))))
    content = lambda k: F.substring(F.array_join(F.slice("pieces", k + 1, F.lit(-(-size // step))), ""), 1, size)
    windows = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(k.cast("long").alias("k"), content(k).alias("content"), (F.get("before", k) + 1).alias("start_line")))
    rows = rows.select(*keys, F.explode(windows).alias("w")).select(*keys, "w.k", "w.content", "w.start_line")
    upto_last = F.expr("substring(content, 1, length(content) - 1)")
    return rows.withColumn("end_line", (F.col("start_line") + _breaks(upto_last)).cast("long")).withColumn("tokens", token_estimate(F.col("content")))


def markdown_sections(docs: DataFrame, key: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Sections from each heading to the next, ``key, section, heading, start_line, end_line, content``.

    Sections above ``max_tokens`` are cut into windows, numbered by ``part``, with the lines of the document.
    Texts are cut where they are: nothing moves.
    """
    cut = F.split("text", r"(?<=\n)(?=#{1,6}[ \t\x0b\f\r])", -1)
    rows = docs.where(F.length("text") > 0).select(key, cut.alias("pieces"))
    rows = rows.withColumn("before", _running(F.transform("pieces", lambda x: _breaks(x).cast("long"))))
    rows = rows.select(key, F.size("pieces").alias("n"), F.posexplode(F.arrays_zip("pieces", "before")).alias("at", "p"))
    # The break before a heading belongs to no section.
    text = F.when(F.col("at") < F.col("n") - 1, F.expr("substring(p.pieces, 1, length(p.pieces) - 1)")).otherwise(F.col("p.pieces"))
    rows = rows.select(key, F.col("at").cast("long").alias("section"), (F.col("p.before") + 1).alias("first_line"), text.alias("text"))
    head = F.split("text", "\n", 2)[0]
    heading = F.when(head.rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace(head, "^#+", "")))
    done = rows.where(F.regexp_replace("text", r"\s+", "") != "").withColumn("heading", heading)
    whole = done.where(F.length("text") <= 4 * max_tokens)
    small = whole.select(key, "section", "heading", F.lit(0).cast("long").alias("part"), F.col("first_line").alias("start_line"), (F.col("first_line") + _breaks(F.col("text"))).cast("long").alias("end_line"), F.col("text").alias("content"))
    large = window_chunks(done.where(F.length("text") > 4 * max_tokens), key, "section", "heading", "first_line")
    large = large.select(key, "section", "heading", F.col("k").alias("part"), (F.col("start_line") + F.col("first_line") - 1).alias("start_line"), (F.col("end_line") + F.col("first_line") - 1).alias("end_line"), "content")
    return small.unionByName(large)
