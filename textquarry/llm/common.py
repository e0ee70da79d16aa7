"""What the training-data operators share: words, scratch tables, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder, written  # noqa: F401  the operators take them from here

#: A word is a run of characters other than the six ASCII white-space ones.  ``bytes.split()`` cuts
#: UTF-8 at exactly these characters, so Python workers use that instead of a pattern.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` packed in one struct ``row`` beside the given key columns.

    Whatever names the input has, they cannot clash with those of an operator.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(packed.alias("row"), *[c.alias(k) for k, c in keys.items()])


#: Rows and bytes up to which a table of sources or the like is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 4 << 20


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """Mark a *written* table for broadcast if it is small now; otherwise leave the join to Spark.

    The size is counted, not assumed: one pass over the table's rows as JSON.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, used = table.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and used <= BROADCAST_BYTES else table


#: Least and greatest number of bits of a membership filter, 8 KiB and 128 MiB, so it may be broadcast at any input.
FILTER_LEAST, FILTER_MOST = 16, 30


def filter_bits(members: int) -> int:
    """Bits of a filter for so many members: about sixteen for each, a power of two within the bounds.

    More members than it is made for only let more rows through to the exact step behind the filter.
    """
    return 1 << min(max((16 * members).bit_length(), FILTER_LEAST), FILTER_MOST)


def filter_bit(member: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(bits).cast("long"))


def membership(bits: DataFrame) -> DataFrame:
    """Bitmaps of the column ``bit``: at most ``2 ** FILTER_MOST / 32768`` rows of 4 KiB."""
    at = bits.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def told_members(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """All rows, with ``maybe``: whether their column ``bit`` is set in a ``membership``, as it is for all members."""
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)), 16, 10) as int)")
    mask = F.expr("shiftleft(1, cast(bitmap_bit_position(bit) % 8 as int))")
    met = rows.withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(filter_), "bucket", "left")  # proven bound: FILTER_MOST
    return met.withColumn("maybe", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("bucket", "bits", "bit")


def possible_members(rows: DataFrame, filter_: DataFrame) -> DataFrame:
    """The rows whose column ``bit`` is set in a ``membership``: all members, and few others."""
    return told_members(rows, filter_).where("maybe").drop("maybe")
