"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Runs of ``GRAM`` bytes of every document are hashed into a fixed number of buckets.  Two multinomials are
counted over whole texts, one over the trusted documents and one over all, and a document's score is the
mean over its n-grams of ``log((c_t + s) / (r * c + s))``: ``c_t`` and ``c`` are the bucket's counts, ``r`` the
trusted share of all n-grams, ``s`` a smoothing count.  The mean is the length normalisation.  A document
passes if its score is at least ``THRESHOLD``; nothing is drawn at random.

Counting adds up within tasks first, at most one number per bucket and task.  Raw counts take one pass in
which nothing moves.  For the target only texts that a filter of fixed size takes for trusted are joined
with the trusted identifiers, which then decide.  The finished table has ``2**BITS`` entries whatever the
input, so it may go to the driver and back to the workers.

Defined cases: a null text counts as empty; a text shorter than an n-gram scores zero; without trusted
documents every score is zero; a document is trusted if any of its label rows says so, and rows that repeat
an identifier share its trust; a null identifier is never trusted; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_bit, filter_bits, membership, possible_members
from .textstats import SLICE, base_counts, gram_buckets, slices

#: A mean of -0.25 a gram: a text as likely under the trusted grams as under all of them, but for a quarter of a nat a
#: gram.  Trusted text scores about zero or more by construction, whatever its share of the corpus.
GRAM, BITS, SMOOTHING, THRESHOLD = 4, 16, 4.0, -0.25
MIN_WORDS, MAX_REPEATED = 50, 50
#: Buckets that travel in one row.
BLOCK = 1024


def _added(rows: DataFrame, gram: int, bits: int) -> DataFrame:
    """``block, counts`` of the column ``text``: each task's counts of n-grams, ``BLOCK`` buckets to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, "i8")
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for part in slices(text.as_py() or b"", gram):
                    held.append(gram_buckets(part, gram, bits))
                    waiting += len(held[-1])
                    if waiting >= SLICE:  # dense counting once for many short texts
                        counts += np.bincount(np.concatenate(held), minlength=1 << bits)
                        held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits)
        blocks = counts.reshape(-1, BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(list(blocks[at]), pa.list_(pa.int64()))], ["block", "counts"])

    return rows.select("text").mapInArrow(run, "block int, counts array<long>")


def gram_counts(docs: DataFrame, trusted: DataFrame, gram: int = GRAM, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``target, block, counts``: n-grams of all texts, and (``target``) of those whose ``id`` is in ``trusted``."""
    sure = trusted.where("id IS NOT NULL").select(F.col("id").alias("of")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = filter_bits(sure.count())
    likely = possible_members(rows.withColumn("bit", filter_bit(F.col("id"), size)), membership(sure.select(filter_bit(F.col("of"), size).alias("bit"))))
    known = likely.join(sure.hint("merge"), F.col("id") == F.col("of"))  # labels grow with the corpus: never broadcast
    parts = _added(rows, gram, bits).withColumn("target", F.lit(False)).unionByName(_added(known, gram, bits).withColumn("target", F.lit(True)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            for target, block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                total[target, block] = total.get((target, block), 0) + counts.values.to_numpy()
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["target", "block", "counts"])

    # Every key has one row per task at most; there are 2 * 2**bits / BLOCK keys.
    return parts.select("target", "block", "counts").repartition("target", "block").mapInArrow(add, "target boolean, block int, counts array<long>")


def ratios(counts: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log-likelihood ratio of each bucket; the table's size does not depend on the input."""
    table = np.zeros((2, (1 << bits) // BLOCK, BLOCK))
    for row in counts.collect():  # 2 * 2**bits counts at most
        table[int(row.target), row.block] = row.counts
    raw, target = table.reshape(2, -1)
    share = target.sum() / max(raw.sum(), 1)
    return np.log((target + smoothing) / (share * raw + smoothing))


def judged(docs: DataFrame, table: np.ndarray, gram: int = GRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, the base counts, ``llr``, ``base_failed`` and ``kept``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bits = len(table).bit_length() - 1
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, scores = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base.append(base_counts(text))
                total, n = 0.0, 0
                for part in slices(text.encode(), gram):
                    found = table[gram_buckets(part, gram, bits)]
                    total, n = total + float(found.sum()), n + len(found)
                scores.append(total / n if n else 0.0)
            columns = np.array(base, "i8").reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(scores, pa.float64())], ["id", *names, "llr"])

    schema = ", ".join([f"id {id_type}", *[f"{n} long" for n in names], "llr double"])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    table = ratios(gram_counts(docs, trusted, id_col=id_col, text_col=text_col))
    return judged(docs, table, id_col=id_col, text_col=text_col)
