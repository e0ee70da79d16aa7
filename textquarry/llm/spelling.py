"""Spelling variants: words one edit apart, found in a reduced alphabet and verified on the words themselves.

* **Words** are runs of letters of whole texts, counted in Spark; counts combine before they move.
* **Reduced alphabet.**  Letters are hashed to a few symbols, so a word becomes a shorter-alphabet one.  Words one edit
  apart have reduced words at most one edit apart.
* **Neighbourhoods.**  For each word all reduced words within one edit of its own are generated, as 64-bit keys, in
  Arrow batches; a membership filter of the reduced vocabulary drops nearly all of them before anything moves.
* **Join and verification.**  What is left meets the reduced vocabulary by an equi-join, and Levenshtein's distance on
  the original words decides.  Every ordered pair of near words comes exactly once.
* **Large groups.**  Words whose reduced word is shared by more than ``GROUP`` words are reduced again by a larger
  alphabet that refines the first, in the end by the letters themselves, where every group is one word.  A pair is found
  at the level of the later of its two words, so none is lost and no key has more than ``GROUP`` words.

Defined cases: a null text has no words and a null identifier counts as empty text; rows that repeat are counted each
time; texts may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_bit, filter_bits, membership, possible_members, written

#: A run of letters once A-Z are lowered.
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by its checksum, loses a letter (a planted slip).
SLIP = 199
#: Words have so many code points and occurrences at least; a form has so many times its word's occurrences.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Symbols of the reduced alphabets, each refining the one before; 0 stands for the letters themselves.
SYMBOLS = (12, 48, 0)
#: Words that may share a reduced word.
GROUP = 64
#: Keys generated at a time.
SLICE = 1 << 20
BASE, LENGTHS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def slipped(run: Column, id_: Column) -> Column:
    """The lowered run, less one code point where its checksum says so."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("run"), F.col("id")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols, from 1, of code points.  A larger alphabet of ``SYMBOLS`` refines a smaller one."""
    if not symbols:
        return points.astype("u8") + np.uint64(1)
    own, back = np.unique(points, return_inverse=True)
    hashed = np.array([xxhash.xxh32_intdigest(chr(p).encode()) % symbols + 1 for p in own.tolist()], "u8")
    return hashed[back].reshape(points.shape)


def _ends(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes and suffixes of words of one length (rows), and the powers of the base."""
    n, length = s.shape
    powers = list(accumulate(range(length + 1), lambda p, _: p * BASE % (1 << 64), initial=1))
    power, head, tail = np.array(powers, "u8"), np.zeros((n, length + 1), "u8"), np.zeros((n, length + 1), "u8")
    for i in range(length):
        head[:, i + 1] = head[:, i] * np.uint64(BASE) + s[:, i]
        tail[:, length - 1 - i] = tail[:, length - i] + s[:, length - 1 - i] * power[i]
    return head, tail, power


def _length(length: int) -> np.uint64:
    return np.uint64(length * LENGTHS % (1 << 64))


def own_keys(s: np.ndarray) -> np.ndarray:
    return _ends(s)[0][:, -1] + _length(s.shape[1])


def near_keys(s: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Keys of all words within one edit of each row's, itself included; may repeat."""
    n, length = s.shape
    head, tail, power = _ends(s)
    rest = power[length - 1 - np.arange(length)]
    gone = head[:, :-1] * rest + tail[:, 1:] + _length(length - 1)
    other = (head[:, :-1] * rest * np.uint64(BASE) + tail[:, 1:])[:, :, None] + (rest[:, None] * alphabet)[None] + _length(length)
    gaps = power[length - np.arange(length + 1)]
    more = (head * gaps * np.uint64(BASE) + tail)[:, :, None] + (gaps[:, None] * alphabet)[None] + _length(length + 1)
    return np.concatenate([gone, other.reshape(n, -1), more.reshape(n, -1)], axis=1)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length with their code points, in slices of bounded size."""
    points = [np.frombuffer(w.encode("utf-32-le"), "u4") for w in words.to_pylist()]
    lengths = np.array([len(p) for p in points])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, SLICE // (length * 32))
        for start in range(0, len(at), step):
            part = at[start : start + step]
            yield part, np.stack([points[i] for i in part])


def keyed(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n, key``: the key of each word's reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points in _by_length(batch.column(0)):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own_keys(reduced(points, symbols)).view("i8"))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def neighbourhoods(words: DataFrame, symbols: int, letters: list[int]) -> DataFrame:
    """``word, n, keys``: the distinct keys of the full one-edit neighbourhood of each word's reduced word."""
    alphabet = np.unique(reduced(np.array(letters, "u4"), symbols)) if not symbols else np.arange(1, symbols + 1, dtype="u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points in _by_length(batch.column(0)):
                keys = np.sort(near_keys(reduced(points, symbols), alphabet), axis=1)
                fresh = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                part, ends = batch.take(pa.array(at)), np.concatenate([[0], np.cumsum(fresh.sum(axis=1))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[fresh].view("i8")))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["word", "n", "keys"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, keys array<long>")


def _met(now: DataFrame, targets: DataFrame, symbols: int, letters: list[int]) -> DataFrame:
    """Near pairs of a word of ``now`` and one of ``targets(word, n, key, settled)``."""
    size = filter_bits(targets.count())
    near = neighbourhoods(now, symbols, letters).select("word", "n", F.explode("keys").alias("key"))
    near = possible_members(near.withColumn("bit", filter_bit(F.col("key"), size)), membership(targets.select(filter_bit(F.col("key"), size).alias("bit"))))
    other = targets.select("key", "settled", F.col("word").alias("near"), F.col("n").alias("near_n"))
    close = (F.col("word") != F.col("near")) & (F.abs(F.char_length("word") - F.char_length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return near.join(other, "key").where(close).select("word", "n", "near", "near_n", "settled")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n, near, near_n)`` for every ordered pair of words of ``words(word, n)``, a *written* table, that are one
    edit apart."""
    # At most the letters of RUN.
    letters = sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    left, settled, found = words, None, None
    for symbols in SYMBOLS:
        own = written(keyed(left, symbols), "keyed")
        large = written(own.groupBy("key").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") > group), "large") if symbols else None
        again = large is not None and not large.isEmpty()
        now = own.join(large, "key", "left_anti") if again else own
        targets = now.withColumn("settled", F.lit(False))
        if settled is not None:
            targets = targets.unionByName(keyed(settled, symbols).withColumn("settled", F.lit(True)))
        pairs = _met(now, written(targets, "targets") if again or settled is not None else targets, symbols, letters)
        if settled is not None:
            # Words of earlier levels generate nothing here: their side of the pair comes from this one.
            way = F.explode(F.when(F.col("settled"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("back")
            turned = lambda a, b: F.when(F.col("back"), F.col(b)).otherwise(F.col(a))
            pairs = written(pairs, "pairs").select("*", way).select(*[turned(a, b).alias(a) for a, b in (("word", "near"), ("n", "near_n"), ("near", "word"), ("near_n", "n"))])
        pairs = pairs.select("word", "n", "near", "near_n")
        found = pairs if found is None else found.unionByName(pairs)
        if not again:
            return found
        settled = now.select("word", "n") if settled is None else settled.unionByName(now.select("word", "n"))
        settled, left = written(settled, "settled"), written(own.join(large, "key", "left_semi").select("word", "n"), "left")
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the words of ``forms(word, form)``: the last form, by doubling steps.

    Counts grow ``TIMES`` fold from a word to its form, so a chain has fewer than 28 words and 5 rounds end it.
    """
    hops = written(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        hops = written(hops.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word.

    ``form`` is the near word of most occurrences (the smallest, if several) where these are ``TIMES`` the word's at
    least; ``root`` is where following forms ends.
    """
    words = written(counted_words(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_pairs(words, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    strong = form_n >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, form_n).alias("form_n"))
    rows = written(rows, "forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
