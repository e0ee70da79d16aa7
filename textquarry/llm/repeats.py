"""Seed and extend: token runs that occur earlier in the corpus, found over winnowed anchors.

A window is ``length`` consecutive tokens (words or lines) of one document.  A token is *repeated* when a
window that covers it starts earlier too: in a document with a smaller identifier, or earlier in the same
document.  Maximal runs of repeated tokens are the maximal repeats of at least ``length`` tokens.

1. **Anchors.**  Every window's anchor is the token n-gram of smallest hash in it (the leftmost of equals).
   Which one that is follows from the window's tokens alone, so equal windows have equal anchors at equal
   places: joining on anchors misses nothing.  A *seed* is an anchor with the run of windows that chose it.
2. **Seed join.**  Anchors that one seed alone has are dropped.  Seeds with the same anchor whose whole
   extension agrees, all windows both ways, are alike: the first stays, the others' windows are repeated.
   One aggregate by anchor tells how many seeds there are and whether all extend alike, and it combines before
   anything moves, so an anchor that stands everywhere is as cheap as any other.
3. **Extension.**  Where seeds with one anchor extend differently, the first of each kind goes back to its
   text and is extended window by window, and equal windows are matched by 128-bit hashes.

With ``alone`` a single token of so many words or more is a run by itself.  Its own hash is its fingerprint, so seeds of
windows that hold nothing but such tokens are left out: what repeats them repeats each of their tokens.

Counts and minima combine before they move.  A group is never expanded into pairs: its rows join its first
row.  Joins are equi-joins that Spark can split at a hot anchor, as what is aggregated is written before.  Only
texts that a filter takes for having repeats move, joined by document key; the others are worked on where they are.

Tokens are told apart by 64-bit hashes, and windows by 128 bits mixed from them: they are not compared as words.  Two
windows are taken for equal by mistake if all their 20 (or whatever the length is) tokens' hashes meet.

Defined cases: a null text counts as empty; shorter documents have no window and stay whole; rows without
an identifier come after all others, and rows that repeat an identifier are ordered by their text; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_bit, filter_bits, membership, told_members, written

MIX, STIR, LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: The extension of every token that is a run by itself.
ALONE = np.uint64(0xA10E)
RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def words(text: bytes) -> list[bytes]:
    return text.split()


def lines(text: bytes) -> list[bytes]:
    """Lines with a word; the others are no tokens."""
    return [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]


def join_words(text: bytes, removed: np.ndarray) -> bytes:
    return b" ".join(w for w, gone in zip(text.split(), removed.tolist()) if not gone)


def join_lines(text: bytes, removed: np.ndarray) -> bytes:
    gone = iter(removed.tolist())
    return b"\n".join(x for x in text.split(b"\n") if not (x.strip(b" \t\n\r\x0b\x0c") and next(gone)))


TOKENS: dict[str, tuple[Callable[[bytes], list[bytes]], Callable[[bytes, np.ndarray], bytes]]] = {"words": (words, join_words), "lines": (lines, join_lines)}


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * MIX + b
    x ^= x >> np.uint64(29)
    x *= STIR
    x ^= x >> np.uint64(32)
    return x


def _run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` tokens from each place on, from hashes of runs of doubling length."""
    n = len(tokens) - length + 1
    power, runs, done, made = 1, tokens, 0, None
    while True:
        if length & power:
            part = runs[done : done + n]
            made = part if made is None else _mixed(made, part)
            done += power
        if 2 * power > length:
            return _mixed(made, np.uint64(length))
        runs = _mixed(runs[:-power], runs[power:])
        power *= 2


def _token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), "<u8", len(tokens))


def _seeds(hashes: np.ndarray, length: int, gram: int, plain: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """``anchor, span, lo, hi, repeats``: per seed its anchor's hash, that of its extension, its first and
    last window, and whether the document has the same seed earlier.

    ``plain`` marks tokens that are runs by themselves; a seed with no other token is left out.
    """
    grams, windows = _run_hashes(hashes, gram), _run_hashes(hashes, length)
    width = length - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(windows))
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.append(lo[1:], len(windows)) - 1
    # The first and the last window overlap or touch, so their hashes stand for the whole extension.
    shape = ((hi - lo) * length + (at[lo] - lo)).astype("u8")
    span = _mixed(_mixed(windows[lo], windows[hi]), shape)
    anchor = grams[at[lo]]
    if plain is not None:
        sums = np.concatenate([[0], np.cumsum(plain)])
        some = sums[hi + length] - sums[lo] < hi + length - lo
        anchor, span, lo, hi = anchor[some], span[some], lo[some], hi[some]
    return anchor, span, lo, hi


def _alone(hashes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for tokens that are runs by themselves; ``hi`` is such that ``length - 1`` more is the token's place."""
    lo = np.flatnonzero(plain)
    return _mixed(hashes[lo], ALONE), np.full(len(lo), ALONE), lo


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, text``: a distinct long per row in the order of identifiers.

    Distinct integer identifiers are their own keys.  Otherwise the rows are range-sorted and numbered.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    integral = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if integral and rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    order = [F.asc_nulls_last("id"), F.asc("text")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")


def _seed_rows(keyed: DataFrame, tokens: str, length: int, gram: int, alone: int | None) -> DataFrame:
    """``anchor`` (null: the document has the same seed earlier), ``span, key, lo, hi, last``: first and last window, and
    last token."""
    split = TOKENS[tokens][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for key, text in zip(batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())):
                toks = split(text.as_py())
                if not toks or alone is None and len(toks) < length:
                    continue
                hashes, parts = _token_hashes(toks), []
                plain = None if alone is None else np.array([len(t.split(None, alone)) >= alone for t in toks])
                if len(toks) >= length:
                    anchor, span, lo, hi = _seeds(hashes, length, gram, plain)
                    parts.append((anchor, span, lo, hi, hi + length - 1))
                if plain is not None:
                    anchor, span, lo = _alone(hashes, plain)
                    parts.append((anchor, span, lo, lo, lo))
                anchor, span, lo, hi, last = (np.concatenate(x) for x in zip(*parts))
                _, first = np.unique(_mixed(anchor, span), return_index=True)  # the earliest place of each
                again = np.ones(len(lo), bool)
                again[first] = False
                found.append((anchor.view("<i8"), span.view("<i8"), lo, hi, last, again, np.full(len(lo), key)))
            if found:
                anchor, span, lo, hi, last, again, key = (np.concatenate(x) for x in zip(*found))
                columns = [pa.array(anchor, mask=again), pa.array(span), pa.array(key), *[pa.array(x.astype("int32")) for x in (lo, hi, last)]]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "span", "key", "lo", "hi", "last"])

    return keyed.select("key", "text").mapInArrow(run, "anchor long, span long, key long, lo int, hi int, last int")


def _window_rows(keyed: DataFrame, wanted: DataFrame, tokens: str, length: int) -> DataFrame:
    """Windows from ``lo`` to ``hi`` of ``wanted(key, lo, hi)``: ``w1, w2, key, lo``; ``w1`` null as above."""
    split = TOKENS[tokens][0]
    spans = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for key, text, ranges in zip(batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()), batch.column(2)):
                hashes = _token_hashes(split(text.as_py()))
                one, two = _run_hashes(hashes, length), _run_hashes(_mixed(hashes, LANE), length)
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges.as_py()]))
                pairs = np.stack([one[at], two[at]], axis=1)
                _, first = np.unique(pairs, axis=0, return_index=True)
                again = np.ones(len(at), bool)
                again[first] = False
                found.append((pairs.view("<i8"), at, again, np.full(len(at), key)))
            if found:
                pairs, at, again, key = (np.concatenate(x) for x in zip(*found))
                columns = [pa.array(pairs[:, 0], mask=again), pa.array(pairs[:, 1]), pa.array(key), pa.array(at.astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "key", "lo"])

    likely, _ = _told(keyed, written(spans.select("key"), "keys"))
    return spans.join(likely.select("key", "text"), "key").select("key", "text", "ranges").mapInArrow(run, "w1 long, w2 long, key long, lo int")


def _told(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that may be among ``keys``, and those that are not."""
    size = filter_bits(keys.count())
    filter_ = written(membership(keys.select(filter_bit(F.col("key"), size).alias("bit"))), "filter")
    told = told_members(keyed.withColumn("bit", filter_bit(F.col("key"), size)), filter_)
    return told.where("maybe").drop("maybe"), told.where("NOT maybe").drop("maybe")


def repeated_windows(keyed: DataFrame, tokens: str, length: int, gram: int, alone: int | None = None) -> DataFrame:
    """``key, lo, last``: runs of tokens that windows which start earlier too cover.  Runs may overlap."""
    seeds = written(_seed_rows(keyed, tokens, length, gram, alone), "seeds")
    mixed = F.min("span") != F.max("span")
    shared = seeds.where("anchor IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).where("n > 1")
    rows = written(seeds.join(written(shared.select("anchor", "mixed"), "anchors"), "anchor"), "shared")
    spans = written(rows.groupBy("anchor", "span").agg(F.min("key").alias("first")), "spans")
    told = rows.join(spans, ["anchor", "span"]).where("key > first OR mixed")
    told = written(told.select("key", "lo", "hi", "last", (F.col("key") > F.col("first")).alias("later")), "told")
    windows = written(_window_rows(keyed, told.where("NOT later"), tokens, length), "windows")
    firsts = windows.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(written(firsts.drop("n"), "firsts"), ["w1", "w2"]).where("key > first")
    last = (F.col("lo") + (length - 1)).alias("last")
    return (
        seeds.where("anchor IS NULL").select("key", "lo", "last")
        .unionByName(told.where("later").select("key", "lo", "last"))
        .unionByName(windows.where("w1 IS NULL").select("key", "lo", last))
        .unionByName(later.select("key", "lo", last))
    )


def without_repeats(docs: DataFrame, tokens: str, length: int, gram: int, alone: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, ``n_tokens``, ``n_removed``, ``repeats`` (token places ``lo`` to ``hi``, both within
    the repeat) and ``kept_text``, the text of the tokens that stay."""
    keyed = _keyed(docs, id_col, text_col)
    split, joined = TOKENS[tokens]
    ranges = repeated_windows(keyed, tokens, length, gram, alone).groupBy("key").agg(F.collect_list(F.struct("lo", "last")).alias("ranges"))
    ranges = written(ranges, "ranges")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, runs, kept = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text, found = text.as_py(), found.as_py() or []
                n = len(split(text))
                edge = np.zeros(n + 1, "int64")
                if found:
                    np.add.at(edge, [r["lo"] for r in found], 1)
                    np.add.at(edge, [r["last"] + 1 for r in found], -1)
                removed = np.cumsum(edge)[:n] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype("int8"))).reshape(-1, 2)
                total.append(n)
                gone.append(int(removed.sum()))
                runs.append([{"lo": int(a), "hi": int(b) - 1} for a, b in turn])
                kept.append(joined(text, removed))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, RANGES), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_removed", "repeats", "kept"])

    likely, clear = _told(keyed, ranges)
    none = F.lit(None).cast(ranges.schema["ranges"].dataType)
    rows = likely.join(ranges, "key", "left").select("id", "text", "ranges").unionByName(clear.select("id", "text", none.alias("ranges")))
    done = rows.mapInArrow(run, f"id {id_type}, n_tokens long, n_removed long, repeats array<struct<lo:int,hi:int>>, kept binary")
    return done.select("id", "n_tokens", "n_removed", "repeats", F.col("kept").cast("string").alias("kept_text"))
