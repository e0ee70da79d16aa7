"""Groups of any size put in order and hashed as a stream, never gathered.

Equal parts are counted before they move, the rest is range-sorted over all tasks, and each task packs its sorted
parts in blocks of ``BLOCK``.  The hash of a group is that of all its parts in order, so one task a group must read
them; it reads the blocks, sorted by Spark, and holds one batch of them beside the state of the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a block: some 70 bytes each, and an Arrow batch has up to 10,000 blocks.
BLOCK = 64
#: Copies of a part hashed at a time.
COPIES = 1024
NOTE = "struct<place:string,note:string>"
PACKED = f"dir string, low string, parts array<string>, counts array<long>, first {NOTE}"
TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.struct([("place", pa.string()), ("note", pa.string())])]

FOLDED = [pa.string(), pa.int64(), pa.string(), pa.string()]


def _least(notes: Iterator[dict | None]) -> dict | None:
    return min((x for x in notes if x is not None), key=lambda x: (x["place"], x["note"]), default=None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(dir, part, n, first)`` as they come, sorted."""

    done: list[tuple] = []
    for group, rows in groupby(_rows(batches), key=lambda r: r[0]):
        while block := list(islice(rows, BLOCK)):
            done.append((group, block[0][1], [r[1] for r in block], [r[2] for r in block], _least(r[3] for r in block)))
            if len(done) == BLOCK:
                yield _batch(done, TYPES, ["dir", "low", "parts", "counts", "first"])
                done = []
    if done:
        yield _batch(done, TYPES, ["dir", "low", "parts", "counts", "first"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as they come, sorted."""
    done: list[tuple] = []
    for group, blocks in groupby(_rows(batches), key=lambda r: r[0]):
        state, total, best = hashlib.sha256(), 0, None
        for _, _, parts, counts, first in blocks:
            for part, n in zip(parts, counts):
                total += n
                if part is not None:
                    data = part.encode() + b"\0"
                    for _ in range(n // COPIES):
                        state.update(data * COPIES)
                    state.update(data * (n % COPIES))
            best = _least(iter((best, first)))
        done.append((group, total, state.hexdigest(), best and best["note"]))
        if len(done) == BLOCK:
            yield _batch(done, FOLDED, ["dir", "n", "hash", "note"])
            done = []
    if done:
        yield _batch(done, FOLDED, ["dir", "n", "hash", "note"])


def combined(rows: DataFrame, part: str, place: Column | None = None, note: Column | None = None) -> DataFrame:
    """``dir, n, hash, note`` per ``dir`` of ``rows``: its rows, ``combined_hash`` of their column ``part``, and of
    the notes that are not null the one at the smallest place."""
    place, note = (F.lit(None).cast("string") if c is None else c for c in (place, note))
    # Named in the struct's own order, which is that of places, then notes.
    own = F.when(note.isNotNull(), F.struct(place.alias("place"), note.alias("note")))
    counted = rows.groupBy("dir", F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first"))
    order = ["dir", "part"]
    blocks = counted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, PACKED)
    # Equal parts are one row, so no two blocks of a group start alike.
    return blocks.repartition("dir").sortWithinPartitions("dir", "low").mapInArrow(_folded, "dir string, n long, hash string, note string")
