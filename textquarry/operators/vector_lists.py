"""Exact nearest neighbours over inverted lists: cells that cannot hold a nearer vector are not read.

* **Lists.**  Centroids come from k-means over a sample of at most ``SAMPLE`` vectors; every vector, of the sample or not, is
  placed in the list of its nearest centroid with its distance to it.  Lists are cut in shells of like distance, and
  shells of many vectors in pieces, so a cell's size is bounded whatever repeats.  There are at most ``CELLS`` shells.
* **Bounds.**  By the triangle inequality a vector ``x`` of a shell between the radii ``lo`` and ``hi`` around ``c`` is no nearer to
  ``q`` than ``max(d(q, c) - hi, lo - d(q, c))``.
* **Search.**  A question first reads the cells of the least bounds that hold ``k`` vectors; the distance of its k-th best there
  limits the rest, and it reads only cells whose bound does not exceed that.  A cell meets its questions in groups of
  ``ASKED``, each a sorted stream of vectors, then questions; a task holds one cell.

Results equal those of comparing all pairs.  The plan does not depend on the number of questions.

Defined cases: vectors are compared at length one, and a zero vector as it is; rows without a vector are neither found
nor ask; equal distances (to nine places) go by ``id``; rows may repeat; without vectors nothing is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import normalised

#: Vectors that centroids are fitted on, at most; rounds of k-means; lists.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 512
#: Vectors of a cell, at least; shells over all lists, at most; shells of a list, at most.
CELL, CELLS, SHELLS = 1024, 32_768, 64
#: Questions that meet a cell at a time.
ASKED = 512
#: Slack of bounds, above rounding errors of distances.
SLACK = 1e-8
SEED = 42


@dataclass
class Lists:
    """``vectors(id, v, block)``; ``cells(list, shell, lo, hi, n, pieces)`` and ``centroids(list, c)``, both of bounded size."""

    vectors: DataFrame
    cells: DataFrame
    centroids: DataFrame


def k_means(sample: np.ndarray, lists: int) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    centres = sample[draw.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centre(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its centre's number and its distance, the latter free of cancellation."""
    own = np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * part @ centres.T, axis=1) for part in np.array_split(rows, len(rows) // 4096 + 1)])
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fitted(vectors: DataFrame) -> np.ndarray:
    """Centroids: about the root of the number of vectors, ``LISTS`` at most.  The sample is that of the least hashes."""
    rows = vectors.where("v IS NOT NULL").select(F.xxhash64("id", "v").alias("h"), normalised(F.col("v")).alias("v"))
    n = rows.count()
    sample = [r.v for r in rows.orderBy("h").limit(SAMPLE).collect()]
    if not sample:
        return np.zeros((0, 1))
    return k_means(np.array(sample, float), min(LISTS, math.isqrt(n) + 1))


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, v, list, r``: every vector in the list of its nearest centroid."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, r = _nearest_centre(_matrix(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype("i4")), pa.array(r)], ["id", "v", "list", "r"])

    rows = vectors.where("v IS NOT NULL").select("id", normalised(F.col("v")).alias("v"))
    return rows.mapInArrow(run, f"id {id_type}, v array<double>, list int, r double")


def built(vectors: DataFrame, centres: np.ndarray | None = None) -> Lists:
    """Lists over ``vectors(id, v)``; with given centroids (those of lists before) nothing is fitted."""
    spark = vectors.sparkSession
    centres = fitted(vectors) if centres is None else centres
    rows = written(placed(vectors, centres) if len(centres) else vectors.limit(0).select("id", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("list"), F.lit(0.0).alias("r")), "placed")
    lists = rows.groupBy("list").agg(F.count(F.lit(1)).alias("all"), F.max("r").alias("far"))
    total = rows.count()
    size = max(CELL, -(-total // CELLS))
    shells = F.least(F.ceil(F.col("all") / size), F.lit(SHELLS))
    # A row a list, LISTS at most.
    cut = lists.select("list", "far", shells.alias("shells"))
    shell = F.when(F.col("far") > 0, F.least(F.floor(F.col("r") / F.col("far") * F.col("shells")), F.col("shells") - 1)).otherwise(0).cast("int")
    shelled = rows.join(F.broadcast(cut), "list").select("id", "v", "list", "r", shell.alias("shell"))
    cells = written(shelled.groupBy("list", "shell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / size)), "cells")
    piece = F.pmod(F.xxhash64("id", "v"), F.col("pieces"))
    own = shelled.join(F.broadcast(cells.select("list", "shell", "pieces")), ["list", "shell"])  # at most LISTS * SHELLS rows
    block = _block(F.col("list"), F.col("shell"), piece)
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, c array<double>")
    return Lists(own.select("id", "v", block.alias("block")), cells, told)


def centres_of(lists: Lists) -> np.ndarray:
    """The centroids, ``LISTS`` at most."""
    return np.array([r.c for r in lists.centroids.orderBy("list").collect()], float)


def _block(list_: Column, shell: Column, piece: Column) -> Column:
    return F.shiftleft(list_.cast("long"), 40).bitwiseOR(F.shiftleft(shell.cast("long"), 32)).bitwiseOR(piece.cast("long"))


def _chosen(questions: DataFrame, lists: Lists, k: int) -> DataFrame:
    """``q, w, block, sure``: cells of each question; the first ones are ``sure``, others have a ``bound``.

    ``questions(q, w, limit)`` have a null limit at first; then a limit leaves out the first cells and what exceeds it."""
    centres = centres_of(lists)
    cells = lists.cells.orderBy("list", "shell").collect()  # LISTS * SHELLS at most
    own, lo, hi, n = (np.array([c[f] for c in cells]) for f in ("list", "lo", "hi", "n"))
    names = np.array([c.list << 40 | c.shell << 32 for c in cells], "i8")
    pieces = np.array([c.pieces for c in cells], "i8")
    q_type = questions.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if cells else ():
            for i, (w, limit) in enumerate(zip(_matrix(batch.column(1)), batch.column(2).to_pylist())):
                away = np.sqrt(((centres - w) ** 2).sum(axis=1))[own]
                bound = np.maximum(0, np.maximum(away - hi, lo - away))
                order = np.lexsort((away, bound))
                first = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                picked = order[:first] if limit is None else order[first:][bound[order[first:]] <= limit + SLACK]
                blocks = np.concatenate([names[j] + np.arange(pieces[j]) for j in picked.tolist()]) if len(picked) else np.zeros(0, "i8")
                if len(blocks):
                    row = batch.slice(i, 1).take(pa.array(np.zeros(len(blocks), "i8")))
                    yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array(blocks)], ["q", "w", "block"])

    return questions.select("q", "w", "limit").mapInArrow(run, f"q {q_type}, w array<double>, block long")


def _read(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``q, id, distance``: of each question the best ``k`` in each of its cells ``asked(q, w, block)``."""
    q_type, id_type = asked.schema["q"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    groups = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("groups"))
    groups = written(groups, "groups")
    nobody, nothing = F.lit(None).cast(q_type), F.lit(None).cast(id_type)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g")
    held = vectors.join(groups, "block").select("block", every, F.lit(0).alias("side"), nobody.alias("q"), "id", "v")
    asking = asked.join(groups, "block").select("block", F.pmod(F.xxhash64("q"), "groups").alias("g"), F.lit(1), "q", nothing, "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table, ids = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, g, side = (batch.column(i).to_numpy() for i in range(3))
            same = (block[1:] == block[:-1]) & (g[1:] == g[:-1]) & (side[1:] == side[:-1])
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(block)]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                if (block[start], g[start]) != now:
                    now, parts, table = (block[start], g[start]), [], None
                if side[start] == 0:
                    parts.append(part)
                    continue
                if table is None:
                    whole = pa.Table.from_batches(parts).combine_chunks() if parts else None
                    table, ids = (_matrix(whole.column("v").chunk(0)), whole.column("id").chunk(0)) if whole else (np.zeros((0, 1)), None)
                if not len(table):
                    continue
                q, rows, far = [], [], []
                for i, w in enumerate(_matrix(part.column(5))):
                    apart = np.sqrt(((table - w) ** 2).sum(axis=1))
                    # Ties at the k-th place stay; ``id`` decides when all cells are known.
                    best = np.flatnonzero(apart <= np.partition(apart, min(k, len(apart)) - 1)[min(k, len(apart)) - 1] + SLACK)
                    q.append(np.full(len(best), i))
                    rows.append(best)
                    far.append(apart[best])
                yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(np.concatenate(q))), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(far))], ["q", "id", "distance"])

    dealt = held.union(asking).repartition("block", "g").sortWithinPartitions("block", "g", "side")
    return dealt.mapInArrow(run, f"q {q_type}, id {id_type}, distance double")


def search(lists: Lists, queries: DataFrame, k: int = 10) -> DataFrame:
    """``q, rank, id, distance`` of the exact ``k`` nearest for each of ``queries(q, v)``."""
    asked = written(queries.where("v IS NOT NULL").select("q", normalised(F.col("v")).alias("w"), F.lit(None).cast("double").alias("limit")), "asked")
    first = written(_read(_chosen(asked, lists, k), lists.vectors, k), "first")
    far = Window.partitionBy("q").orderBy("distance")
    limits = first.withColumn("place", F.row_number().over(far)).where(F.col("place") == k).select(F.col("q").alias("of"), F.col("distance").alias("limit"))
    # With fewer than k vectors in all, the first cells are all cells.
    limited = asked.drop("limit").join(limits, F.col("q") == F.col("of")).select("q", "w", "limit")
    found = first.union(_read(_chosen(limited, lists, k), lists.vectors, k))
    best = Window.partitionBy("q").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("q", "rank", "id", "distance")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same over vectors that are in no lists yet."""
    return search(built(vectors), queries, k)
