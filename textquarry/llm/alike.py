"""Near duplicates by the similarity of their shingles, found by wide SimHash fingerprints with pivot tables.

Two texts are alike if the Jaccard similarity of their sets of word shingles is ``SIMILARITY`` or more.

* **Candidates** are fingerprints of 512 bits within a Hamming distance, brought together by ``simhash.sampled_bands``; the
  bands' keys are made in numpy, and only rows whose key occurs again move.  Their links give *clusters*, in which more
  is linked than is alike.
* **Verification.**  Only texts in a cluster are read again.  Within a cluster pivot tables and then the fingerprints discard
  pairs, and the shingle sets of what is left are intersected, exactly up to 64-bit hashes of shingles.  A cluster is
  searched from one text outwards, which leaves a spanning forest of its verified links, not its pairs.
* **Large clusters and bands**, above ``GROUP`` texts or ``SHINGLES`` shingles, are dealt in blocks.  Each block is
  searched by itself together with the cluster's first text; then every text outside the cluster's largest component so
  found is compared with every block.  Texts inside that component are linked already, so no link is lost.

Defined cases: a null text counts as empty, and texts without words are alike; a text with fewer words than a shingle is
one shingle; a document without an identifier is compared with none; rows that share an identifier are one document;
rows may repeat; texts may be of any length; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if_small, filter_bit, filter_bits, membership, possible_members, written
from .components import stars

SIMILARITY = 0.8
#: Texts of a cluster, or of one of its blocks, that are searched together.
GROUP = 4096
#: Shingles of a cluster, or of one of its blocks, that are searched together.
SHINGLES = 1 << 22
#: Columns of a text in a search: its group, whether it asks (null: all are compared), and the component that it is in.
SOUGHT = ["key", "node", "asks", "comp"]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashed shingles, sorted; a text without words has one of its own."""
    return np.unique(simhash.hashed(simhash.shingles(text, shingle) or [b""]))


def _words(words: int) -> list[str]:
    return [f"f{j}" for j in range(words)]


def prints(docs: DataFrame, shingle: int, words: int, id_col: str, text_col: str, sets: bool) -> DataFrame:
    """``id, node, n, f0 ..., [grams]``: a node is one fingerprint and one set, of ``n`` shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "node", "n", *_words(words), *(["grams"] if sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sizes, fps, held = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = simhash.hashed(simhash.shingles(text.as_py() or b"", shingle))
                fp, own = simhash.majority(hashes, words), np.unique(hashes) if len(hashes) else shingle_set(b"", shingle)
                node.append(xxhash.xxh64_intdigest(fp.tobytes() + own.tobytes()) - (1 << 63))
                sizes.append(len(own))
                fps.append(fp)
                held.append(own.tobytes() if sets else None)
            table = np.array(fps, "<u8").reshape(-1, words)
            columns = [batch.column(0), pa.array(node, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(table[:, j].copy().view("<i8")) for j in range(words)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * sets, names)

    schema = ", ".join([f"id {id_type}", "node long", "n long", *[f"{f} long" for f in _words(words)], *(["grams binary"] if sets else [])])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def banded(nodes: DataFrame, words: int, masks: list[int]) -> DataFrame:
    """``node, f0 ..., keys``: a key for each mask, of the band and the bits under it."""
    picked = np.array([[mask >> 64 * j & (1 << 64) - 1 for j in range(words)] for mask in masks], "u8")
    odd = np.random.default_rng(simhash.SEED).integers(1 << 63, size=words, dtype="u8") * np.uint64(2) + np.uint64(1)
    shape = np.arange(len(masks), dtype="u8") * np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy().view("u8") for c in batch.columns[1:]], axis=1)
            keys = np.tile(shape, (len(fps), 1))
            for j in range(words):
                x = (fps[:, j, None] & picked[None, :, j]) * odd[j]
                keys = (keys ^ x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
            keys ^= keys >> np.uint64(32)
            ends = np.arange(0, keys.size + 1, len(masks), dtype="i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view("i8")))], [*batch.schema.names, "keys"])

    schema = ", ".join(["node long", *[f"{f} long" for f in _words(words)], "keys array<long>"])
    return nodes.select("node", *_words(words)).mapInArrow(run, schema)


class _Group:
    """Texts that are searched together; without shingle sets, a pair within the distance is linked."""

    def __init__(self, fps: np.ndarray, grams: list[bytes] | None, distance: int, similarity: float) -> None:
        self.fps, self.distance, self.similarity = fps, distance, similarity
        self.table = np.stack([simhash._distances(fps, p) for p in simhash.pivots(fps.shape[1])], axis=1)
        self.grams = None
        if grams is not None:
            sets = [np.frombuffer(g, "<u8") for g in grams]
            self.sizes = np.array([len(x) for x in sets])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            self.grams, self.marks = np.split(ids, np.cumsum(self.sizes)[:-1]), np.zeros(ids.max() + 1, bool)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        for p in range(self.table.shape[1]):
            others = others[np.abs(self.table[others, p] - self.table[x, p]) <= self.distance]
            if not len(others):
                return others
        others = others[simhash._distances(self.fps[others], self.fps[x]) <= self.distance]
        if self.grams is None or not len(others):
            return others
        self.marks[self.grams[x]] = True
        starts = np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]])
        both = np.add.reduceat(self.marks[np.concatenate([self.grams[i] for i in others])], starts, dtype="i8")
        self.marks[self.grams[x]] = False
        return others[both >= self.similarity * (self.sizes[others] + self.sizes[x] - both)]

    def forest(self) -> Iterator[tuple[int, int]]:
        left = np.arange(len(self.fps))
        while len(left) > 1:
            found, left = [left[0]], left[1:]
            while found and len(left):
                x = found.pop()
                reached = self.near(x, left)
                if len(reached):
                    yield from ((x, y) for y in reached.tolist())
                    found += reached.tolist()
                    left = np.setdiff1d(left, reached, assume_unique=True)

    def answers(self, asks: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of each asking text one link to every component that it has a link to."""
        others = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks).tolist():
            reached = self.near(x, others[comp[others] != comp[x]])
            for y in reached[np.unique(comp[reached], return_index=True)[1]].tolist():
                yield x, y


def _searched(rows: DataFrame, words: int, distance: int, similarity: float, sets: bool) -> DataFrame:
    """``(a, b)`` of the links found in the groups of ``rows(key, node, asks, comp, f0 ..., [grams])``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
            for start, stop in zip(edges, edges[1:]):
                if held and held[-1].column(0)[0].as_py() != key[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in whole(batches):
            if table.num_rows > 1:
                node, asks = table.column("node").to_numpy(), table.column("asks").to_pylist()
                fps = np.stack([table.column(f).to_numpy().view("u8") for f in _words(words)], axis=1)
                group = _Group(fps, table.column("grams").to_pylist() if sets else None, distance, similarity)
                pairs = group.forest() if asks[0] is None else group.answers(np.array(asks, bool), table.column("comp").to_numpy())
                for x, y in pairs:
                    a.append(node[x])
                    b.append(node[y])
            if len(a) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = [*SOUGHT, *_words(words), *(["grams"] if sets else [])]
    return rows.select(*columns).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame, words: int, distance: int, similarity: float, sets: bool) -> DataFrame:
    """Links of large groups, a *written* table ``rows(key, node, parts, f0 ..., [grams])``; ``parts`` is the number of
    blocks of a row's group."""
    own = [*_words(words), *(["grams"] if sets else [])]
    nothing = [F.lit(None).cast("boolean").alias("asks"), F.lit(None).cast("long").alias("comp")]
    block = F.pmod(F.xxhash64("node"), "parts")
    first = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("parts").alias("parts"))
    heads = rows.drop("parts").join(broadcast_if_small(written(first, "first")), "key").where("node = first").select("key", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), *own)
    members = rows.select("key", "node", block.alias("block"), *own)
    dealt = heads.union(members).select(F.xxhash64("key", "block").alias("key"), "node", *nothing, *own)
    inside = written(_searched(dealt, words, distance, similarity, sets), "inside")
    # Components of the links so far, within each group.
    joined = rows.select("key", "node", "parts").join(stars(inside).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    comps = written(joined.select("key", "node", "parts", F.coalesce("root", "node").alias("comp")), "comps")
    sizes = written(comps.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    cores = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("core"), F.sum("n").alias("n"), F.max("n").alias("inside"))
    cores = broadcast_if_small(written(cores.select("key", "core", F.ceil((F.col("n") - F.col("inside")) / GROUP).alias("asking")), "cores"))
    labelled = rows.join(comps.select("key", "node", "comp"), ["key", "node"]).join(cores, "key").where("asking > 0")
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    asking = labelled.where("comp <> core").select("key", "node", "comp", F.pmod(F.xxhash64(F.lit(7), "node"), "asking").alias("i"), each("parts", "j"), *own)
    asked = labelled.select("key", "node", "comp", block.alias("j"), each("asking", "i"), *own)
    met = lambda df, asks: df.select(F.xxhash64("key", "i", "j").alias("key"), "node", F.lit(asks).alias("asks"), "comp", *own)
    across = _searched(met(asking, True).union(met(asked, False)), words, distance, similarity, sets)
    return inside.union(across)


def _all_links(rows: DataFrame, sizes: DataFrame, words: int, distance: int, similarity: float, sets: bool) -> DataFrame:
    """Links of the groups of ``rows(key, node, f0 ..., [grams])``; ``sizes(key, parts)`` names those of more than one block."""
    nothing = [F.lit(None).cast("boolean").alias("asks"), F.lit(None).cast("long").alias("comp")]
    # Without sets a group is what ``simhash`` searches, many small ones at a time.
    plain = lambda df: _searched(df.select("*", *nothing), words, distance, similarity, True) if sets else simhash._linked(df.withColumn("band", F.lit(0)), words, distance)
    if sizes.isEmpty():
        return plain(rows)
    small = rows.join(broadcast_if_small(sizes), "key", "left_anti")
    large = written(rows.join(broadcast_if_small(sizes), "key"), "large")
    return plain(small).union(block_links(large, words, distance, similarity, sets))


def clusters(nodes: DataFrame, words: int, distance: int) -> DataFrame:
    """``node, cluster`` of the nodes that have another within ``distance``, up to what the bands miss."""
    masks = simhash.sampled_bands(distance, 64 * words, nodes.count())
    rows = banded(nodes, words, masks).select("node", *_words(words), F.explode("keys").alias("key"))
    groups = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    size = filter_bits(groups.count())
    met = possible_members(rows.withColumn("bit", filter_bit(F.col("key"), size)), membership(groups.select(filter_bit(F.col("key"), size).alias("bit"))))
    parts = F.ceil(F.col("n") / GROUP)
    large = written(groups.where(parts > 1).select("key", parts.alias("parts")), "parts")
    links = _all_links(met, large, words, distance, 0.0, False)
    roots = written(stars(links), "roots")
    return roots.union(roots.select("root", "root").distinct()).toDF("node", "cluster")


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 8, distance: int = 92, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row with an identifier ``id``, ``n`` (its distinct shingles) and ``component_id``, the smallest identifier that
    verified links reach."""
    docs = docs.where(F.col(f"`{id_col}`").isNotNull())
    own = written(prints(docs, shingle, words, id_col, text_col, False), "prints")
    nodes = written(own.groupBy("node").agg(*[F.first(f).alias(f) for f in _words(words)]), "nodes")
    cluster = written(clusters(nodes, words, distance), "clusters")
    # Written, so that joins have two plain shuffles and Spark can split them.
    ids = written(own.join(cluster, "node").groupBy("node", "cluster").agg(F.min("id").alias("chosen")), "chosen")
    again = docs.join(ids.select("chosen").distinct(), F.col(f"`{id_col}`") == F.col("chosen"), "left_semi")
    read = prints(again, shingle, words, id_col, text_col, True).drop("id", "n").dropDuplicates(["node"])
    texts = written(read.join(cluster, "node").withColumnRenamed("cluster", "key"), "texts")
    counted = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("grams") / 8).alias("grams"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("grams") / SHINGLES))
    large = written(counted.where(parts > 1).select("key", parts.alias("parts")), "parts")
    return simhash.named(own, written(_all_links(texts, large, words, distance, similarity, True), "links"), F.col("n")).withColumnRenamed("fp", "n")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The input's rows and columns: of each group of near duplicates the document with the smallest identifier."""
    return simhash.representatives(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **how), id_col)
