"""SimHash near-duplicates with pivot distance tables.

* **Fingerprints.**  64 bits, or several words of 64, by majority over the XXH64 values of a text's word shingles;
  further words are mixed from those values.  Arrow batches.
* **Candidates.**  Equal bits under a mask, a *band*, bring distinct fingerprints together.
  - ``exact_bands``: fingerprints that differ in at most ``distance`` of ``distance + 3`` blocks of bits agree in three
    blocks at least, and every choice of three blocks is a band.  No link can be missed.
  - ``sampled_bands``, for distances too great for that (``alike``): so many random choices of bits, growing with the
    number of fingerprints, that a link at the full distance is missed with a probability of at most ``MISSED``.
* **Pivots.**  In each group a table of Hamming distances to many reference fingerprints is computed once.
  Distances to a reference differ by no more than the distance of two fingerprints, so a pair whose largest
  coordinate difference exceeds ``distance`` is discarded; the survivors are verified bit by bit.
* **Groups** are never expanded into pairs.  A group is searched from one member outwards: each fingerprint
  reached takes the ones it links to out of those left, which yields a spanning forest of the group's links.
* **Large groups**, above ``GROUP``, are banded again by the bits that are left, at most ``DEPTH`` times, so a row has a
  bounded number of copies whatever its group's size.  Exact bands cut the bits left into ``distance + 1`` blocks, one of
  which agrees in every link; at the last depth so few bits are left that no group can be large.  Groups of sampled
  bands are not banded again: ``alike.block_links`` deals them in blocks without losing a link.
* **Components** come from star contraction over the links.

Why pivots do not find candidates: distances to a reference concentrate.  Of two unrelated fingerprints the distances
to one pivot differ by 3 or less in 46 % of cases, so a key made of ``m`` pivots' cells would let ``0.46 ** m`` of
all pairs meet, while a row must visit about ``1.75 ** m`` cells so that no link at a cell's edge is lost.

Equal fingerprints (copies among them) are one node throughout.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other; a text with fewer words than a shingle is one shingle; a null identifier never names a component
unless all of its members lack one; rows may repeat; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, filter_bit, filter_bits, membership, possible_members, whole_rows, written
from .components import stars

SEED = 42
#: Fingerprints of a group that are searched together, and how often a larger group is banded again.
GROUP, DEPTH = 4096, 3
#: Reference fingerprints.
PIVOTS = 16
#: Shingles whose bits are counted at a time.
SLICE = 1 << 14
#: Sampled bands: the share of links at the full distance that may be missed, and the least number of bits of a band.
MISSED, LEAST_BITS = 0.15, 20
#: Candidates for five-word shingles and a Jaccard similarity of 0.8 or more: two texts at 0.8 differ in 78 of 512 bits
#: in the mean, with a deviation of 8.
WIDE = {"shingle": 5, "words": 8, "distance": 92}


def shingles(text: bytes, shingle: int) -> list[bytes]:
    """Word shingles of UTF-8 ``text``; a shorter text is one, an empty one has none.  ``bytes.lower`` changes A-Z only."""
    found = text.lower().split()
    if len(found) <= shingle:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*[found[i:] for i in range(shingle)])))


def hashed(grams: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", len(grams))


def further(hashes: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th word after the first of each shingle's bits: its hash moved on and mixed (splitmix64)."""
    x = hashes + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits that more than half of the hashes, or of the words made from them, have set."""
    ones = np.zeros(64 * words, "int64")
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        made = np.stack([part, *[further(part, j) for j in range(1, words)]], axis=1)
        ones += np.unpackbits(made.view("uint8"), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int = 3, words: int = 1) -> np.ndarray:
    """The fingerprint of UTF-8 ``text`` as unsigned words."""
    return majority(hashed(shingles(text, shingle)), words)


def _words(words: int) -> list[str]:
    return [f"f{j}" for j in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, the fingerprint's words ``f0``, ``f1`` ... as longs, and ``node``, one long for all of them."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle, words) for t in texts], "<u8").reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, j].copy().view("<i8")) for j in range(words)]], ["id", *_words(words)])

    schema = ", ".join([f"id {id_type}", *[f"{f} long" for f in _words(words)]])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
    return rows.withColumn("node", F.col("f0") if words == 1 else F.xxhash64(*_words(words)))


@dataclass
class Bands:
    """Masks of all bits of a fingerprint: those of the first depth, and from a mask those of the next."""

    masks: list[int]
    again: Callable[[int], list[int]]


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of about equal length of the given bits."""
    edges = np.linspace(0, len(bits), n + 1).astype(int)
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]


def exact_bands(distance: int, size: int = 64) -> Bands:
    left = lambda mask: [b for b in range(size) if not mask >> b & 1]
    first = [sum(three) for three in combinations(_blocks(list(range(size)), distance + 3), 3)]
    return Bands(first, lambda mask: [mask | block for block in _blocks(left(mask), distance + 1)])


def sampled_bands(distance: int, size: int, nodes: int) -> list[int]:
    draw = np.random.default_rng(SEED)
    bits = max(LEAST_BITS, nodes.bit_length())
    bands = math.ceil(math.log(MISSED) / math.log1p(-((1 - distance / size) ** bits)))
    return [sum(1 << int(b) for b in draw.choice(size, bits, replace=False)) for _ in range(bands)]


def _signed(mask: int, word: int) -> int:
    part = mask >> 64 * word & (1 << 64) - 1
    return part - (1 << 64) if part >> 63 else part


def _key(mask: int, words: int) -> Column:
    return F.xxhash64(*[F.col(f"f{j}").bitwiseAND(F.lit(_signed(mask, j))) for j in range(words) if _signed(mask, j)])


def _distances(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ other).sum(axis=-1, dtype="int16")


def pivots(words: int) -> np.ndarray:
    return np.array([[xxhash.xxh64_intdigest(b"pivot %d" % i, SEED + j) for j in range(words)] for i in range(PIVOTS)], "<u8")


def _forest(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever links within ``distance`` connect; ``table`` has the pivot distances."""
    links, left = [], np.arange(len(fps))
    while len(left) > 1:
        found, left = [left[0]], left[1:]
        while found and len(left):
            x = found.pop()
            near = left
            for p in range(table.shape[1]):
                near = near[np.abs(table[near, p] - table[x, p]) <= distance]
                if not len(near):
                    break
            near = near[_distances(fps[near], fps[x]) <= distance]
            if len(near):
                links += [(x, y) for y in near.tolist()]
                found += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def _group_links(groups: Iterator[tuple[np.ndarray, np.ndarray]], distance: int) -> Iterator[np.ndarray]:
    """Pairs of places for each run of whole groups ``(fps, starts)``."""
    for fps, starts in groups:
        references = pivots(fps.shape[1])
        table = np.stack([_distances(fps, p) for p in references], axis=1)
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        kept = two[np.abs(table[two] - table[two + 1]).max(axis=1, initial=0) <= distance]
        kept = kept[_distances(fps[kept], fps[kept + 1]) <= distance]
        pairs = [np.stack([kept, kept + 1], axis=1)]
        for a, b in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2]):
            found = _forest(fps[a:b], table[a:b], distance)
            if found:
                pairs.append(a + np.array(found))
        yield np.concatenate(pairs)


def _linked(rows: DataFrame, words: int, distance: int) -> DataFrame:
    """``(a, b)`` nodes of the links found in ``rows(band, key, node, f0 ...)``, group by group."""
    keys = ["band", "key"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups as they come, sorted; the last of a batch waits for its remaining rows."""
        held = np.zeros((0, 3 + words), "int64")
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype("int64") for c in batch.columns], axis=1)])
            starts = np.flatnonzero(np.concatenate([[True], (held[1:, :2] != held[:-1, :2]).any(axis=1)])) if len(held) else np.zeros(1, int)
            if len(starts) > 1:
                yield held[: starts[-1]], starts
                held = held[starts[-1] :]
        if len(held):
            yield held, np.array([0, len(held)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in whole(batches):
            fps = np.ascontiguousarray(held[:, 3:]).view("<u8")
            for pairs in _group_links(iter([(fps, starts)]), distance):
                yield pa.RecordBatch.from_arrays([pa.array(held[pairs[:, 0], 2]), pa.array(held[pairs[:, 1], 2])], ["a", "b"])

    dealt = rows.select(*keys, "node", *_words(words)).repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, words: int, distance: int, bands: Bands) -> DataFrame:
    """``(a, b)``: enough verified links between the distinct nodes ``(node, f0 ...)`` to connect every component."""
    masks = bands.masks
    rows = nodes.select("node", *_words(words), F.posexplode(F.array(*[_key(m, words) for m in masks])).alias("band", "key"))
    found: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        groups = written(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"), "groups")
        n, large = groups.agg(F.count(F.lit(1)), F.count_if(F.col("n") > GROUP)).first()
        size = filter_bits(n)
        both = F.xxhash64("band", "key")
        rows = possible_members(rows.withColumn("bit", filter_bit(both, size)), membership(groups.select(filter_bit(both, size).alias("bit"))))
        if not large or depth == DEPTH:
            found.append(_linked(rows, words, distance))
            break
        hot = broadcast_if_small(written(groups.where(F.col("n") > GROUP), "hot"))
        found.append(_linked(rows.join(hot, ["band", "key"], "left_anti"), words, distance))
        rows = written(rows.join(hot, ["band", "key"]), "rows")
        children = [(parent, m) for parent, mask in enumerate(masks) for m in bands.again(mask)]
        masks = [m for _, m in children]
        # A fixed number of masks, at most the first depth's times that of ``again`` to the power of the depth.
        table = nodes.sparkSession.createDataFrame([(parent, i, *[_signed(m, j) for j in range(words)]) for i, (parent, m) in enumerate(children)], "parent int, child int, " + ", ".join(f"m{j} long" for j in range(words)))
        key = F.xxhash64(F.col("child"), *[F.col(f"f{j}").bitwiseAND(F.col(f"m{j}")) for j in range(words)])
        rows = rows.join(F.broadcast(table), F.col("band") == F.col("parent")).select("node", *_words(words), F.col("child").alias("band"), key.alias("key"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def named(prints: DataFrame, links: DataFrame, fp: Column) -> DataFrame:
    """``id, fp, component_id`` for ``prints(id, node, ...)``: the smallest identifier that links of nodes reach."""
    roots = stars(links).withColumnRenamed("node", "of")
    rooted = prints.join(roots, prints.node == roots.of, "left").select("id", fp.alias("fp"), F.coalesce("root", "node").alias("root"))
    # Written, so that the join has two plain shuffles and Spark can split it at a very large component.
    least = written(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return rooted.join(least, "root").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, the 64-bit ``fp`` and ``component_id``, the smallest identifier that its links reach."""
    prints = written(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("node").agg(F.first("f0").alias("f0"))
    return named(prints, links(nodes, 1, distance, exact_bands(distance)), F.col("f0"))


def representatives(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The input's rows and columns: of each component of ``found`` the document with the smallest identifier.

    Rows that share an identifier are one document, and rows without one stay.
    """
    stay = found.where("id = component_id").select(F.col("id").alias("stay")).distinct()
    rows = whole_rows(docs, own=F.col(f"`{id_col}`"))
    with_id = rows.join(stay, rows.own == stay.stay, "left_semi")
    return with_id.union(rows.where("own IS NULL")).select("row.*")


def near_deduplicated(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of ``near_duplicates``."""
    return representatives(docs, near_duplicates(docs, shingle, distance, id_col, text_col), id_col)
