"""Scores of texts under a byte model by context-tree weighting, beside a unigram score of their words.

* **Model.**  A byte is eight binary decisions, a walk through 255 nodes of a code tree.  Each node has a context tree of
  its own: contexts are the last 0 to ``DEPTH`` bytes.  At each context the training bits give a Krichevsky-Trofimov
  estimate; the weighted probability of a context is half its own estimate's plus half the product of its children's.
  So all depths are mixed, with weights that the training bits set.  Texts are preceded and ended by ``END``, a byte
  that UTF-8 does not have, so probabilities of all texts sum to one.
* **Counts.**  Texts come in blocks of bounded size.  Each block's distinct runs of ``DEPTH + 1`` bytes are counted as they
  are read and summed over the blocks by Spark; the contexts of the model grow with the corpus.
* **Weights.**  The longest contexts are weighed in shards of one context of ``SHARD`` bytes, bottom-up; shards have at
  most ``256 ** (DEPTH + 1 - SHARD)`` runs.  Shorter contexts are grouped by Spark, level by level.  Then the mixture is
  resolved from the shortest contexts down, which leaves one probability for each run of bytes.
* **Scoring.**  A block gets back the code lengths of just the runs it holds, by joins on the run and then on the block,
  and its texts are read through once against them.  Code lengths are fixed-point numbers, so sums do not depend on order.  No table of the model is broadcast or collected.

Words travel in the same tables, as 63-bit hashes (negative keys), with their training counts.

Defined cases: a null text counts as empty, and scores its end; a null identifier is hashed as an empty text, which
is in training; rows may repeat, and each counts; where no row is in training every estimate is a half; texts may be of
any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: Bytes of the longest context, at most 6; and of the context that makes a shard.
DEPTH, SHARD = 5, 3
END = 0xFF
#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 32 << 20
#: Runs of bytes counted, and weighed, at a time.
SLICE = 1 << 21
#: One identifier in so many, by its checksum, is held out: those with this remainder.
FOLDS, HELD = 7, 2
#: Fixed-point code lengths are multiples of one in so many of log10.
UNIT = 1 << 24
LN2, LN_PI = np.log(2), np.log(np.pi)

READ = "block long, id {id}, held boolean, text binary, n_bytes long, keys array<long>, counts array<long>"


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % FOLDS == HELD


def runs(text: bytes, depth: int = DEPTH) -> np.ndarray:
    """A text's runs of a byte, or its end, after its context, oldest byte first, as integers."""
    padded = np.frombuffer(bytes([END]) * depth + text + bytes([END]), "u1")
    found = np.zeros(len(text) + 1, "i8")
    for i in range(depth + 1):
        found = found << 8 | padded[i : i + len(found)]
    return found


def word_key(word: bytes) -> int:
    """A word's key, below zero.  The empty word is the end of a text."""
    return -1 - (xxhash.xxh64_intdigest(word) >> 1)


class _Counts:
    """Distinct keys of a block and how often training texts have them."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, "i8"), np.zeros(0, "i8")
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.words: dict[bool, Counter[bytes]] = {True: Counter(), False: Counter()}
        self.length = 0

    def _add(self, keys: np.ndarray, n: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(keys)).astype("i8")
        self.keys = keys

    def _settle(self) -> None:
        for held, parts in self.waiting.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                self._add(keys, n * (not held))
        self.waiting, self.length = {True: [], False: []}, 0

    def read(self, text: bytes, held: bool, depth: int) -> None:
        self.waiting[held].append(runs(text, depth))
        self.length += len(text) + 1
        self.words[held].update(text.split())
        self.words[held][b""] += 1
        if self.length > SLICE:
            self._settle()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        for held, words in self.words.items():
            n = np.fromiter(words.values(), "i8", len(words))
            self._add(np.fromiter(map(word_key, words), "i8", len(words)), n * (not held))
        return self.keys, self.n


def read_blocks(docs: DataFrame, depth: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of texts, lowered and packed, and after each block's texts rows of its keys and counts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, counts, names = TaskContext.get().partitionId() << 32, 0, _Counts(), ["block", "id", "held", "text", "n_bytes", "keys", "counts"]
        types = [pa.int64(), None, pa.bool_(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def closed(id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            keys, n = counts.done()
            for at in range(0, len(keys), SLICE >> 4):
                part = [[number], [None], [None], [None], [None], [keys[at : at + (SLICE >> 4)]], [n[at : at + (SLICE >> 4)]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t or id_kind) for x, t in zip(part, types)], names)

        pack, kind = zstandard.ZstdCompressor(level=1).compress, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for id_, held, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = (text.as_py() or b"").lower()
                if size and size + len(text) > block:
                    yield from closed(kind)
                    number, size, counts = number + 1, 0, _Counts()
                size += len(text) + 1
                counts.read(text, held, depth)
                row = [[number], [id_.as_py()], [held], [pack(text)], [len(text)], [None], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t or kind) for x, t in zip(row, types)], names)
        if size:
            yield from closed(kind)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(F.col(f"`{id_col}`")).alias("held"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, READ.format(id=id_type))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; small arguments are shifted first."""
    small = x < 8
    y = np.where(small, x + 8, x)
    product = np.ones(len(x))
    for i in range(8):
        product *= np.where(small, x + i, 1)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky and Trofimov's log probability of ``a`` zeros and ``b`` ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - LN_PI


def weighed(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the weight of the context's own estimate; ``below`` sums the children's logs."""
    own = log_kt(a, b)
    if below is None:
        return own, np.ones(len(a))
    both = np.logaddexp(own, below) - LN2
    return both, np.exp(own - LN2 - both)


class Tree:
    """The contexts of ``depth`` to ``top`` bytes of some shards, from their runs of bytes and training counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        context, symbol = keys >> 8, keys & 255
        self.bits = np.stack([symbol >> 7 - j & 1 for j in range(8)], axis=1)
        node = np.stack([context << 8 | 1 << j | symbol >> 8 - j for j in range(8)], axis=1).ravel()
        times, one = np.repeat(n, 8).astype(float), self.bits.ravel() == 1
        self.levels, below = [], None
        a, b = np.where(one, 0, times), np.where(one, times, 0)
        for d in range(depth, top - 1, -1):
            node, up = np.unique(node, return_inverse=True)
            a, b = np.bincount(up, a, len(node)), np.bincount(up, b, len(node))
            below = None if below is None else np.bincount(up, below, len(node))
            log, weight = weighed(a, b, below)
            self.levels.append((node, up, a, b, log, weight))
            below = log
            node = node & (1 << 8 * d) - 1  # without the oldest byte of the context

    def top(self) -> tuple[np.ndarray, ...]:
        """``node, a, b, log`` at the shortest context."""
        node, _, a, b, log, _ = self.levels[-1]
        return node, a, b, log

    def scores(self, node: np.ndarray, mixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each run's probability; given for the shortest contexts' nodes what shorter ones have mixed, and
        the weight that is left."""
        at = np.searchsorted(node, self.levels[-1][0], sorter=np.argsort(node))
        order = np.argsort(node)[at]
        mixed, rest = mixed[order], rest[order]
        for _, up, a, b, _, weight in reversed(self.levels):
            mixed, rest = mixed + rest * weight * (b + 0.5) / (a + b + 1), rest * (1 - weight)
            mixed, rest = mixed[up], rest[up]
        one = mixed.reshape(self.bits.shape)
        return np.log10(np.where(self.bits == 1, one, 1 - one)).sum(axis=1)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole shards, which come sorted, some ``SLICE / 8`` rows at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) < SLICE >> 3:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held = [[c[cut:] for c in columns]]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", *order)


def _tops(counts: DataFrame, depth: int, top: int) -> DataFrame:
    """``node, a, b, log`` of contexts of ``top`` bytes, for runs ``(shard, key, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in _whole_shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in Tree(key, n, depth, top).top()], ["node", "a", "b", "log"])

    return _dealt(counts.select("shard", "key", "n"), []).mapInArrow(run, "node long, a double, b double, log double")


def _level(rows: DataFrame) -> DataFrame:
    """``node, a, b, log, weight`` of contexts whose children's sums are ``(node, a, b, below)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, a, b, below = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, a, b, *weighed(a, b, below))], ["node", "a", "b", "log", "weight"])

    return rows.mapInArrow(run, "node long, a double, b double, log double, weight double")


def _mixtures(tops: DataFrame, top: int) -> DataFrame:
    """``node, mixed, rest`` for the contexts of ``top`` bytes: what all shorter contexts add to their mixture."""
    levels = [tops]
    for d in range(top - 1, -1, -1):
        shorter = F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1)
        levels.append(written(_level(levels[-1].groupBy(shorter.alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log").alias("below"))), f"level{d}"))
    above = None
    for d, level in enumerate(reversed(levels)):
        rows = level.select("*", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("rest"))
        if above is not None:
            shorter = F.col("node").bitwiseAND((1 << 8 * d) - 1)
            up = above.select(F.col("node").alias("up"), "mixed", "rest")
            rows = level.join(broadcast_if_small(written(up, "mixed")), shorter == F.col("up"))
        if d == top:
            return rows.select("node", "mixed", "rest")
        share = F.col("rest") * F.col("weight")
        above = rows.select("node", (F.col("mixed") + share * (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)).alias("mixed"), (F.col("rest") - share).alias("rest"))
    raise AssertionError


def probabilities(counts: DataFrame, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """``key, value``: log10 of the probability of each run's last byte after the bytes before, for a *written* table
    ``(key, n)`` of runs and training counts."""
    top = min(shard, depth)
    sharded = counts.select(F.shiftright("key", 8).bitwiseAND((1 << 8 * top) - 1).alias("shard"), "key", "n")
    mixtures = _mixtures(written(_tops(sharded, depth, top), "tops"), top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, key, n, mixed, rest in _whole_shards(batches):
            given = node >= 0
            tree = Tree(key[~given], n[~given], depth, top)
            yield pa.RecordBatch.from_arrays([pa.array(key[~given]), pa.array(tree.scores(node[given], mixed[given], rest[given]))], ["key", "value"])

    of = F.shiftright("node", 8).alias("shard")
    none, zero = F.lit(-1).cast("long"), F.lit(0.0)
    rows = mixtures.select(of, "node", none.alias("key"), none.alias("n"), "mixed", "rest").union(sharded.select("shard", none, "key", "n", zero, zero))
    return _dealt(rows, []).mapInArrow(run, "key long, value double")


class _Words(dict):
    """``log10(count + 1)`` of words, looked up once each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        super().__init__()
        self.keys, self.counts = keys, counts

    def __missing__(self, word: bytes) -> float:
        at = int(np.searchsorted(self.keys, word_key(word)))
        found = self[word] = log10(int(self.counts[at]) + 1)
        return found


class _Lengths:
    """Code lengths of a block's runs, by a slot of each run's hash; runs that share a slot are searched for.

    Only runs of the block are asked for, so a slot of one run needs no comparison."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(1, (8 * len(keys)).bit_length()))
        slots = self._slot(keys)
        self.table = np.zeros(1 << int(64 - self.shift), "i8")
        self.table[slots] = values
        self.table[slots[np.flatnonzero(np.bincount(slots, minlength=len(self.table))[slots] > 1)]] = -1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view("i8")

    def total(self, keys: np.ndarray) -> int:
        found = self.table[self._slot(keys)]
        shared = np.flatnonzero(found < 0)
        return int(found.sum()) + len(shared) + int(self.values[np.searchsorted(self.keys, keys[shared])].sum())


#: The key of texts, after those of all runs.
LAST = (1 << 63) - 1


def _scores(rows: DataFrame, id_type: str, depth: int, train: int, distinct: int) -> DataFrame:
    """Rows ``(block, key, value, row)`` of each block together, sorted: words, runs, texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, lengths, words = None, [], None, _Words(np.zeros(0, "i8"), np.zeros(0, "i8"))
        unpack, one = zstandard.ZstdDecompressor().decompress, log10(train + distinct + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            block, key, value, row = batch.columns
            block, key = block.to_numpy(), key.to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for start, stop in zip(edges, edges[1:]):
                if block[start] != now:
                    now, parts, lengths = block[start], [], None
                cut = start + int(np.searchsorted(key[start:stop], LAST))
                if cut > start:
                    parts.append((key[start:cut].copy(), value.slice(start, cut - start).to_numpy(zero_copy_only=False).astype("i8")))
                if cut == stop:
                    continue
                if lengths is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts))
                    first, parts = int(np.searchsorted(keys, 0)), []
                    lengths, words = _Lengths(keys[first:], values[first:]), _Words(keys[:first], values[:first])
                out = []
                texts = row.slice(cut, stop - cut)
                for text, n in zip(texts.field("text"), texts.field("n_bytes").to_pylist()):
                    text = unpack(text.as_py(), max_output_size=max(n, 1)) if n else b""
                    logs = [words[w] for w in text.split()] + [words[b""]]
                    out.append((len(logs), sum(x > 0 for x in logs), train, sum(logs) - one * len(logs), -lengths.total(runs(text, depth)) / UNIT, n))
                columns = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([texts.field("id"), texts.field("held"), *columns], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    return rows.repartition("block").sortWithinPartitions("block", "key").mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` for each row.

    ``score`` is log10 of the model's probability of the text, A-Z lowered, and ``bits_per_byte`` that code length for
    each byte and the end; ``base_score`` is that of the words and an end under counts with one added.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = written(read_blocks(docs, depth, block, id_col, text_col), "blocks")
    held = blocks.where("keys IS NOT NULL").select("block", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("block", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    counts = written(held.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("key < 0")
    train, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    # Written, so that the join below has two plain shuffles and Spark can split it.
    lengths = probabilities(counts.where("key >= 0"), depth, shard).select("key", F.round(-F.col("value") * UNIT).cast("long").alias("value"))
    values = written(lengths.union(words.select("key", "n")), "values")
    row = F.struct("id", "held", "text", "n_bytes")
    texts = blocks.where("keys IS NULL").select("block", F.lit(LAST).alias("key"), F.lit(0).cast("long").alias("value"), row.alias("row"))
    lookups = held.select("block", "key").join(values, "key").select("block", "key", "value", F.lit(None).cast(texts.schema["row"].dataType).alias("row"))
    rows = _scores(lookups.union(texts), id_type, depth, train, distinct)
    return rows.withColumn("bits_per_byte", -F.col("score") / F.lit(log10(2)) / (F.col("n_bytes") + 1))
