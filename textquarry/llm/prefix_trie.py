"""Prefix trie of conversations: what they share, summed over subtrees by time-forward processing.

* **Order.**  Turns are range-sorted over all tasks; each task counts positions and sums prefix hashes (two polynomials
  modulo 2^64) of its own part, and one row a task tells the next where a conversation that goes on stands.  So a
  conversation of any length is read in parts.
* **Rebuilding.**  A conversation begins with the first turns of its hundred's first one, at most ``HEAD``, and goes on with
  its own later turns; prefix hashes of the result follow from those of the two.
* **Nodes** are distinct prefixes.  Counts and minima combine before they move.
* **Time-forward processing.**  Within a shard nodes come in reverse level order from Spark's external sort; a node takes the
  messages that its children left in a priority queue, and leaves its own totals there for its parent.  Queues spill sorted
  runs to anonymous files of their task.  A shard is a whole subtree: a node is *light* if its conversations' turns from
  there on are few, which bounds its subtree, and a shard hangs below each lightest-but-one node.
* **Across shard roots.**  Shard roots' totals are summed by parent and given to the heavy nodes above, which are cut in
  bands of levels.  Bands are shards again; then the bands' roots, one in ``BAND`` levels of the heavy nodes, pass their
  totals on among themselves, and with these each band is run once more.

Defined cases: a null role or text counts as empty; a null turn comes first; turns that tie go by role, then text; rows
may repeat, and each is a turn; rows without a conversation's identifier belong to none and are left out; conversations
may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

#: A conversation takes fewer than so many turns from the first of its ``EVERY``.
HEAD, EVERY = 6, 100
#: Bases of the two prefix hashes, odd and so with inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORD = 1 << 64
#: Least turns of a shard; levels of heavy nodes in a band; messages that a queue holds in memory.
LEAST, BAND, QUEUE = 4096, 1024, 1 << 18
#: Identifiers in a block that is hashed at once.
BLOCK = 1024

LOCAL = "part long, conv long, i long, a0 long, a1 long, p0 long, p1 long, size long, last boolean"
ROWS = "c long, d long, key binary, parent binary, size long, length long"


def head_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def _powers(base: int, start: int, n: int) -> np.ndarray:
    """``base ** start`` and the next ``n - 1`` powers modulo 2^64."""
    table = np.full(n, base, "u8")
    table[:1] = pow(base, start, WORD)
    return np.multiply.accumulate(table)


def _parts(turns: DataFrame) -> DataFrame:
    """Positions and prefix hashes within each task's part of a conversation; sorted turns come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, at, sums, held = TaskContext.get().partitionId(), None, 0, [0, 0], None
        names = [f.split()[0] for f in LOCAL.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, sizes = batch.column(0).to_numpy(), batch.column(3)
            n = len(convs)
            fresh = np.concatenate([[convs[0] != conv], convs[1:] != convs[:-1]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            i = np.where(first < 0, at + 1 + np.arange(n), np.arange(n) - first + 1)
            out, before = [], []
            for j, base in enumerate(BASES):
                turn = batch.column(1 + j).to_numpy().view("u8")
                power = np.where(first < 0, _powers(base, at + 1, n), _powers(base, 1, n)[np.where(first < 0, 0, i - 1)])
                total = np.cumsum(turn * power, dtype="u8")
                start = np.where(first <= 0, np.uint64(0), total[first - 1])
                run_sum = total - start + np.where(first < 0, np.uint64(sums[j]), np.uint64(0))
                out.append(run_sum)
                before.append(run_sum - turn * power)
                sums[j] = int(run_sum[-1])
            conv, at = convs[-1], int(i[-1])
            columns = [pa.array(np.full(n, part)), batch.column(0), pa.array(i), *[pa.array(x.view("i8")) for x in (*out, *before)], sizes, pa.array(np.zeros(n, bool))]
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays(columns, names)
        if held is not None:
            ends = np.zeros(held.num_rows, bool)
            ends[-1] = True
            yield held.set_column(held.num_columns - 1, "last", pa.array(ends))

    return turns.mapInArrow(run, LOCAL)


def _carried(local: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """Where the conversation stands that goes on at the start of a part: one row a task of the sort."""
    firsts = local.groupBy("part").agg(F.min("conv").alias("first"))
    ends = local.where("last").select("part", "conv", "i", "a0", "a1").join(firsts, "part").orderBy("part").collect()
    found: dict[int, tuple[int, int, int, int]] = {}
    state: tuple[int, int, int, int] | None = None
    for r in ends:
        mine = state if state is not None and state[0] == r.first else None
        if mine:
            found[r.part] = mine
        state = (r.conv, r.i, r.a0 % WORD, r.a1 % WORD)
        if mine and r.first == r.conv:
            state = (r.conv, mine[1] + r.i, *((mine[2 + j] + pow(base, mine[1], WORD) * state[2 + j]) % WORD for j, base in enumerate(BASES)))
    return found


def ordered(turns: DataFrame) -> DataFrame:
    """``conv, i, a0, a1, p0, p1, size``: each turn's place, its conversation's prefix hashes with it and before it, and its
    text's length, for ``turns(conv, turn, role, text)``."""
    order = ["conv", "turn", "role", "text"]
    hashed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = hashed.select("conv", F.xxhash64("role", "text").alias("t0"), F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.char_length("text").cast("long").alias("size"))
    local = written(_parts(hashed), "parts")
    carried = _carried(local)
    if not carried:
        return local.drop("part", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, i = (batch.column(k).to_numpy().copy() for k in range(3))
            sums = [batch.column(k).to_numpy().view("u8").copy() for k in range(3, 7)]
            for p in np.unique(part).tolist():
                if p in carried:
                    own, at, *state = carried[p]
                    goes_on = (part == p) & (conv == own)
                    for k, x in enumerate(sums):
                        x[goes_on] = np.uint64(state[k % 2]) + np.uint64(pow(BASES[k % 2], at, WORD)) * x[goes_on]
                    i[goes_on] += at
            yield pa.RecordBatch.from_arrays([pa.array(conv), pa.array(i), *[pa.array(x.view("i8")) for x in sums], batch.column(7)], ["conv", "i", "a0", "a1", "p0", "p1", "size"])

    return local.mapInArrow(run, "conv long, i long, a0 long, a1 long, p0 long, p1 long, size long")


def _keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    packed = np.stack([a, b], axis=1).astype(">u8").tobytes()
    return [packed[k : k + 16] for k in range(0, len(packed), 16)]


def rebuilt(places: DataFrame) -> DataFrame:
    """``c, d, key, parent, size, length``: every prefix of every rebuilt conversation, for *written* ``places``.

    ``size`` is the length of its last text and ``length`` the number of turns of the whole."""
    early = places.where(F.col("i") < HEAD)
    turn = F.struct("i", "a0", "a1", "p0", "p1", "size")
    # At most HEAD - 1 turns a conversation.
    heads = early.where(F.col("conv") % EVERY == 0).groupBy(F.col("conv").alias("of")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    h = head_turns(F.col("conv"))
    convs = places.groupBy("conv").agg(F.max("i").alias("m"), F.max(F.when(F.col("i") == h, F.struct("a0", "a1"))).alias("cut"))
    convs = convs.join(heads, F.col("conv") - F.col("conv") % EVERY == F.col("of"), "left").select("conv", h.alias("h"), "m", "cut", F.slice(F.coalesce("head", F.array().cast(f"array<{heads.schema['head'].dataType.elementType.simpleString()}>")), F.lit(1), h.cast("int")).alias("head"))
    k = F.size("head")
    tip = F.when(k > 0, F.element_at("head", -1))
    convs = convs.select("*", k.cast("long").alias("k"), (k + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("length"), *[F.coalesce(tip[f"a{j}"], F.lit(0)).alias(f"h{j}") for j in (0, 1)], *[F.coalesce(F.col("cut")[f"a{j}"], F.lit(0)).alias(f"c{j}") for j in (0, 1)])
    convs = written(convs.drop("cut"), "conversations")
    zero = F.lit(0).cast("long")
    # The textless prefix and the turns of the head are as they stand: nothing to shift.
    starts = convs.select(F.col("conv").alias("c"), "length", F.explode(F.concat(F.array(F.struct(zero.alias("i"), zero.alias("a0"), zero.alias("a1"), zero.alias("p0"), zero.alias("p1"), zero.alias("size"))), "head")).alias("t"))
    still = starts.select("c", F.col("t.i").alias("d"), "t.a0", "t.a1", "t.p0", "t.p1", "t.size", "length", zero.alias("h"), zero.alias("k"), *[zero.alias(x) for x in ("h0", "h1", "c0", "c1")])
    own = places.join(convs.drop("head", "m"), "conv").where("i > h")
    moved = own.select(F.col("conv").alias("c"), F.col("i").alias("d"), "a0", "a1", "p0", "p1", "size", "length", "h", "k", "h0", "h1", "c0", "c1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array([[pow(base, j, WORD) for j in range(-HEAD, HEAD + 1)] for base in BASES], "u8")
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, (c.to_numpy() for c in batch.columns)))
            by, u = columns["k"] - columns["h"], lambda name: columns[name].view("u8")
            at = lambda x, j: u(f"h{j}") + shift[j][by + HEAD] * (u(f"{x}{j}") - u(f"c{j}"))
            d = columns["d"] + by
            parents = [None if n == 0 else p for n, p in zip(d.tolist(), _keys(at("p", 0), at("p", 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), pa.array(_keys(at("a", 0), at("a", 1)), pa.binary()), pa.array(parents, pa.binary()), batch.column("size"), batch.column("length")], ["c", "d", "key", "parent", "size", "length"])

    return still.union(moved).mapInArrow(run, ROWS)


class SpillingQueue:
    """A priority queue of tuples; above ``most`` in memory they go to an anonymous file as a sorted run."""

    def __init__(self, most: int) -> None:
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, file)
            file.seek(0)
            self.heap = []
            self._read(file)

    def _read(self, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), id(file), file))
        except EOFError:
            file.close()

    def least(self) -> tuple | None:
        return min((x for x in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if x is not None), default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, file = heapq.heappop(self.runs)
            self._read(file)
            return item
        return heapq.heappop(self.heap)


def passed_up(nodes: DataFrame, most: int = QUEUE) -> DataFrame:
    """``key, leaves, saved``: totals of each node's subtree within its shard, for ``nodes(shard, level, key, parent, above,
    leaves, saved)`` with their own amounts; ``above`` is the parent's level, null where it is in another shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(most)
        for batch in batches:
            totals = []
            for shard, level, key, parent, above, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                me = (shard, -level, key)
                while (first := queue.least()) is not None and first[:3] <= me:
                    _, _, _, more, kept = queue.pop()
                    leaves, saved = leaves + more, saved + kept
                totals.append((key, leaves, saved))
                if above is not None:
                    queue.push((shard, -above, parent, leaves, saved))
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*totals), (pa.binary(), pa.int64(), pa.int64()))], ["key", "leaves", "saved"])

    dealt = nodes.select("shard", "level", "key", "parent", "above", "leaves", "saved").repartition("shard").sortWithinPartitions("shard", F.desc("level"), "key")
    return dealt.mapInArrow(run, "key binary, leaves long, saved long")


def _given(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes with what the roots of shards below, ``totals(parent, leaves, saved)``, add to their own amounts."""
    sums = written(totals.groupBy(F.col("parent").alias("to")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("kept")), "messages")
    both = nodes.join(sums, F.col("key") == F.col("to"), "left")
    return both.withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("kept", F.lit(0))}).drop("to", "more", "kept")


def subtree_totals(nodes: DataFrame, rows: DataFrame, least: int = LEAST, band: int = BAND, most: int = QUEUE) -> DataFrame:
    """``key, leaves, saved`` of the whole subtree of each node, for *written* ``nodes(key, conv_id, depth, parent, weight,
    leaves, saved)`` and the *written* prefixes ``rows(c, d, key)`` of their conversations."""
    bound = max(least, math.isqrt(nodes.count()))
    heavy = written(nodes.where(F.col("weight") > bound), "heavy")
    level = nodes.withColumns({"level": F.col("depth"), "above": F.col("depth") - 1})
    # The first light prefix of each conversation is the root of its shard.
    keys = broadcast_if_small(heavy.select("key"))
    tops = written(rows.join(keys, "key", "left_anti").groupBy("c").agg(F.min_by("key", "d").alias("shard")), "tops")
    light = level.where(F.col("weight") <= bound).join(tops, F.col("conv_id") == F.col("c"))
    inside = lambda df: df.withColumn("above", F.when(F.col("key") != F.col("shard"), F.col("above")))
    below = written(passed_up(inside(light), most), "light")
    roots = below.join(light.where(F.col("key") == F.col("shard")).select("key", "parent"), "key").where("parent IS NOT NULL")
    level_heavy = level.where(F.col("weight") > bound)
    starts = rows.where(F.col("d") % band == 0).select("c", F.col("d").alias("from"), F.col("key").alias("shard"))
    bands = level_heavy.join(starts, (F.col("conv_id") == F.col("c")) & (F.col("depth") - F.col("depth") % band == F.col("from")))
    bands = written(_given(inside(bands), roots), "bands")
    totals = passed_up(bands, most)
    if not bands.where(F.col("depth") >= band).isEmpty():
        # Bands' roots among themselves, then each band with what comes from the roots below it.
        part = bands.where(F.col("key") == F.col("shard")).select("key", "depth", "parent").join(written(totals, "within"), "key")
        over = bands.select(F.col("key").alias("at"), F.col("shard").alias("over"))
        joined = written(part.join(over, F.col("parent") == F.col("at"), "left"), "joined")
        whole = passed_up(joined.select(F.lit(b"").alias("shard"), (F.col("depth") / band).cast("long").alias("level"), "key", F.col("over").alias("parent"), F.when(F.col("over").isNotNull(), (F.col("depth") / band).cast("long") - 1).alias("above"), "leaves", "saved"), most)
        from_below = whole.join(joined.select("key", "parent"), "key").where("parent IS NOT NULL")
        totals = passed_up(_given(bands, from_below), most)
    return below.union(totals)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``key, digest``: SHA-256 of the ascending, comma-joined numbers ``c`` of each key."""
    listed = lambda batches: (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(listed(batches), key=lambda r: r[0]):
            while block := [r[1] for r in islice(rows, BLOCK)]:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([block[0]]), pa.array([",".join(map(str, block))])], ["key", "low", "numbers"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(listed(batches), key=lambda r: r[0]):
            state = hashlib.sha256()
            for n, (_, _, numbers) in enumerate(rows):
                state.update((b"," if n else b"") + numbers.encode())
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "digest"])

    blocks = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(packed, "key binary, low long, numbers string")
    # One task reads a key's blocks in order, as its digest is that of all its numbers; it holds one batch of them.
    return blocks.repartition("key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key binary, digest string")


def prefix_trie(conversations: DataFrame, least: int = LEAST, band: int = BAND, most: int = QUEUE) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node of the trie of
    the rebuilt conversations of ``conversations(conv_id, turn, role, text)``."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role"), text("text"))
    rows = written(rebuilt(written(ordered(turns), "places")), "rows")
    first = [F.first(x).alias(x) for x in ("parent", "size")]
    weight = F.sum(F.col("length") - F.col("d") + 1).alias("weight")
    found = rows.groupBy("key").agg(F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), weight, *first)
    found = written(found, "prefixes")
    kids = written(found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children")), "kids")
    counted = found.join(kids, F.col("key") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}
    nodes = written(counted.withColumns(own), "nodes")
    totals = written(subtree_totals(nodes, rows.select("c", "d", "key"), least, band, most), "totals")
    ends = written(ends_digests(rows.where("d = length").select("key", "c")), "ends")
    parents = nodes.select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("leaves", "saved").join(totals, "key").join(ends, "key", "left").join(parents, F.col("parent") == F.col("of"), "left")
    digest = F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest)
