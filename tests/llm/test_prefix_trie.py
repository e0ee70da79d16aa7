import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from textquarry.llm import prefix_trie as tries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract in plain Python, from lists of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_conversations_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(tries.prefix_trie(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def tangled():
    """Shared beginnings of all depths, copies, a conversation of very many turns, and odd identifiers."""
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(190, 230), *range(-120, -90), 10**12 + 7]:
        for turn in range(draw.randint(1, 9)):
            rows.append((c, turn, draw.choice(["user", "user", "bot"]), draw.choice(["a", "a", "a", "bb", "漢字"])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(7)]
    rows += [(400, t, "user", f"long {t}") for t in range(300)] + [(401, t, "user", f"long {t}") for t in range(250)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("least,band,most", [(1, 1, 1), (3, 4, 2), (50, 7, 1000), (10**6, 1024, 10)])
def test_shards_bands_and_spilling_queues(spark, tangled, least, band, most):
    df = spark.createDataFrame(tangled, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that long conversations lie in several parts
    try:
        assert found(tries.prefix_trie(df, least, band, most)) == brute(tangled)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "", ""), (None, 1, "user", "lost"), (0, 1, "user", "x" * 50_000), (3, -1, "user", "neg")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert found(tries.prefix_trie(df)) == want
    names = "key parent conv c d i size weight shard level leaves saved length part".split()
    from pyspark.sql import functions as F

    assert found(tries.prefix_trie(df.select("*", *[F.lit("x").alias(n) for n in names]))) == want
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_in_many_parts(spark):
    """Positions and hashes of a conversation that fills several tasks go on from one to the next."""
    rows = [(7, t, "user", f"t{t % 13}") for t in range(5_000)] + [(8, 0, "user", "t0")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = tries.ordered(df.withColumnRenamed("conv_id", "conv"))
        assert sorted(r.i for r in places.where("conv = 7").collect()) == list(range(1, 5_001))
        assert found(tries.prefix_trie(df, 10, 16, 5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
