import zlib
from collections import Counter, defaultdict
from math import lgamma, log, log10

import numpy as np
import pytest

from textquarry.llm import context_trees as trees

SF = "/root/testdata/sf0.001"
END = 0xFF


def held(id_):
    return zlib.crc32(("" if id_ is None else str(id_)).encode()) % 7 == 2


def unigram(rows):
    """The contract's base score in plain Python."""
    train = Counter()
    texts = [(i, (t or "").encode().lower()) for i, t in rows]
    for i, t in texts:
        if not held(i):
            train.update([*t.split(), None])
    total, distinct = sum(train.values()), len(train)
    for i, t in texts:
        tokens = [*t.split(), None]
        yield i, held(i), len(tokens), sum(train[w] > 0 for w in tokens), total, sum(log10((train[w] + 1) / (total + distinct + 1)) for w in tokens)


class Weighting:
    """Context-tree weighting by its recursion, one context tree a node of the code tree."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            padded = bytes([END]) * depth + text + bytes([END])
            for i in range(len(text) + 1):
                context, symbol = padded[i : i + depth], padded[i + depth]
                for j in range(8):
                    node, bit = 1 << j | symbol >> (8 - j), symbol >> (7 - j) & 1
                    for d in range(depth + 1):
                        self.counts[context[depth - d :], node][bit] += 1
                        if d:
                            self.children[context[depth - d + 1 :], node].add(context[depth - d :])
        self.known = {}

    def kt(self, context, node):
        a, b = self.counts.get((context, node), (0, 0))
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)

    def log(self, context, node):
        at = context, node
        if at not in self.known:
            own = self.kt(*at)
            if len(context) < self.depth:
                below = sum(self.log(c, node) for c in self.children.get(at, ()))
                own = float(np.logaddexp(own, below)) - log(2)
            self.known[at] = own
        return self.known[at]

    def one(self, context, node, d=0):
        own = context[self.depth - d :]
        a, b = self.counts.get((own, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        weight = np.exp(self.kt(own, node) - log(2) - self.log(own, node))
        return weight * estimate + (1 - weight) * self.one(context, node, d + 1)

    def byte(self, context, symbol):
        p = 1.0
        for j in range(8):
            one = self.one(context, 1 << j | symbol >> (8 - j))
            p *= one if symbol >> (7 - j) & 1 else 1 - one
        return p

    def score(self, text):
        padded = bytes([END]) * self.depth + text + bytes([END])
        return sum(log10(self.byte(padded[i : i + self.depth], padded[i + self.depth])) for i in range(len(text) + 1))


ROWS = [(1, "the cat sat on the mat"), (2, "The Cat sat"), (3, None), (4, ""), (None, "abab abab"), (5, "émile était là 漢字"), (6, "the hat\n\nthe cat"), (7, " \t"), (8, "zzz"), (8, "zzz"), (9, "never seen words"), (11, "abcabcabc"), (13, "the cat"), (20, "mat hat")]


@pytest.mark.parametrize("depth,shard,block", [(5, 3, 1 << 20), (3, 2, 40), (1, 3, 10), (2, 1, 1)])
def test_scores_against_the_recursion(spark, depth, shard, block):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    found = trees.text_scores(docs, depth=depth, shard=shard, block=block).collect()
    model = Weighting([(t or "").encode().lower() for i, t in ROWS if not held(i)], depth)
    assert any(map(held, {i for i, _ in ROWS}))
    want = sorted((repr(x[0]), *x[1:5], round(x[5], 5), round(model.score((t or "").encode().lower()), 5)) for x, (_, t) in zip(unigram(ROWS), ROWS))
    assert sorted((repr(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in found) == want


def test_probabilities_of_all_next_bytes_sum_to_one():
    model = Weighting([b"abracadabra", b"banana"], 2)
    for context in (b"ab", b"na", b"zz", bytes([END, END])):
        assert abs(sum(model.byte(context, s) for s in range(256)) - 1) < 1e-9


def test_documents(spark):
    """Base columns by brute force; held-out code lengths far below those of a model without contexts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.id: r for r in trees.text_scores(docs).collect()}
    assert len(found) == len(rows)
    for id_, out, n, known, total, base in unigram(rows):
        r = found[id_]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total) and abs(r.base_score - base) < 1e-6 * abs(base)
    apart = [r for r in found.values() if r.held_out]
    bits = lambda rs: -sum(r.score for r in rs) / log10(2) / sum(r.n_bytes + 1 for r in rs)
    flat = {r.id: r for r in trees.text_scores(docs, depth=1).collect()}
    assert bits(apart) < 0.8 * bits([flat[r.id] for r in apart])
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in found.values())


def test_odd_rows(spark, odd, clashing, none):
    key = lambda r: (repr(r.id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5))
    plain = sorted(map(key, trees.text_scores(odd).collect()))
    assert len(plain) == odd.count() and plain == sorted(map(key, trees.text_scores(clashing).collect()))
    want = sorted((repr(i), n, k, round(b, 5)) for i, _, n, k, _, b in unigram([(r.doc_id, r.text) for r in odd.collect()]))
    assert [x[:4] for x in plain] == want
    assert trees.text_scores(none).collect() == []


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e4 + 0.5, 1e9]])
    assert np.allclose(trees._log_gamma(x), [lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
