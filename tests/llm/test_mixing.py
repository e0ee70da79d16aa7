import math
import re
from collections import defaultdict

import pytest

from textquarry.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight; whoever is above the cap stops there and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in done]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return done | {s: level * weight[s] for s in free}
        for s in above:
            done[s] = cap * sizes[s]
            left -= done[s]


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == len(docs)
    return sizes, want, taken


def test_odd_rows(odd, clashing, none):
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert mixing.mixture(none).collect() == [] and mixing.mixed(none).collect() == []
    for df in (odd, clashing):
        _, want, taken = check(mixing.mixture(df).collect(), docs)
        assert all(abs(taken[s] - want[s]) <= 2 for s in want)
        assert mixing.mixed(df).columns == df.columns


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mixture(docs).collect()
    sizes, want, taken = check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)  # exact to the word
    assert rows == mixing.mixture(docs.repartition(3)).orderBy("id").collect() or sorted(rows) == sorted(mixing.mixture(docs.repartition(3)).collect())
    words = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(words[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
