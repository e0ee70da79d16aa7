import random

import pytest

from textquarry.llm import alike

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def alike_pairs(rows, similarity=0.8):
    """All pairs of rows ``(id, text)`` that are alike."""
    sets = [(i, shingles(t)) for i, t in rows]
    return [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity]


def components(ids, pairs):
    label = {i: i for i in ids}
    for i, j in pairs:
        if label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if x == old else x for k, x in label.items()}
    return label


def near_copies(rng, n):
    """Texts and copies of them with words replaced."""
    made = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 500))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(2, 40) // 1000)):
            copy[at] = f"n{rng.randrange(5000)}"
        made.append((" ".join(words), " ".join(copy)))
    return made


def found(df):
    return {r.id: r.component_id for r in df.collect()}


def test_copies_around_the_threshold(spark):
    """No pair below it is joined, nearly all above are."""
    pairs = near_copies(random.Random(6), 300)
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = found(alike.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = [i for i, (a, b) in enumerate(pairs) if jaccard(shingles(a), shingles(b)) >= 0.8]
    assert 100 < len(want) < 280
    joined = [i for i in range(300) if got[2 * i + 1] == 2 * i]
    assert set(joined) <= set(want) and len(joined) / len(want) > 0.9
    assert all(c // 2 == i // 2 for i, c in got.items())


@pytest.mark.parametrize("group,grams", [(8, 1 << 22), (4096, 3000), (16, 5000)])
def test_large_groups_lose_no_link(spark, monkeypatch, group, grams):
    """Blocks far smaller than the groups: a core of near copies, chains that leave it, and texts that are not alike."""
    monkeypatch.setattr(alike, "GROUP", group)
    monkeypatch.setattr(alike, "SHINGLES", grams)
    rng = random.Random(5)
    one = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(90):
        copy = list(one)
        copy[i % 200] = f"v{i}"
        texts.append(copy)
    for start in (3, 50):
        chain = list(texts[start])
        for k in range(12):
            for at in rng.sample(range(200), 3):
                chain[at] = f"c{start}x{k}x{at}"
            texts.append(list(chain))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = components([i for i, _ in rows], alike_pairs(rows))
    got = found(alike.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=150))
    assert got == want
    kept = alike.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), distance=150)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pairs = alike_pairs(rows)
    want, got = components([i for i, _ in rows], pairs), found(alike.near_duplicates(docs))
    assert len(pairs) > 10 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())


def test_odd_rows(odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    kept = alike.near_deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2
    want = {c for c in components([i for i, _ in rows], alike_pairs(rows)).values()}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want
    assert {r.doc_id for r in alike.near_deduplicated(clashing).collect() if r.doc_id is not None} == want
    assert alike.near_deduplicated(none).collect() == []
