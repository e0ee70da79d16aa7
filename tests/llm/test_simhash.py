from textquarry.llm import simhash


def brute(rows, shingle=3, distance=3):
    """Fingerprints by the definition and components by comparing all pairs."""
    import xxhash

    prints = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        grams = [b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))] if found else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        made = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        prints.append(made)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    return sorted((i if i is not None else -1, p, ids.get(c, -1)) for (i, _), p, c in zip(rows, prints, label))


def found(df):
    return sorted((r.id if r.id is not None else -1, r.fp % (1 << 64), r.component_id if r.component_id is not None else -1) for r in df.collect())


def test_odd_rows(odd, clashing):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(simhash.near_duplicates(odd)) == want
    assert found(simhash.near_duplicates(clashing)) == want


def test_empty(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.near_deduplicated(none).collect() == []


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dense_groups_are_cut_without_losing_links(spark, monkeypatch):
    """Chains of fingerprints in one hot band, with cells far smaller than the group."""
    import random

    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = random.Random(3)
    values = {0}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v, v) for v in signed], "node long, f0 long")
    links = simhash.links(nodes, 1, 3, simhash.exact_bands(3)).collect()
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) % (1 << 64)).bit_count() <= 3
        parent[root(a)] = root(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                assert root(a) == root(b)


def test_exact_bands_are_cut_so_that_every_link_has_one():
    import random

    rng, bands = random.Random(8), simhash.exact_bands(3)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), 3))
        masks = [m for m in bands.masks if not m & apart]
        for _ in range(simhash.DEPTH):
            assert masks
            masks = [m for mask in masks[:3] for m in bands.again(mask) if not m & apart]
        assert masks and all(m.bit_count() >= 48 for m in masks)


def test_one_document_of_each_component_stays(odd):
    kept = simhash.near_deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert set(ids) == {c for i, _, c in found(simhash.near_duplicates(odd)) if i == c and i >= 0}
    assert kept.where("doc_id IS NULL").count() == 2
