from collections import Counter

from pyspark.sql import functions as F

from textquarry.llm import exact_dedup as op


def brute(rows, pick):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    keep = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""]) for i, t in rows)


def found(df, **how):
    return Counter((r.id, r.keep_id, r.group_size, r.kept) for r in op.exact_groups(df, **how).collect())


def test_odd_rows(odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert op.exact_groups(none).collect() == [] and op.deduplicated(none).collect() == []
    assert found(odd) == brute(rows, min)
    assert found(clashing, keep="largest") == brute(rows, max)


def test_bytes_decide_where_digests_collide(odd):
    """A digest of two bits stands for many texts; the result is that of the texts."""
    weak = lambda t: F.unhex(F.lpad(F.hex(F.crc32(t.cast("binary")) % 4), 2, "0"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, digest=weak) == brute(rows, min)
    assert found(odd, digest=weak, keep="largest") == brute(rows, max)


def test_one_row_of_each_text_stays(odd, clashing):
    for df in (odd, clashing):
        kept = op.deduplicated(df)
        assert kept.columns == df.columns
        texts = [r.text or "" for r in kept.collect()]
        assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in odd.collect()}


def test_a_second_batch_is_looked_up_in_the_stored_levels(spark, tmp_path, monkeypatch):
    """Batches of many sizes against counting by hand, the index reopened for each; few hits are pushed, many joined."""
    import random

    rng = random.Random(2)
    texts = [None, ""] + [f"text {i}" for i in range(60)]
    folder, done, next_id = f"file://{tmp_path}/index", [], 1000
    for n, pushed in ((40, 500), (3, 500), (5, 0), (1, 500), (60, 0), (0, 500)):
        monkeypatch.setattr(op, "PUSHED", pushed)
        batch = []
        for _ in range(n):
            next_id += rng.choice([-3, 1, 1, 7])
            batch.append((next_id, rng.choice(texts)))
        df = spark.createDataFrame(batch, "doc_id long, text string")
        stored = spark.createDataFrame(done, "doc_id long, text string")
        got = Counter((r.id, r.keep_id, r.group_size, r.kept) for r in op.MergeIndex(spark, folder).add(df, stored).collect())
        done += batch
        groups = {}
        for i, t in done:
            groups.setdefault(t or "", []).append(i)
        assert got == Counter((i, min(groups[t or ""]), len(groups[t or ""]), i == min(groups[t or ""])) for i, t in batch)
    index = op.MergeIndex(spark, folder)
    assert Counter((r.keep_id, r.n) for r in index.keepers().collect()) == Counter((min(g), len(g)) for g in groups.values())
    sizes = [rows for _, rows in index.levels()]
    assert all(b >= op.FANOUT * a for a, b in zip(sizes, sizes[1:]))
    plan = spark.read.parquet(f"{index.levels()[-1][0]}/digests").where(F.col("digest").isin([b"1" * 32]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(digest" in plan or "PushedFilters: [IsNotNull(digest), EqualTo(digest" in plan


def test_two_texts_of_one_digest_are_no_silent_hit(spark, tmp_path):
    import pytest

    weak = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 2, "0"))
    index = op.MergeIndex(spark, f"file://{tmp_path}/index", weak)
    first = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    index.add(first)
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(2, "cd")], "doc_id long, text string"), first)
    assert len(index.levels()) == 1
