import numpy as np
import pytest

from textquarry.operators import vector_lists


def brute(vectors, queries, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    rows = [(i, unit(v)) for i, v in vectors if v is not None]
    out = []
    for q, w in queries:
        if w is not None:
            best = sorted((round(float(np.linalg.norm(v - unit(w))), 9), i) for i, v in rows)[:k]
            out += [(q, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(best)]
    return sorted(out)


def tables(spark, vectors, queries):
    return spark.createDataFrame(vectors, "id long, v array<float>"), spark.createDataFrame(queries, "q long, v array<float>")


def found(df):
    return sorted((r.q, r.rank, r.id, round(r.distance, 6)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vector_lists, "CELL", 16)
    monkeypatch.setattr(vector_lists, "ASKED", 8)


def clustered(n, dims, rng):
    centres = rng.normal(size=(8, dims))
    return [(i, (centres[i % 8] + 0.05 * rng.normal(size=dims)).astype("f4").tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "even"])
def test_equal_to_all_pairs(spark, small, kind):
    rng = np.random.default_rng(1)
    vectors = clustered(600, 8, rng) if kind == "clustered" else [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(400)]
    queries = vectors[::40] + [(10_000 + i, rng.normal(size=8).astype("f4").tolist()) for i in range(5)]
    assert found(vector_lists.nearest(*tables(spark, vectors, queries), k=7)) == brute(vectors, queries, 7)


def test_copies_zeros_nulls_and_few_rows(spark, small):
    """A third of all rows is one vector: its shell is cut in pieces, and ties go by number."""
    rng = np.random.default_rng(2)
    same = [0.5, 1.0, 0.0, 2.0]
    vectors = [(i, same) for i in range(80)] + [(100 + i, rng.normal(size=4).astype("f4").tolist()) for i in range(150)] + [(500, [0.0] * 4), (501, None), (502, [0.0] * 4)]
    queries = [(1, same), (2, [0.0] * 4), (3, None), (4, [1.0, 0.0, 0.0, 0.0])]
    v, q = tables(spark, vectors, queries)
    lists = vector_lists.built(v)
    assert found(vector_lists.search(lists, q, 5)) == brute(vectors, queries, 5)
    assert lists.vectors.groupBy("block").count().agg({"count": "max"}).first()[0] <= 40
    v, q = tables(spark, vectors[:3], queries)
    assert found(vector_lists.nearest(v, q, 5)) == brute(vectors[:3], queries, 5)
    v, q = tables(spark, [], queries)
    assert vector_lists.nearest(v, q, 5).collect() == []


def test_far_cells_are_not_read_and_the_plan_is_of_one_size(spark, small):
    rng = np.random.default_rng(3)
    vectors = clustered(1_000, 8, rng)
    v, few = tables(spark, vectors, vectors[:4])
    lists = vector_lists.built(v)
    blocks = lists.vectors.select("block").distinct().count()
    from pyspark.sql import functions as F

    asked = few.select("q", vector_lists.normalised(F.col("v")).alias("w"), F.lit(0.3).alias("limit"))
    read = vector_lists._chosen(asked, lists, 5).count() / 4
    assert blocks > 20 and read < 0.3 * blocks
    _, many = tables(spark, vectors, [(i, vectors[i % 1000][1]) for i in range(3_000)])
    plans = [vector_lists.search(lists, q, 5)._jdf.queryExecution().optimizedPlan().toString() for q in (few, many)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert not any("Cartesian" in p or "NestedLoop" in p for p in plans)


def test_centroids_of_a_sample_place_every_row(spark, small, monkeypatch):
    monkeypatch.setattr(vector_lists, "SAMPLE", 50)
    rng = np.random.default_rng(4)
    vectors = clustered(500, 6, rng)
    v, q = tables(spark, vectors, vectors[::50])
    lists = vector_lists.built(v)
    assert lists.vectors.count() == 500
    assert found(vector_lists.search(lists, q, 5)) == brute(vectors, vectors[::50], 5)
