import random

import pytest

from textquarry.operators import retrieval, segments

WORDS = [f"w{i}" for i in range(40)] + ["get_user", "zebra", "é"]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, t and t.split(" ")[0], f"dir/{i % 3}.py") for i, t in texts.items()], "id long, content string, symbol_name string, path string")


def draw(rng, n):
    return {i: " ".join(rng.choice(WORDS[: rng.randint(3, len(WORDS))]) for _ in range(rng.randint(0, 30))) or None for i in range(n)}


def shown(df):
    return sorted((r.q, r.rank, r.id, round(r.score, 7)) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "zebra w1"), (2, "get_user w3 w3"), (3, "user get"), (4, ""), (5, "nothing"), (6, "w0 w1 w2 py dir")], "q long, question string")


def test_scores_equal_those_over_rows(spark, asked, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 8)
    rows = rows_of(spark, draw(random.Random(1), 150))
    assert shown(segments.Segments.of(rows).bm25(asked, 5)) == shown(retrieval.bm25(rows, asked, 5))


def test_refreshes_add_segments_and_tombstones(spark, asked, tmp_path, monkeypatch):
    """Changed, removed and new rows, one after the other, with merges, through storage: always as if built anew."""
    monkeypatch.setattr(segments, "BUCKET", 8)
    rng = random.Random(2)
    texts = draw(rng, 90)
    stored = segments.Segments.of(rows_of(spark, texts)).saved(f"file://{tmp_path}/index")
    number = 90
    for step in range(5):
        now = segments.Segments.opened(spark, stored)
        before = {p.path for p in now.parts}
        for _ in range(3):
            texts.pop(rng.choice(sorted(texts)))
            texts[number] = "zebra get_user w1 w0"
            number += 1
        rows = rows_of(spark, texts)
        now = now.refreshed(rows)
        if step == 0:
            assert len(now.parts) == 2 and now.parts[1].size == 3 and now.dead.count() == 3
        stored = now.saved(f"file://{tmp_path}/index")
        assert len({p.path for p in now.parts} - before) == 1
        now = segments.Segments.opened(spark, stored)
        assert shown(now.bm25(asked, 5)) == shown(retrieval.bm25(rows, asked, 5))
    assert len(now.parts) < 6
    assert now.refreshed(rows).parts == now.parts


def test_blocks_below_the_limit_are_not_read(spark, monkeypatch):
    """Buckets differ: in a few of them the word comes often in short rows."""
    monkeypatch.setattr(segments, "BUCKET", 8)
    texts = {i: "rare " + " ".join(f"x{i}y{j}" for j in range(60)) for i in range(400)}
    for i in (3, 150, 333):
        texts[i] = "rare rare rare"
    rows = rows_of(spark, texts).select("id", "content")
    asked = spark.createDataFrame([(1, "rare")], "q long, question string")
    made = segments.Segments.of(rows)
    search = segments._Search(made, asked, 1)
    first, _, rest = search.reading()
    blocks = made.blocks().where("term = 'rare'").count()
    read = first.count() + rest.count()
    assert blocks >= 45 and read <= 5
    assert shown(made.bm25(asked, 1)) == shown(retrieval.bm25(rows, asked, 1))


def test_rows_are_coded_as_differences(spark):
    rows = spark.createDataFrame([(i, "same word") for i in range(100)], "id long, content string")
    made = segments.Segments.of(rows)
    block = made.blocks().where("term = 'same'").first()
    assert sum(block.gaps) == 100 and set(block.gaps) == {1} and block.n == 100 and block.short == 2
    assert sorted(r.row for r in segments.decoded(made.blocks()).where("term = 'word'").collect()) == list(range(1, 101))


def test_empty(spark, asked):
    none = rows_of(spark, {1: "a"}).limit(0)
    made = segments.Segments.of(none)
    assert made.bm25(asked).collect() == []
    again = made.refreshed(rows_of(spark, {1: "zebra"}))
    assert {r.id for r in again.bm25(asked).collect()} == {1}
    assert again.refreshed(none).live().count() == 0
