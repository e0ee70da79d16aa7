"""Models that fail, repeat and fall back; calls are counted in files, as they run in other processes."""

import os
import uuid

from textquarry.operators import models
from textquarry.operators.index import Index

FILES = {"a.md": "# Zebra\nStripes here.\n" + "Line.\n" * 25, "b.md": "# Other\nWords.\n" + "Line.\n" * 25, "c.md": "# Zebra\nshort\n"}


def provider(folder, answer, fails=0, kind=models.Transient):
    """Writes down each call, and raises in the first ``fails`` calls of a batch."""

    def call(texts):
        seen = sum(name.startswith(str(hash(tuple(texts)) & 0xFFFFFF)) for name in os.listdir(folder))
        with open(f"{folder}/{hash(tuple(texts)) & 0xFFFFFF}-{uuid.uuid4().hex}", "w") as f:
            f.write("\0".join(texts))
        if seen < fails:
            raise kind("not now")
        return [answer(t) for t in texts]

    return call


def sent(folder):
    return [t for name in os.listdir(folder) for t in open(f"{folder}/{name}").read().split("\0")]


def test_equal_texts_are_sent_once_and_results_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    model = models.Model("m", provider(str(calls), str.upper), folder=f"file://{tmp_path}/results", batch=2)
    rows = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)] + [(99, None)], "key long, text string")
    got = {r.key: (r.result, r.error) for r in model.asked(rows).collect()}
    assert got == {i: (f"T{i % 5}", None) for i in range(40)} | {99: (None, None)}
    assert sorted(sent(calls)) == [f"t{i}" for i in range(5)]
    more = spark.createDataFrame([(1, "t1"), (2, "new")], "key long, text string")
    again = models.Model("m", provider(str(calls), str.lower), folder=f"file://{tmp_path}/results")
    assert {r.key: r.result for r in again.asked(more).collect()} == {1: "T1", 2: "new"}
    assert sorted(sent(calls)) == sorted([*[f"t{i}" for i in range(5)], "new"])


def test_failures_are_tried_again_and_errors_are_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one")], "key long, text string")
    for fails, kind, want, times in [(2, models.Transient, ("ONE", None), 3), (9, models.Transient, (None, "not now"), 3), (9, KeyError, (None, "'not now'"), 1)]:
        calls = tmp_path / f"calls{fails}{kind.__name__}"
        calls.mkdir()
        model = models.Model("m", provider(str(calls), str.upper, fails, kind), folder=f"file://{calls}-results", wait=0.01)
        assert [(r.result, r.error) for r in model.asked(rows).collect()] == [want] and len(sent(calls)) == times
    # What failed is asked again by the next run.
    calls = tmp_path / "later"
    calls.mkdir()
    healthy = models.Model("m", provider(str(calls), str.upper), folder=model.folder)
    assert [r.result for r in healthy.asked(rows).collect()] == ["ONE"]
    short = models.Model("short", lambda texts: [], folder=model.folder)
    assert [r.error for r in short.asked(rows).collect()] == ["0 results for 1 texts"]


def test_a_limit_leaves_the_rest_for_later(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    model = models.Model("s", provider(str(calls), lambda t: t.split("\n")[0]), folder=f"file://{tmp_path}/results")
    files = spark.createDataFrame([(f"p{i}", f"h{i}", "x\n" * 30, 30) for i in range(7)] + [("short", "h", "x", 1)], "path string, content_hash string, text string, loc long")
    seen = set()
    for n in (3, 6, 7):
        rows = models.file_summaries(files, model, most=3).collect()
        assert len(rows) == n and seen <= {r.target_path for r in rows}
        seen = {r.target_path for r in rows}
    assert all(r.content == r.target_path and r.scope == "file" for r in rows) and len(sent(calls)) == 7


def test_rerank_and_judge_fall_back(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    files = spark.createDataFrame([(p, t, str(i), t.count("\n")) for i, (p, t) in enumerate(FILES.items())], "path string, text string, content_hash string, loc long")
    index = Index.build(files)
    asked = spark.createDataFrame([(1, "zebra stripes")], "q long, question string")
    found = index.contexts(asked).collect()
    ranked = spark.createDataFrame(found, "q long, rank long, id long")
    ids = {r.rank: r.id for r in found}
    good = models.reranker(models.Model("good", provider(str(calls), lambda t: "2, 1")))
    bad = models.reranker(models.Model("bad", provider(str(calls), str, 9, ValueError)))
    order = lambda how: [r.id for r in index.reranked(asked, ranked, how, keep=2).orderBy("rank").collect()]
    assert order(good) == [ids[2], ids[1]] and order(bad) == [ids[1], ids[2]]
    answers = spark.createDataFrame([(1, "q", "e", "good"), (2, "q", None, None)], "q long, question string, expected string, text string")
    judge = models.Model("judge", provider(str(calls), lambda t: "Score: 2" if "good" in t else "no idea"))
    assert {r.q: (r.score, r.error) for r in models.judged(answers, judge).collect()} == {1: (2, None), 2: (None, None)}
    away = models.Model("away", provider(str(calls), str, 99), wait=0.01)
    assert {r.q: (r.score, r.error) for r in models.judged(answers, away).collect()} == {1: (None, "not now"), 2: (None, "not now")}


def test_embeddings_of_a_model(spark, tmp_path):
    model = models.Model("e", lambda texts: [[float(len(t)), 1.0] for t in texts], "array<double>", f"file://{tmp_path}/results")
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "id long, text string")
    assert {r.id: list(r.v) for r in models.embedded(texts, model).collect()} == {1: [3.0, 1.0], 3: [3.0, 1.0]}
