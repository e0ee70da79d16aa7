"""Directories are summarised anew only above what changed."""

import random

from pyspark.sql import functions as F

from textquarry.operators import summaries

SCHEMA = "scope string, target_path string, content string, source_hash string"


def draw(rng, n):
    paths = set()
    while len(paths) < n:
        paths.add("/".join([rng.choice("abc") for _ in range(rng.randrange(4))] + [f"f{rng.randrange(40)}.py"]))
    return {p: f"About {rng.randrange(9)}." for p in paths}


def table(spark, files):
    return spark.createDataFrame([("file", p, c, f"h{c}") for p, c in files.items()], SCHEMA)


def shown(df):
    return sorted(map(tuple, df.select("scope", "target_path", "content", "source_hash").collect()), key=repr)


def test_equal_to_the_full_tree_after_edits(spark, monkeypatch):
    rng = random.Random(4)
    files = draw(rng, 60)
    now = spark.createDataFrame(summaries.hierarchy(table(spark, files), 3).collect(), SCHEMA)
    made = []
    combined = summaries.combined
    for step in range(4):
        before = dict(files)
        for p in rng.sample(sorted(files), 2):
            files.pop(p) if rng.random() < 0.5 else files.update({p: f"Changed {step}."})
        files |= draw(rng, 1)
        touched = {p for p in before.keys() | files.keys() if before.get(p) != files.get(p)}
        dirty = {"/".join(p.split("/")[:k]) or "." for p in touched for k in range(p.count("/") + 1)}
        monkeypatch.setattr(summaries, "combined", lambda rows, *a, **k: made.append(rows) or combined(rows, *a, **k))
        again = summaries.refreshed_hierarchy(now, table(spark, files), 3)
        monkeypatch.setattr(summaries, "combined", combined)
        assert shown(again) == shown(summaries.hierarchy(table(spark, files), 3))
        read = {r.dir for rows in made for r in rows.select("dir").distinct().collect()}
        whole = {p.rsplit('/', k)[0] if k else '.' for p in files for k in range(p.count('/') + 1)}
        assert read <= dirty and len(read) < len(whole)
        now, made = spark.createDataFrame(again.collect(), SCHEMA), []
    assert summaries.dirty_directories(now, now).isEmpty()


def test_a_users_summary_reads_a_bounded_text(spark):
    files = {f"d/f{i:03}.py": "Words." for i in range(300)}
    rows = summaries.hierarchy(table(spark, files), 1, lambda text: F.concat(F.length(text).cast("string"), F.lit("|"), F.substring(text, 1, 30)), most=100)
    got = {r.target_path: r.content for r in rows.where("scope <> 'file'").collect()}
    assert got["d"].startswith("100|d/f000.py: Words.\nd/f001.py")
    small = summaries.hierarchy(table(spark, {"a.py": "One.", "b.py": "Two."}), 0, lambda text: text)
    assert [r.content for r in small.where("scope = 'repo'").collect()] == ["a.py: One.\nb.py: Two."]
