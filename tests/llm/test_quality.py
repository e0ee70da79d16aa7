import zlib

import numpy as np
from pyspark.sql import functions as F

from textquarry.llm import pu_quality, quality_rules, queries
from textquarry.llm.textstats import base_counts

SF = "/root/testdata/sf0.01"


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(again)


def test_base_counts():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 3, 4, 5, 40, 90]:
        for _ in range(8):
            text = "".join(rng.choice(["a ", "b ", "c\n", "é#", "\t", "漢 ", "\n", "x\x0b"], n))
            assert base_counts(text) == brute_base(text)


def test_rules_against_brute_force(spark):
    """The registered query against counts and ratios made text by text, by another path."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = queries.quality_labels(spark, "/root/testdata/sf0.001").where("label = 1")
    trusted = {r.id for r in labels.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def grams(text):
        data, found = text.encode(), []
        for i in range(len(data) - 3):
            h = data[i]
            for b in data[i + 1 : i + 4]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            found.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
        return np.array(found, int)

    each = {i: grams(t) for i, t in rows}
    raw = sum(np.bincount(g, minlength=1 << 16) for g in each.values())
    target = sum(np.bincount(each[i], minlength=1 << 16) for i in each if i in trusted)
    ratio = np.log((target + 4) / (target.sum() / raw.sum() * raw + 4))
    for r in queries.op4_quality_rules(spark, "/root/testdata/sf0.001").collect():
        text = dict(rows)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert abs(r.llr - ratio[each[r.doc_id]].mean()) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= -0.25)


def test_rules_keep_clean_and_drop_junk(spark):
    rows = queries.op4_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert rows.where("kept AND quality = 0 OR NOT kept AND quality = 1").count() == 0


def test_rules_odd_rows(odd, clashing, none):
    sure = odd.select(F.lit(6).cast("long").alias("id"))
    assert quality_rules.quality_rules(none, sure).collect() == []
    for df in (odd, clashing):
        rows = quality_rules.quality_rules(df, sure).collect()
        assert len(rows) == odd.count() and all(np.isfinite(r.llr) for r in rows)
    assert all(r.llr == 0 for r in quality_rules.quality_rules(odd, sure.where("false")).collect())


def test_classifier_on_held_out_labels(spark):
    rows = queries.op3_pu_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.99


def test_held_out_labels_are_never_used(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), queries.quality_labels(spark, "/root/testdata/sf0.001")
    turned = labels.withColumn("label", F.when(pu_quality.held_out(F.col("id")), 1 - F.col("label")).otherwise(F.col("label")))
    a, b = pu_quality.fit(docs, labels), pu_quality.fit(docs, turned)
    assert np.allclose(a.weights, b.weights) and np.isclose(a.prior, b.prior)
    lacking = pu_quality.fit(docs, labels.where("label = 1"))
    assert np.allclose(a.weights, lacking.weights)  # labels of another kind are not read


def test_risk_is_minimised():
    """Against gradient-free probing around the solution, and the second term is not negative."""
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((400, 1)), rng.normal(size=(400, 4))])
    p, u = x[:60] + np.array([0, 1, 0, 0, 0]), x
    prior = 0.6
    for offset in (-1.0, 0.3):
        w, second = pu_quality.minimised(p.T @ p, u.T @ u, prior, 0.01, offset)

        def risk(w):
            loss = lambda z: ((1 - z) ** 2 / 4).mean()
            return prior * loss(p @ w) + max(0, loss(-(u @ w)) - prior * loss(-(p @ w))) + 0.01 * w[1:] @ w[1:] / 4

        assert second > -1e-6 and w[0] == offset
        step = lambda s: np.concatenate([[0], rng.normal(size=4) * s])
        assert all(risk(w) <= risk(w + step(s)) + 1e-7 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_prior_of_a_mixture():
    """Positives and negatives that features tell apart, at several shares."""
    rng = np.random.default_rng(4)
    draw = lambda n, at: np.hstack([np.ones((n, 1)), np.abs(rng.normal(size=(n, 6)) * 0.2 + at)])
    good, bad = np.array([1, 1, 0, 0, 1, 0]), np.array([0, 0, 1, 1, 0, 1])
    for share in (0.2, 0.5, 0.9):
        u, p = np.vstack([draw(int(4000 * share), good), draw(4000 - int(4000 * share), bad)]), draw(800, good)
        assert abs(pu_quality.class_prior(p.T @ p, u.T @ u) - share) < 0.06


def brute_features(text, known):
    """The features by another path: counts in dictionaries, one gram and one word at a time."""
    import math
    import re
    from collections import Counter

    import xxhash

    data = (text or "").encode()
    words, mask = data.split(), (1 << 64) - 1
    hashed = [xxhash.xxh3_64_intdigest(w) for w in words]
    pairs = [(a * 0x9E3779B97F4A7C15 & mask ^ b) * 0x9E3779B97F4A7C15 & mask for a, b in zip(hashed, hashed[1:])]
    grams = []
    for i in range(len(data) - 3):
        h = data[i]
        for b in data[i + 1 : i + 4]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
        grams.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> 14)
    sketch = [0.0] * pu_quality.SKETCH
    for found in ([h >> 46 for h in hashed + pairs], grams):
        counts = Counter(found)
        length = math.sqrt(sum((1 + math.log(c)) ** 2 for c in counts.values()))
        for bucket, c in counts.items():
            sketch[pu_quality.PLACE[bucket]] += pu_quality.SIGN[bucket] * (1 + math.log(c)) / length / math.sqrt(2)
    familiarity = sum(known[g] for g in grams) / len(grams) if grams else 0.0
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    count = lambda pattern: len(re.findall(pattern, data))
    lines = [x for x in data.split(b"\n") if x.split()]
    repeated = brute_base(text)[4]
    stats = [count(rb"[#*$%&|<>]") / n, 5 * count(rb"[A-Z]") / chars, repeated / n, (len(lines) - len(set(lines))) / max(len(lines), 1), 1 - len(set(words)) / n, 5 * count(rb"[0-9]") / chars]
    stats += [count(rb"!") / n, sum(a == b for a, b in zip(words, words[1:])) / n, chars / n / 10, math.log1p(len(words)) / 10, n / max(len(lines), 1) / 50]
    surface = [1.0, *[min(max(s, 0), 1) for s in stats], *[float(s > e) for s in stats for e in (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)]]
    return np.array([1.0, *sketch, *[familiarity * s for s in surface]])


def test_query_against_brute_force(spark, odd):
    """Features, familiarity, moments and scores of the registered query, each made row by row."""
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    sure = {r.id for r in queries.quality_labels(spark, small).collect() if r.label == 1}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = np.zeros(1 << 18)
    for i, t in rows:
        if i in sure and not held(i):
            data = t.encode()
            for at in range(len(data) - 3):
                h = data[at]
                for b in data[at + 1 : at + 4]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
                counts[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 14] += 1
    share = counts / counts.sum()
    known = share / (share + 4 / 2**18)
    x = {i: brute_features(t, known) for i, t in rows}
    for r in odd.collect():
        if r.text is None or len(r.text) < 1000:
            assert np.allclose(pu_quality.features((r.text or "").encode(), known), brute_features(r.text, known))
    p = sum(np.outer(x[i], x[i]) for i, _ in rows if i in sure and not held(i))
    u = sum(np.outer(x[i], x[i]) for i, _ in rows if not held(i))
    weights, _ = pu_quality.minimised(p, u, pu_quality.class_prior(p, u))
    for r in queries.op3_pu_quality(spark, small).collect():
        assert abs(r.score - 1 / (1 + np.exp(-2 * (x[r.doc_id] @ weights)))) < 1e-6
        assert r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5)


def test_slices_of_long_texts_count_as_one(monkeypatch):
    from textquarry.llm import textstats

    data = " ".join(f"w{i % 977} {i % 31}" for i in range(40_000)).encode()
    known = np.random.default_rng(1).random(1 << 18)
    whole = pu_quality.features(data, known)
    monkeypatch.setattr(textstats, "SLICE", 1000)
    assert np.allclose(pu_quality.features(data, known), whole)


def test_scrambled_letters_score_low_and_scores_do_not_tie(spark):
    import random

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), queries.quality_labels(spark, SF)
    model, rng = pu_quality.fit(docs, labels), random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect() if r.text]
    other = [(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") if c.islower() else c for c in w) for w in t.split(" "))) for i, t in rows]
    score = lambda rows: [r.score for r in pu_quality.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert np.mean(np.array(score(rows)) >= 0.5) > 0.7 and np.mean(np.array(score(other)) >= 0.5) < 0.02
    scores = [r.score for r in pu_quality.scored(docs.dropDuplicates(["text"]), model).collect()]
    assert max(scores) < 1 and min(scores) > 0 and len({round(s, 9) for s in scores}) > 0.98 * len(scores)


def test_classifier_odd_rows(odd, clashing, none):
    labels = odd.select(F.col("doc_id").alias("id"), F.lit(1).alias("label"))
    for df in (odd, clashing):
        model = pu_quality.fit(df, labels)
        assert pu_quality.scored(df, model).count() == odd.count()
        kept = pu_quality.accepted(df, model)
        assert kept.columns == df.columns
    empty = pu_quality.fit(none, labels.where("false"))
    assert pu_quality.scored(none, empty).collect() == []
    assert {r.score for r in pu_quality.scored(odd, empty).collect()} == {0.5}
    assert pu_quality.accepted(odd, empty).count() == odd.count()
