import re
import zlib
from collections import Counter

import pytest

from textquarry.llm import spelling

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The contract in plain Python: ``{word: (form, root, n, n_near, form_n)}``."""
    count = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, close in near.items():
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 200 and any(f for f, *_ in want.values())
    assert found(spelling.spelling_variants(docs)) == want


@pytest.mark.parametrize("group", [1, 3, 64])
def test_edits_chains_ties_and_large_groups(spark, group):
    """With a small ``group`` words pass to the larger alphabets, in the end to the letters themselves."""
    words = Counter({"spelling": 700, "speling": 130, "spelings": 25, "spelingz": 5, "colour": 60, "color": 99, "colours": 60, "ßtraße": 40, "straße": 8, "ztraße": 8, "aaaaaa": 30, "aaaaaaa": 6, "xyxyxy": 5, "yxyxyx": 5})
    words |= {f"gr{a}{b}upe": 5 + i for i, (a, b) in enumerate((a, b) for a in "aeiouxyz" for b in "aeiouxyz")}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_variants(docs, group=group)) == brute(rows)


def test_odd_rows(spark, odd, clashing, none):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(spelling.spelling_variants(odd)) == want == found(spelling.spelling_variants(clashing))
    assert spelling.spelling_variants(none).collect() == []


def test_long_words(spark):
    long = "ab" * 3_000
    rows = [(i, f"{long} {long}c {long[1:]}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_variants(docs)) == brute(rows)


def test_larger_alphabets_refine_smaller_ones():
    import numpy as np

    points = np.arange(0xC0, 0x100, dtype="u4")
    small, large = (spelling.reduced(points, k) for k in spelling.SYMBOLS[:2])
    assert len({*zip(large.tolist(), small.tolist())}) == len({*large.tolist()})
