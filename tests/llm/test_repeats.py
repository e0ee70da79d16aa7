import random
import re
from collections import Counter

from textquarry.llm.line_dedup import line_deduplicated
from textquarry.llm.substring_dedup import substring_deduplicated


def brute(rows, split, join, length, alone=None):
    """Every window against all earlier ones, rows in the order of identifiers, then texts; so too tokens of ``alone``
    words or more."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, found = set(), Counter()
    for i, text in order:
        tokens, gone = split(text or ""), set()
        windows = [tuple(tokens[s : s + length]) for s in range(len(tokens) - length + 1)]
        for s, w in enumerate(windows):
            if w in seen:
                gone.update(range(s, s + length))
            seen.add(w)
        for s, token in enumerate(tokens):
            if alone and len(words(token)) >= alone:
                if token in seen:
                    gone.add(s)
                seen.add(token)
        found[(i, len(tokens), len(gone), join(text or "", tokens, gone))] += 1
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def join_words(text, tokens, gone):
    return " ".join(w for i, w in enumerate(tokens) if i not in gone)


def lines(text):
    return [x for x in text.split("\n") if words(x)]


def join_lines(text, tokens, gone):
    at = iter(range(len(tokens)))
    return "\n".join(x for x in text.split("\n") if not (words(x) and next(at) in gone))


def found(df):
    return Counter((r.id, r.n_tokens, r.n_removed, r.kept_text) for r in df.collect())


def texts():
    rng = random.Random(4)
    passages = [[rng.choice("abcde") + str(rng.randrange(9)) for _ in range(rng.randrange(5, 90))] for _ in range(6)]
    made = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(1, 80)] + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 12))]
            parts += ["the"] * rng.randrange(0, 30)
        made.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return made + [(100, made[3][1]), (101, made[3][1]), (102, ""), (103, None)]


def test_words_against_brute_force(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    assert found(substring_deduplicated(df)) == brute(texts(), words, join_words, 20)
    assert found(substring_deduplicated(df, length=7, gram=3)) == brute(texts(), words, join_words, 7)


def test_lines_against_brute_force(spark):
    rows = [(i, t and t.replace(" ", "\n")) for i, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_deduplicated(df)) == brute(rows, lines, join_lines, 2, 5)
    assert found(line_deduplicated(df, length=5, alone=None)) == brute(rows, lines, join_lines, 5)
    rng = random.Random(7)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(25)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_deduplicated(df)) == brute(rows, lines, join_lines, 2, 5)
    assert found(line_deduplicated(df, length=3, alone=4)) == brute(rows, lines, join_lines, 3, 4)
    single = [(1, "one line of five words"), (2, "one line of five words"), (3, "short\nshort"), (4, "short")]
    assert {r.id: r.n_removed for r in line_deduplicated(spark.createDataFrame(single, "doc_id long, text string")).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_odd_rows(odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert substring_deduplicated(none).collect() == [] and line_deduplicated(none).collect() == []
    assert found(substring_deduplicated(odd)) == found(substring_deduplicated(clashing)) == brute(rows, words, join_words, 20)
    assert found(line_deduplicated(clashing)) == brute(rows, lines, join_lines, 2, 5)


def test_repeats_are_maximal_runs(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a b {passage} c"), (2, f"x {passage} y {passage[:-4]} z")]
    got = substring_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("id").collect()
    assert got[0].repeats == [] and got[0].kept_text == rows[0][1]
    assert [tuple(r) for r in got[1].repeats] == [(1, 30), (32, 60)] and got[1].kept_text == "x y z"
