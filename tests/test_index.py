"""The index end to end: each question goes the way of its route, and contexts follow calls."""

from textquarry.operators.index import Index

FILES = {
    "src/auth.py": "import os\nfrom src import crypto\n\n\ndef verify_password(given):\n    \"Checks a password against its stored hash.\"\n    return derive_key(given)\n",
    "src/crypto.py": "import hashlib\n\n\ndef derive_key(secret):\n    return hashlib.sha256(secret).hexdigest()\n",
    "src/app.py": "from fastapi import FastAPI\napp = FastAPI()\n\n\n@app.get('/login')\ndef login(user):\n    return verify_password(user)\n",
    "requirements.txt": "fastapi>=0.1\npytest\n",
    "README.md": "# Keys\nThis service keeps zebra keys safe. It is small.\n\n## Use\nRun the zebra tool.\n" + "More text.\n" * 20,
    "web/a.js": "function zebraLine() { return 1 }\n",
}


def build(spark):
    rows = [(p, t, str(hash(t)), t.count("\n")) for p, t in FILES.items()]
    return Index.build(spark.createDataFrame(rows, "path string, text string, content_hash string, loc long"))


def test_questions_go_their_ways(spark, tmp_path):
    index = build(spark).saved(f"file://{tmp_path}/index")
    asked = {1: "which packages are used", 2: "list the endpoints", 3: "Where is `derive_key` defined?", 4: "where is the zebra thing", 5: "what does this repo do", 6: "how does the zebra tool run"}
    got = {r.q: r for r in index.answered(spark.createDataFrame(list(asked.items()), "q long, question string")).collect()}
    assert [got[q].route for q in sorted(got)] == ["dependencies", "endpoints", "locate", "locate", "overview", "explain"]
    assert got[1].text == "**requirements.txt** [requirements.txt:1-1] — 2 dependencies: fastapi (>=0.1), pytest"
    assert got[2].text == "1 endpoint(s):\n\n- `GET /login` -> `login` [src/app.py:5-5]"
    assert got[3].text == "`derive_key` (function) is defined in [src/crypto.py:4-5]"
    assert "README.md:" in got[4].text and got[5].text and "[" not in got[5].text and "README.md:" in got[6].text
    assert all(got[q].n_invalid == 0 and (got[q].n_valid > 0 or q == 5) for q in got)


def test_contexts_follow_calls_both_ways(spark):
    index = build(spark)
    names = {r.chunk_id: (r.path, r.symbol_name) for r in index.chunks.collect()}
    edges = {(names[r.src][1], names[r.dst][1], r.kind) for r in index.edges.collect() if r.kind}
    assert edges == {("verify_password", "derive_key", 1), ("derive_key", "verify_password", 2), ("login", "verify_password", 1), ("verify_password", "login", 2)}
    heads = {(names[r.src], names[r.dst]) for r in index.edges.collect() if not r.kind}
    assert (("src/auth.py", "verify_password"), ("src/auth.py", None)) in heads
    asked = spark.createDataFrame([(1, "hashlib sha256 hexdigest")], "q long, question string")
    found = {names[r.id] for r in index.contexts(asked, k=1).collect()}
    assert {("src/crypto.py", "derive_key"), ("src/auth.py", "verify_password"), ("src/app.py", "login"), ("src/crypto.py", None)} <= found
    assert len(index.contexts(asked, k=1, budget=0).collect()) < len(found)


def test_chunks_by_kind_of_file(spark):
    rows = {(r.path, r.symbol_kind, r.symbol_name, r.start_line): r for r in build(spark).chunks.collect()}
    assert {k for k in rows if k[0] == "README.md"} == {("README.md", "section", "Keys", 1), ("README.md", "section", "Use", 4), ("README.md", "summary", None, 1)}
    assert ("web/a.js", "function", "zebraLine", 1) in rows
    assert rows["src/auth.py", "function", "verify_password", 5].header == "# src/auth.py | imports: os, src"


def test_a_refresh_of_one_file_writes_one_segment(spark, tmp_path):
    """And answers as an index built anew does."""
    folder = f"file://{tmp_path}/index"
    index = build(spark).saved(folder)
    changed = dict(FILES, **{"web/a.js": "function zebraStripe() { return 2 }\n"})
    rows = spark.createDataFrame([(p, t, str(hash(t)), t.count("\n")) for p, t in changed.items()], "path string, text string, content_hash string, loc long")
    again = Index.opened(spark, folder).refreshed(rows).saved(folder)
    assert {p.path for p in index.postings.parts} < {p.path for p in again.postings.parts} and len(again.postings.parts) == 2
    assert again.postings.parts[1].size == 1 and again.postings.dead.count() == 1
    asked = spark.createDataFrame([(1, "zebra keys"), (2, "derive_key"), (3, "zebraStripe"), (4, "zebraLine")], "q long, question string")
    anew = Index.build(rows)
    shown = lambda i: sorted((r.q, r.rank, r.id, round(r.score, 9)) for r in i.search(asked).collect())
    assert shown(again) == shown(anew)
    plan = Index.opened(spark, folder).postings._union("blocks").where("term IN ('a', 'b')")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan


def test_of_two_savers_the_later_counts(spark, tmp_path):
    one = build(spark)
    one.saved(f"file://{tmp_path}/index")
    rows = one.files.where("path LIKE 'web/%'")
    Index.build(rows).saved(f"file://{tmp_path}/index")
    assert Index.opened(spark, f"file://{tmp_path}/index").files.count() == 1


def test_candidates_are_reranked(spark):
    """By a model's answer; without one, or where it names nothing, in the order in which they were found."""
    index = build(spark)
    asked = spark.createDataFrame([(1, "zebra keys hashlib login"), (2, "zebra more text keys")], "q long, question string")
    ranked = spark.createDataFrame(index.contexts(asked).collect(), "q long, rank long, id long")
    prompts = []

    def model(df):
        prompts.extend(df.collect())
        return spark.createDataFrame([(r.q, "3, 1, 99" if r.q == 1 else "no idea") for r in prompts], "q long, answer string")

    ids = {(r.q, r.rank): r.id for r in ranked.collect()}
    got = sorted((r.q, r.rank, r.id) for r in index.reranked(asked, ranked, model, keep=2).collect())
    assert got == [(1, 1, ids[1, 3]), (1, 2, ids[1, 1]), (2, 1, ids[2, 1]), (2, 2, ids[2, 2])]
    assert prompts[0].prompt.startswith("zebra") and "\n\n2. [" in prompts[0].prompt
    plain = sorted((r.q, r.rank, r.id) for r in index.reranked(asked, ranked, keep=2).collect())
    assert plain == [(q, r, ids[q, r]) for q in (1, 2) for r in (1, 2)]


def test_an_index_of_too_many_chunks_is_refused(spark):
    import pytest

    rows = build(spark).files
    with pytest.raises(ValueError, match="chunks are more than 3"):
        Index.build(rows, most=3)


def test_listed_answers_have_all_their_lines(spark):
    """Above any old limit, as rows and as one text; a caller may cut them."""
    many = "from fastapi import FastAPI\napp = FastAPI()\n" + "".join(f"\n\n@app.get('/r{i:04}')\ndef f{i}():\n    return {i}\n" for i in range(1_100))
    needs = "".join(f"package{i:04}==1.{i}\n" for i in range(450))
    files = spark.createDataFrame([("app.py", many, "h1", many.count("\n")), ("requirements.txt", needs, "h2", 450)], "path string, text string, content_hash string, loc long")
    index = Index.build(files)
    asked = spark.createDataFrame([(1, "list the endpoints"), (2, "which packages are used")], "q long, question string")
    lines = {}
    for r in index.answer_lines(asked).lines.orderBy("q", "ord").collect():
        lines.setdefault(r.q, []).append(r.line)
    assert len(lines[1]) == 1_101 and lines[1][0] == "1100 endpoint(s):\n"
    assert len(lines[2]) == 3 and sum(line.count("package") for line in lines[2]) == 450
    got = {r.q: r for r in index.answered(asked).collect()}
    assert got[1].text.count("`GET ") == 1_100 == got[1].n_valid and got[2].n_valid == 3
    cut = {r.q: r.text for r in index.answered(asked, most=5).collect()}
    assert cut[1].count("`GET ") == 4


def test_events_of_all_stages_in_order(spark):
    import json

    index = build(spark)
    asked = spark.createDataFrame([(1, "list the endpoints"), (2, "how does the zebra tool run"), (3, "why is the zebra so")], "q long, question string")
    tools = spark.createDataFrame([(2, 0, "grep", "zebra", "2 lines"), (2, 1, "read_file", "README.md", "26 lines"), (1, 0, "grep", "x", "never")], "q long, place long, name string, input string, result_summary string")
    failures = spark.createDataFrame([(3, "model is away")], "q long, message string")
    rows = {}
    for r in index.events(asked, tools=tools, failures=failures).orderBy("q", "seq").collect():
        rows.setdefault(r.q, []).append((r.seq, r.event, json.loads(r.data)))
    for told in rows.values():
        assert [t[0] for t in told] == list(range(len(told)))
    steps = lambda q: [k for i, (_, e, d) in enumerate(rows[q]) if (k := d.get("stage", e)) and (not i or k != rows[q][i - 1][2].get("stage", rows[q][i - 1][1]))]
    assert steps(1) == ["routing", "sources", "token", "citations", "done"]
    assert steps(2) == ["routing", "retrieving", "expanding", "generating", "sources", "generating", "tool", "tool_call", "tool", "tool_call", "token", "citations", "done"]
    assert steps(3) == ["routing", "retrieving", "expanding", "generating", "sources", "generating", "error"]
    text = "".join(d["text"] for _, e, d in rows[1] if e == "token")
    assert text.startswith("1 endpoint(s):\n - `GET /login`") and rows[1][-1][2]["route"] == "endpoints"
    assert [d for _, e, d in rows[1] if e == "citations"] == [{"path": "src/app.py", "start_line": 5, "end_line": 5}]


def test_question_sets_are_scored(spark):
    golden = spark.createDataFrame([("a", "Where is `login` defined?", "locate", ["src/app.py"]), ("b", "how does the zebra tool run", "locate", ["nowhere.py"]), ("c", "list the endpoints", "endpoints", [])], "id string, question string, route string, expected_files array<string>")
    got = {r.question_id: (r.route_hit, r.recall_hit, r.citation_validity) for r in build(spark).evaluated(golden).collect()}
    assert got == {"a": (True, True, 1.0), "b": (False, False, 1.0), "c": (True, None, 1.0)}
