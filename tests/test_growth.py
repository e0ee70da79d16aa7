"""What must not grow with the tables: broadcasts, batches of a Python worker, rows of one task."""

import pytest
from pyspark.sql import functions as F

from textquarry.operators import code_chunks, graph, index, retrieval, segments, source_facts, structured
from textquarry.operators import extraction as ex
from textquarry.plans import catalogue, ranking

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def python_files(spark, n):
    return spark.range(n).coalesce(1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("class A:\n    def b(self):\n        c()\n\nd()\n").alias("text"))


@pytest.mark.parametrize("name", ["python_chunks", "source_chunks"])
def test_chunks_broadcast_nothing(spark, name):
    """Tables here are below any threshold, so a join that Spark may broadcast would be one."""
    assert "BroadcastExchange" not in plan_of(catalogue.queries()[name](spark, SF))


def test_chunks_of_equal_lines(spark):
    got = code_chunks.definition_chunks(python_files(spark, 3), source_facts.source_facts(python_files(spark, 3)))
    rows = sorted((r.path, r.symbol_name or "", r.symbol_kind, r.start_line, r.end_line, r.content) for r in got.collect())
    assert rows == [x for i in range(3) for x in ((f"f{i}.py", "", "module", 5, 5, "d()"), (f"f{i}.py", "A", "class", 1, 1, "class A:"), (f"f{i}.py", "b", "function", 2, 3, "    def b(self):\n        c()"))]


def test_parsing_is_dealt_over_tasks(spark):
    """A table of one partition does not make one task of all parsing."""
    files = python_files(spark, 400)
    for facts in (ex.python_facts(files), source_facts.source_facts(files)):
        assert facts.where("fact = 'symbol'").groupBy(F.spark_partition_id()).count().count() > 1


def test_table_functions_are_dealt_over_tasks(spark):
    for name in ("table_symbols", "table_calls", "table_endpoints", "table_chunks"):
        assert catalogue.queries()[name](spark, SF).groupBy(F.spark_partition_id()).count().count() > 1, name


def test_a_worker_hands_on_bounded_batches():
    """One batch of files may hold any number of facts."""
    facts = (("f.py", "call", None, str(i), None, 1, 1, None, None, None) for i in range(3 * ex.HELD_FACTS + 1))
    assert [b.num_rows for b in ex.fact_batches(facts)] == [ex.HELD_FACTS] * 3 + [1]
    assert list(ex.fact_batches(iter(()))) == []


def test_located_ranks_names_not_definitions(spark):
    """A name with very many definitions is chosen without a window over them."""
    candidates = spark.createDataFrame([(1, 0, "none"), (1, 1, "a"), (1, 2, "b"), (2, 0, "b"), (3, 0, "none")], "q int, priority int, name string")
    symbols = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, symbol_id int")
    found = structured.located(candidates, symbols)
    assert sorted(map(tuple, found.select("q", "name", "symbol_id").collect())) == [(1, "a", 1), (1, "a", 2), (2, "b", 3)]
    assert "Window" not in plan_of(found)


def test_manifest_group_takes_whole_brands(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    got = catalogue.queries()["manifest_group"](spark, SF)
    assert sorted(r.manifest for r in got.collect()) == sorted(r.p_brand for r in part.select("p_brand").distinct().collect())
    rows = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", "b"), ("m", None), ("m", "")], "manifest string, name string")
    assert [tuple(r) for r in structured.by_manifest(rows).collect()] == [("m", 5, ", a, b, b")]


def test_reach_unites_paths_before_they_move(spark):
    """Negative and far numbers, edges of a set's block, hops by many paths."""
    pairs = [(s, m) for s in (-300, -1, 0, 63, 64, 255, 256, 1 << 40) for m in range(1000, 1040)]
    edges = spark.createDataFrame(pairs + [(m, s) for s, m in pairs], "src long, dst long")
    seeds = spark.createDataFrame([(-300,), (64,), (7,)], "seed long")
    want = {(s, s, 0) for s in (-300, 64, 7)} | {(s, m, 1) for s in (-300, 64) for m in range(1000, 1040)}
    want |= {(s, d, 2) for s in (-300, 64) for d, _ in pairs if d != s}
    found = graph.reach(seeds, edges, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert set(graph._sets(edges, "src", "dst").columns) == {"src", "block", *graph._WORDS}


def moved(spark, df):
    """Rows that are written to shuffles while ``df`` is made and read."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        none = spark._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = sorted(map(tuple, df().collect()))
    return rows, written() - before


def test_reach_moves_no_more_rows_with_more_tasks(spark, monkeypatch):
    """Parts of one cluster share their neighbours: what is united of a seed does not come once from each task."""
    pairs = [(2 * (c * 8 + s), 2 * (c * 80 + p) + 1) for c in range(40) for s in range(8) for p in range(80)]
    edges = spark.createDataFrame(pairs + [(p, s) for s, p in pairs], "src long, dst long")
    seeds = spark.createDataFrame([(2 * s,) for s in range(320)], "seed long")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few, n = moved(spark, lambda: graph.reach(seeds, edges, 2))
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        monkeypatch.setattr(graph, "ROWS", 1000)
        many, m = moved(spark, lambda: graph.reach(seeds, edges, 2))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert few == many and len(few) == 320 * (1 + 80 + 7)
    # 320 seeds; from each of 64 tasks they would be about 40 times as many.
    assert m - n < 20 * 320


@pytest.mark.parametrize("wide, rows, parts, ranges", [(1 << 17, 200, 8, 24), (0, 1, 1 << 20, 24)])
def test_reach_equals_brute_force(spark, monkeypatch, wide, rows, parts, ranges):
    """Frontiers as bits or not, ranges of all sizes or single nodes; edges that repeat, lead back or nowhere, seeds that repeat or have none."""
    for name, value in (("WIDE", wide), ("ROWS", rows), ("PARTS", parts), ("RANGES", ranges)):
        monkeypatch.setattr(graph, name, value)
    nodes = [(i * i * 37) % 3000 - 700 for i in range(90)] + [1 << 40, -(1 << 40), (1 << 62) + 5]
    pairs = [(a, nodes[(i * k + 11) % len(nodes)]) for i, a in enumerate(nodes) for k in (1, 3, 8)] + [(nodes[0], nodes[0]), (nodes[1], None), (None, nodes[2])]
    edges, seeds = spark.createDataFrame(pairs * 2, "src long, dst long"), spark.createDataFrame([(s,) for s in [*nodes[::7], nodes[0], 5555, *nodes[-3:]]], "seed long")
    want = []
    for s in [r.seed for r in seeds.collect()]:
        want.append((s, s, 0))
    for s in {r.seed for r in seeds.collect()}:
        seen, frontier = {s}, {s}
        for hop in range(1, 4):
            frontier = {b for a, b in pairs if a in frontier and b is not None} - seen
            seen |= frontier
            want += [(s, x, hop) for x in frontier]
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    assert sorted(map(tuple, graph.reach(seeds, edges, 3).collect())) == sorted(want)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert graph.reach(seeds, edges.limit(0), 2).count() == seeds.count()
    assert graph.reach(seeds.limit(0), edges, 2).count() == 0


def test_expansion_deals_rows_by_their_number(spark, monkeypatch):
    """A task gets a bounded number of rows, few or many, batches cut a fold anywhere; hops end where budgets are spent."""
    edges = [(s, 100 + (s * 7 + i) % 60, i % 3, i % 5) for s in range(8) for i in range(40)] + [(100 + i, s, 0, s) for i in range(60) for s in range(i % 3, 8, 3)]
    cost = {n: n % 9 + 1 for n in (*range(8), *range(100, 160))}
    e, t = spark.createDataFrame(edges, "src long, dst long, kind int, ord long"), spark.createDataFrame(list(cost.items()), "id long, tokens long")
    seeds = spark.createDataFrame([(f"q{s}", 0, s) for s in range(8)], "q string, rank int, id long")

    def brute(budget):
        for s in range(8):
            seen, frontier, spent = {s}, [s], 0
            for hop in (1, 2, 3):
                best = {}
                for rank, node in enumerate(frontier):
                    for src, dst, kind, at in edges:
                        if src == node and dst not in seen:
                            best[dst] = min(best.get(dst, (99,)), (rank, kind, at))
                frontier = []
                for d in sorted(best, key=lambda d: (best[d], d)):
                    if spent < budget and (spent + cost[d] <= budget or spent == 0):
                        spent += cost[d]
                        frontier.append(d)
                        yield f"q{s}", hop, len(frontier) - 1, d
                seen |= set(best)

    made = []
    monkeypatch.setattr(graph, "written", lambda df, label, f=graph.written: made.append((label, df.rdd.getNumPartitions())) or f(df, label))
    shown = lambda budget: sorted(map(tuple, graph.expand(seeds, e, t, 3, budget).collect()))
    assert shown(30) == sorted(brute(30)) and [x for x, _ in made].count("hop") == 1
    assert shown(230) == sorted(brute(230)) and max(r[1] for r in brute(230)) > 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name, least in (("FEW", 0), ("ROWS", 10), ("SPREAD", 9), ("MOST", 20)):
            monkeypatch.setattr(graph, name, least)
        made.clear()
        assert shown(230) == sorted(brute(230))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # 320 paths of the first hop, at most 20 of them a task.
    assert [n for label, n in made if label == "hop"][0] >= 16 <= [n for label, n in made if label == "picked"][0]


def test_links_are_dealt_before_they_are_distinct(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ranking, "written", lambda df, label, f=ranking.written: plans.append(plan_of(df)) or f(df, label))
    links = ranking._supply(catalogue.Tables(spark, SF))
    assert links.count() == links.distinct().count() > 0
    # Below the exchange there is no aggregate that would hold a file's links.
    assert "HashAggregate" in plans[0].split("Exchange")[0] and "HashAggregate" not in plans[0].split("Exchange", 1)[1]


def test_bm25_of_few_questions_joins_no_postings(spark, monkeypatch):
    """Terms of rows stay in their task; what is found equals the join of postings, for phrases, ties, odd texts and repeated names."""
    texts = [None, "", "get_user", "a get user_b get_user", "A b a b", "a b", "b a", "é ² 中文 a", "c " * 40 + "get", *["a b"] * 30]
    rows = spark.createDataFrame([(i, t, "a_b" if i % 3 else None) for i, t in enumerate(texts)], "id long, content string, symbol_name string")
    asked = spark.createDataFrame([("x", "get_user a"), ("y", "a A b"), ("z", "a_b"), ("none", "!"), ("far", "zzz"), ("w", "中文 ² é c_c")], "q string, question string")

    def shown(df):
        return sorted((r.q, r.rank, r.id, round(r.score, 9)) for r in df.collect())

    twice = rows.unionByName(rows.where("id = 5"))
    found = retrieval.bm25(rows, asked, 4)
    assert "SortMergeJoin" not in plan_of(found) and "posexplode" not in plan_of(found)
    got, again, empty = shown(found), shown(retrieval.bm25(twice, asked, 4)), shown(retrieval.bm25(rows.limit(0), asked))
    monkeypatch.setattr(retrieval, "HELD_TERMS", 3)
    monkeypatch.setattr(retrieval, "DENSE", 8)
    assert shown(retrieval.bm25(rows, asked, 4)) == got
    monkeypatch.setattr(retrieval, "CELLS", 0)
    assert got == shown(retrieval.bm25(rows, asked, 4)) and len(got) > 9
    # The join of postings loses phrases of several terms in copies, so these are compared by single terms.
    single = asked.where("q IN ('y', 'far')")
    assert [r for r in again if r[0] == "y"] == shown(retrieval.bm25(twice, single, 4)) and empty == []


def test_a_new_index_redacts_once_and_lays_out_no_postings(spark, monkeypatch):
    """Words of an index that is not stored are searched where they are; stored, it finds the same, copies of a chunk too."""
    labels = []
    for module in (index, segments):
        monkeypatch.setattr(module, "written", lambda df, label, f=module.written: labels.append(label) or f(df, label))
    texts = ["# A\n" + "abcd efgh ijkl\n" * 9, "ab cd efgh " * 700, "".join(f"word{i % 26} " for i in range(3000)), "x" * 9000]
    files = spark.createDataFrame([(f"d{i}.txt" if i else "a.md", t, str(i), t.count("\n") + 1) for i, t in enumerate(texts)], "path string, text string, content_hash string, loc long")
    made = index.Index.build(files)
    assert labels.count("clean") == 1 and "blocks" not in labels
    asked = spark.createDataFrame([(1, "efgh abcd"), (2, "word3 ab"), (3, "x" * 1500)], "q long, question string")
    shown = lambda df: sorted((r.q, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    once = retrieval.bm25(index._searched(made.chunks), asked, once=True)
    assert shown(once) == shown(made.segments().bm25(asked)) and "blocks" in labels
    assert made.chunks.count() > made.chunks.select("chunk_id").distinct().count()


def test_words_of_vectors_stay_in_their_task(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "A b a"), (1, "c"), (2, " "), (3, None), (4, "é x y"), (5, "a b a c")], "id long, text string")
    found = retrieval.hash_vectors(rows, "id", 4)
    assert "explode" not in plan_of(found)
    got = {r.id: r.v for r in found.collect()}
    assert set(got) == {1, 4, 5} and got[1] == got[5]
    monkeypatch.setattr(retrieval, "HELD_TERMS", 2)
    assert {r.id: r.v for r in retrieval.hash_vectors(rows, "id", 4).collect()} == got
