"""Table functions in SQL."""

import pytest

from textquarry.functions import tables
from textquarry.operators import extraction, source_facts


@pytest.fixture
def files(spark):
    tables.register(spark)
    rows = [("a.py", "def f():\n    return g(1)\n", 1), ("b.go", "package p\n\nfunc F() { g(2) }\n", 2), ("broken.py", "def (", 3), ("n.py", None, 4), (None, "def f(): pass", 5), ("t.txt", "x" * 3_000, 6), ("C.java", '@RestController\nclass C { @GetMapping("/x") void x() {} }\n', 7)]
    return spark.createDataFrame(rows, "path string, text string, other int")


def test_facts_by_sql_are_those_of_the_operators(spark, files):
    known = files.where("path IS NOT NULL")
    facts = source_facts.source_facts(known)
    got = spark.sql("SELECT path, name, kind, start_line FROM symbols(TABLE(SELECT * FROM {f}))", f=files)
    assert sorted(got.collect()) == sorted(extraction.symbols(facts).select("path", "name", "kind", "start_line").collect())
    got = spark.sql("SELECT path, target_name, caller, line FROM calls(TABLE(SELECT * FROM {f}))", f=files)
    assert sorted(got.collect()) == sorted(extraction.calls(facts).select("path", "target_name", "caller", "line").collect())
    got = spark.sql("SELECT method, route, handler, line FROM endpoints(TABLE(SELECT text, path FROM {f}))", f=files)
    assert [tuple(r) for r in got.collect()] == [("GET", "/x", "x", 2)]
    # With other clauses of SQL around them.
    got = spark.sql("SELECT path, count(*) AS n FROM chunks(TABLE(SELECT * FROM {f} WHERE other > 5)) GROUP BY path HAVING n > 1", f=files)
    assert [tuple(r) for r in got.collect()] == [("t.txt", 3)]


def test_tables_that_hold_no_files_are_refused(spark, files):
    with pytest.raises(Exception, match="the table has no text"):
        spark.sql("SELECT * FROM symbols(TABLE(SELECT path FROM {f}))", f=files)
    with pytest.raises(Exception, match="TABLE"):
        spark.sql("SELECT * FROM symbols(1)")
    assert spark.sql("SELECT * FROM chunks(TABLE(SELECT * FROM {f} WHERE false))", f=files).collect() == []
