import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import sql
from textquarry.functions import text as fn
from textquarry.plans import catalogue
from textquarry.sources import records


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark)
    assert set(names) == {"split_identifier", "shannon_entropy", "route_question", "token_estimate", "redact_entropy"}
    values = ["HTTPServer_getUserById-v2", "where is the config file", "which npm package", "a", "key Zx9kQ2mP7vR4tY8wB3nL6sD1f end", "aaaa1111bbbb2222cccc3333"]
    spark.createDataFrame([(v,) for v in values], "v string").createOrReplaceTempView("given")
    for name, column in {"split_identifier": fn.split_identifier, "shannon_entropy": fn.shannon_entropy, "route_question": fn.route_question, "token_estimate": fn.token_estimate, "redact_entropy": fn.redact_entropy}.items():
        got = spark.sql(f"SELECT v, {name}(v) AS x FROM given").withColumn("y", column(F.col("v"))).collect()
        assert all(r.x == r.y or abs(r.x - r.y) < 1e-12 for r in got), name


def test_question_sets_are_checked(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text(json.dumps(rows))
        return f"file://{tmp_path}/{name}"

    good = [{"id": "a", "question": "q", "route": "explain", "expected_files": ["x.py"]}, {"id": "b", "question": "q", "route": "locate"}]
    assert [r.expected_files for r in records.golden(spark, write("good.json", good)).orderBy("id").collect()] == [["x.py"], []]
    for i, bad in enumerate(([], good + [good[0]], [{"id": "a", "question": "q", "route": "other"}], [{"id": "a", "route": "explain"}])):
        with pytest.raises(ValueError):
            records.golden(spark, write(f"bad{i}.json", bad))


def test_reports_are_compared_with_the_one_before(spark, tmp_path):
    metrics = catalogue.queries()["eval_by_route"](spark, "/root/testdata/sf0.001")
    path = f"file://{tmp_path}/reports"
    records.write_report(metrics, "s", "2024-01-01", path)
    records.write_report(metrics.withColumn("recall", F.col("recall") + 0.25), "s", "2024-01-02", path)
    changes = {(r.metric, r.at): r.delta for r in records.report_changes(spark, path).collect()}
    assert changes[("recall", "2024-01-01")] is None and abs(changes[("recall", "2024-01-02")] - 0.25) < 1e-9 and changes[("p50", "2024-01-02")] == 0
    assert "recall | " in records.report_table(records.report_changes(spark, path)).first().text


def test_log_grows(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for i in range(2):
        records.append_log(spark.createDataFrame([(i, "q")], "query_id long, question string"), path)
    assert spark.read.parquet(path).count() == 2
