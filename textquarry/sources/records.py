"""Tables that evaluation reads and writes: question sets, logs of answered questions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ROUTES
from ..operators.evaluation import deltas
from .yaml_files import yaml_as_json

GOLDEN = "id string, question string, route string, expected_files array<string>, expected_substrings array<string>, notes string"
REPORTED = ["recall", "validity", "correctness", "p50", "p95", "cost_usd"]


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A question set from JSON or YAML (a list, or a mapping with ``questions``); it must not be empty, and each
    question needs an id of its own, a text and a route."""
    if path.endswith((".yaml", ".yml")):
        text = yaml_as_json(spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text")))
        listed = F.coalesce(F.get_json_object("text", "$.questions"), F.col("text"))
        rows = text.select(F.explode(F.from_json(listed, f"array<struct<{GOLDEN.replace(' string', ':string').replace(' array', ':array')}>>")).alias("g")).select("g.*")
    else:
        rows = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    bad = F.col("id").isNull() | F.col("question").isNull() | ~F.coalesce(F.col("route").isin(ROUTES), F.lit(False))
    n, faults, ids = rows.agg(F.count(F.lit(1)), F.count_if(bad), F.count_distinct("id")).first()
    if not n:
        raise ValueError(f"{path} has no questions")
    if faults or ids < n:
        raise ValueError(f"{path}: {faults} questions lack an id, a text or a known route; {n - ids} ids repeat or are missing")
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(F.col(c), empty) for c in ("expected_files", "expected_substrings")})


def append_log(answered: DataFrame, path: str) -> None:
    """Add rows to the log; ``created_at`` is the time of writing."""
    answered.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(metrics: DataFrame, suite: str, at: str, path: str) -> None:
    """Append one report: the metrics by route of ``evaluation.by_route``."""
    metrics.withColumns({"suite": F.lit(suite), "at": F.lit(at)}).write.mode("append").json(path)


def report_changes(spark: SparkSession, path: str) -> DataFrame:
    """``suite, metric, at, value, previous, delta`` of the overall rows of all reports written so far."""
    rows = spark.read.schema("suite string, at string, route string, " + ", ".join(f"{m} double" for m in REPORTED)).json(path).where("route IS NULL")
    long = rows.select("suite", "at", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in REPORTED])).alias("m")).select("suite", "at", "m.metric", "m.value")
    return deltas(long)


def report_table(changes: DataFrame) -> DataFrame:
    """The latest report of each suite as a markdown table against the one before it."""
    last = changes.groupBy("suite").agg(F.max("at").alias("at"))
    cell = lambda c: F.coalesce(F.format_number(c, 4), F.lit("–"))
    line = F.concat_ws(" | ", F.col("metric"), cell("previous"), cell("value"), cell("delta"))
    rows = changes.join(last, ["suite", "at"]).groupBy("suite").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("suite", F.concat(F.lit("metric | before | now | change\n-|-|-|-\n"), F.array_join("lines", "\n")).alias("text"))
