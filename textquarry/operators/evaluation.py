"""Scores of answered questions and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_hit(expected: Column, context: Column) -> Column:
    """Whether any expected file is in the context; null where none is expected."""
    return F.when(F.size(expected) > 0, F.arrays_overlap(expected, context))


def metrics() -> list[Column]:
    zero = F.lit(0.0)
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        mean("recall_hit").alias("recall"),
        mean("citation_validity").alias("validity"),
        mean("correctness").alias("correctness"),
        F.coalesce(F.percentile("latency_ms", F.lit(0.5)), zero).alias("p50"),
        F.coalesce(F.percentile("latency_ms", F.lit(0.95)), zero).alias("p95"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("cost_usd"), zero).alias("cost_usd"),
    ]


def by_route(scores: DataFrame) -> DataFrame:
    """Metrics by route and, with a null route, over all of them."""
    return scores.rollup("route").agg(*metrics())


def deltas(values: DataFrame) -> DataFrame:
    """Each metric of ``values(suite, metric, at, value)`` beside the report before it."""
    before = F.lag("value").over(Window.partitionBy("suite", "metric").orderBy("at"))
    return values.withColumn("previous", before).withColumn("delta", F.col("value") - F.col("previous"))
