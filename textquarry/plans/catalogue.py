"""Named queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The given tables by name: ``t.documents`` reads ``documents.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its name; ``sql`` is what DuckDB runs for the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same rows."""
    return _SQL[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import corpus, events, extraction, maintenance, ranking, relational  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
