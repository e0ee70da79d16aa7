"""From raw documents to token ids: five stages, each one of the training-data operators.

``STAGES`` lists them in order.  A stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on,
with the columns of ``documents``; the last returns token ids.  ``run`` applies them to the table of documents,
each stage's result written and read again, so a lost executor costs one stage's tasks at most.

Defined cases, in every stage: a null text counts as empty; documents without an identifier are never grouped with others
as near copies, and exact copies of them are one; rows that repeat are copies; texts may be of any length; an empty table
gives an empty one; further columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import alike, bpe, exact_dedup, mixing, pu_quality
from textquarry.llm.common import documents, written
from textquarry.llm.queries import quality_labels


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_quality.accepted(docs, pu_quality.fit(docs, quality_labels(spark, sf_dir)))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the largest identifier."""
    return exact_dedup.deduplicated(docs, keep="largest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest identifier.

    Candidates are SimHash fingerprints of 512 bits; of these only pairs count whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more.
    """
    return alike.near_deduplicated(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents taken for two epochs come twice."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that came this far, with digests of them and of what they decode to."""
    return bpe.encode(docs, ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("byte_bpe", byte_bpe),
]

#: A fitted classifier, fingerprints and merges are beyond SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
