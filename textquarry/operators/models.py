"""Calls of a user's model over tables: equal inputs are sent once, in batches, again after a failure, and never twice.

A *provider* is a function from a list of texts to a list of results that runs inside tasks.  Inputs are told apart by a
digest of the model's name and the text; a table of results keeps what was given, so later runs send only what is new.
``Transient`` errors are tried again, each time after twice as long; what still fails, or fails in another way, has an error
in place of a result.  Nothing else stops for it: answers fall back to what there is without the model.

Defined cases: a null input is not sent and has no result; a provider that gives another number of results than texts
has failed; inputs without a place in a limit are sent by a later run; a key may repeat.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import judge_score
from ..sources.scratch import shared_folder
from .summaries import MAX_CHARS, MIN_LINES

#: Texts that are sent together; tries of a batch, and seconds before the second.
BATCH, TRIES, WAIT = 64, 3, 1.0
#: Summaries of new contents that one run asks for.
MOST_SUMMARIES = 300
RESULTS = "digest string, result {kind}, error string, tries int, at timestamp"


class Transient(Exception):
    """An error after which the same call may succeed."""


@dataclass
class Model:
    """A provider under a name, with results of the Spark type ``kind`` kept in ``folder``."""

    name: str
    provider: Callable[[list[str]], list]
    kind: str = "string"
    folder: str | None = None
    batch: int = BATCH
    tries: int = TRIES
    wait: float = WAIT

    def _path(self, spark: SparkSession) -> str:
        if self.folder is None:
            self.folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
        return f"{self.folder.rstrip('/')}/{self.name}"

    def known(self, spark: SparkSession) -> DataFrame:
        """``digest, result`` of what was given so far; of a digest that two runs asked for, the first result."""
        try:
            rows = spark.read.parquet(self._path(spark)).where("error IS NULL")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], f"digest string, result {self.kind}")
        return rows.groupBy("digest").agg(F.min_by("result", "at").alias("result"))

    def asked(self, inputs: DataFrame, most: int | None = None) -> DataFrame:
        """``key, result, error`` of ``inputs(key, text)``; of new texts ``most`` are sent at most, those of the least digests."""
        spark = inputs.sparkSession
        rows = inputs.withColumn("digest", F.sha2(F.concat(F.lit(f"{self.name}|"), "text"), 256))
        new = rows.where("text IS NOT NULL").groupBy("digest").agg(F.first("text").alias("text"))
        new = new.join(self.known(spark).select("digest"), "digest", "left_anti")
        if most is not None:
            new = new.orderBy("digest").limit(most)
        path = f"{self._path(spark)}/run={uuid.uuid4().hex}"
        # Written once: what was sent is not sent again when the result is read twice.
        self._sent(new).write.parquet(path)
        errors = spark.read.parquet(path).where("error IS NOT NULL").select("digest", "error")
        found = rows.join(self.known(spark), "digest", "left").join(errors, "digest", "left")
        return found.select("key", "result", "error")

    def _sent(self, new: DataFrame) -> DataFrame:
        provider, tries, wait, batch = self.provider, self.tries, self.wait, self.batch
        kind = new.sparkSession.createDataFrame([], f"x {self.kind}").toArrow().schema.field("x").type

        def called(texts: list[str]) -> tuple[list, str | None, int]:
            for n in range(1, tries + 1):
                try:
                    results = list(provider(texts))
                    if len(results) != len(texts):
                        return [None] * len(texts), f"{len(results)} results for {len(texts)} texts", n
                    return results, None, n
                except Transient as e:
                    if n == tries:
                        return [None] * len(texts), str(e) or type(e).__name__, n
                    time.sleep(wait * 2 ** (n - 1))
                except Exception as e:  # the model's own, whatever it is: an error is a result here
                    return [None] * len(texts), str(e) or type(e).__name__, n
            raise AssertionError

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    part = rows.slice(at, batch)
                    results, error, n = called(part.column(1).to_pylist())
                    columns = [part.column(0), pa.array(results, kind), pa.array([error] * len(results), pa.string()), pa.array([n] * len(results), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "result", "error", "tries"])

        sent = new.select("digest", "text").repartition("digest").mapInArrow(run, f"digest string, result {self.kind}, error string, tries int")
        return sent.withColumn("at", F.current_timestamp())


def reranker(model: Model) -> Callable[[DataFrame], DataFrame]:
    """For ``Index.spans`` and the like; a question whose call failed has a null answer, so its order stays."""

    def rerank(prompts: DataFrame) -> DataFrame:
        found = model.asked(prompts.select(F.col("q").alias("key"), F.col("prompt").alias("text")))
        return found.select(F.col("key").alias("q"), F.col("result").alias("answer"))

    return rerank


def judged(answers: DataFrame, model: Model) -> DataFrame:
    """``q, score, error`` of ``answers(q, question, expected, text)``: 0, 1 or 2, null where the call failed or no score is named."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nExpected: "), F.coalesce("expected", F.lit("")), F.lit("\nAnswer: "), F.coalesce("text", F.lit("")), F.lit("\nScore 0, 1 or 2:"))
    found = model.asked(answers.select(F.col("q").alias("key"), prompt.alias("text")))
    return found.select(F.col("key").alias("q"), judge_score(F.col("result")).alias("score"), "error")


def file_summaries(files: DataFrame, model: Model, least: int = MIN_LINES, most: int = MOST_SUMMARIES, chars: int = MAX_CHARS) -> DataFrame:
    """``scope, target_path, content, source_hash`` as ``summaries.file_summaries`` has them, by a model; files without a
    summary yet are left out, and come with a later run."""
    rows = files.where(F.col("loc") >= least).select(F.struct("path", "content_hash").alias("key"), F.concat("path", F.lit("\n\n"), F.substring("text", 1, chars)).alias("text"))
    found = model.asked(rows, most).where("result IS NOT NULL")
    return found.select(F.lit("file").alias("scope"), F.col("key.path").alias("target_path"), F.col("result").alias("content"), F.col("key.content_hash").alias("source_hash"))


def embedded(texts: DataFrame, model: Model) -> DataFrame:
    """``id, v`` of ``texts(id, text)`` by a model of kind ``array<double>``; texts whose call failed have no vector."""
    found = model.asked(texts.select(F.col("id").alias("key"), "text"))
    return found.where("result IS NOT NULL").select(F.col("key").alias("id"), F.col("result").alias("v"))
