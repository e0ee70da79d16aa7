"""Exact deduplication over a log-structured merge index of text digests.

* **Flush.**  Each scan task is one memtable: it digests its rows, sorts them by digest without any
  shuffle and writes one sorted run.
* **Compaction.**  The runs merge into one level: a digest keeps its smallest identifier and its count.
  Map-side combining bounds what a very large group of copies sends.
* **Byte verification.**  Hits are digests that more than one row has.  Their bits form a filter sized by their
  number; the rows that pass are grouped by digest *and* bytes.  A digest found to stand for several texts
  is resolved by its bytes, so the result is exact under any digest function.
* **Levels.**  ``MergeIndex`` keeps levels in a folder for batches to come.  Each is range-sorted by digest, with
  Parquet's ranges and Bloom filters in its files and a bitmap of its digests beside it.  A batch asks the bitmaps
  first; few survivors are pushed down to the files, which skip what their ranges and filters rule out, and many
  are joined.  Hits are compared by their bytes with the stored texts.  Levels merge as they reach a like size, so
  there are as many as the logarithm of the index's size, and each digest is rewritten as often at most.

Everything is DataFrame expressions.  No step holds a group in one place: counts and minima combine
before they move, and the last step is an equi-join that Spark can split at a hot digest.

Defined cases: a null text counts as empty (so nulls and empty texts are one group); a null identifier
never wins against another one, and a group of null identifiers has a null keeper; rows that repeat the
keeper's identifier and text are marked kept together, and ``deduplicated`` returns one of them; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_bit, filter_bits, membership, possible_members, whole_rows, written

#: A level merges with the next one unless that has this many times its rows.
FANOUT = 4
#: Digests that are pushed down to a level's files at most; more are joined.
PUSHED = 500


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """Sorted runs ``(digest, id)``, one per scan task."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(digest(text).alias("digest"), F.col(f"`{id_col}`").alias("id"))
    return written(rows.sortWithinPartitions("digest"), "runs")


def compact(runs: DataFrame, largest: bool) -> DataFrame:
    """One level ``(digest, keep_id, n)``: of each digest the smallest identifier in the order wanted."""
    keep = F.max("id") if largest else F.min("id")
    return written(runs.groupBy("digest").agg(keep.alias("keep_id"), F.count(F.lit(1)).alias("n")), "level")


def texts_of_hits(docs: DataFrame, level: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str, largest: bool) -> DataFrame:
    """``(digest, text, keep_id, n)`` of every row that the filter lets through, grouped by bytes."""
    keep = F.max("id") if largest else F.min("id")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    hits = level.where("n > 1")
    size = filter_bits(hits.count())
    rows = rows.withColumn("digest", digest(F.col("text"))).withColumn("bit", filter_bit(F.col("digest"), size))
    passed = possible_members(rows, membership(hits.select(filter_bit(F.col("digest"), size).alias("bit"))))
    return passed.groupBy("digest", "text").agg(keep.alias("keep_id"), F.count(F.lit(1)).alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per input row: ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    ``keep`` is the identifier that stays of equal texts, ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    largest = keep == "largest"
    runs = flush(docs, digest, id_col, text_col)
    level = compact(runs, largest)
    texts = texts_of_hits(docs, level, digest, id_col, text_col, largest)
    collided = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "collided")
    columns = ["id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")]
    if collided.isEmpty():
        return runs.join(level, "digest").select(*columns)
    # Some digest stands for several texts: its rows are told apart by their bytes.
    clear = runs.join(collided, "digest", "left_anti").join(level, "digest")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text"))).join(collided.select("digest"), "digest", "left_semi")
    told = rows.join(texts, ["digest", "text"])
    return clear.select(*columns).unionByName(told.select(*columns))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """The input's rows and columns, one row per distinct text."""
    groups = exact_groups(docs, id_col, text_col, keep, digest)
    keepers = written(groups.where("kept").groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows")), "keepers")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = whole_rows(docs, digest=digest(text), own=F.col(f"`{id_col}`"), text=text)
    stay = rows.join(keepers, (rows.digest == keepers.digest) & rows.own.eqNullSafe(keepers.id)).drop(keepers.digest)
    if keepers.where("rows > 1").isEmpty():
        return stay.select("row.*")
    return stay.groupBy("digest", "own", "text").agg(F.first("row").alias("row")).select("row.*")


class MergeIndex:
    """Levels of digests in ``folder``, which driver and executors share; reopened by giving the same folder.

    Each change writes new folders and then one row of the manifest, so a job that fails leaves the index as it was,
    and readers of an older state keep its files.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256_bytes):
        self.spark, self.folder, self.digest = spark, folder.rstrip("/"), digest

    def levels(self) -> list[tuple[str, int]]:
        """``(path, rows)`` of the levels, the newest first."""
        try:
            last = self.spark.read.parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            return []
        return [(level.path, level.rows) for level in last.levels] if last else []

    def _commit(self, levels: list[tuple[str, int]]) -> None:
        try:
            version = self.spark.read.parquet(f"{self.folder}/manifest").agg(F.max("version")).first()[0] + 1
        except AnalysisException:
            version = 0
        row = [(version, levels)]
        table = self.spark.createDataFrame(row, "version long, levels array<struct<path:string,rows:long>>")
        table.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _level(self, rows: DataFrame) -> tuple[str, int]:
        """Write ``rows(digest, keep_id, n)`` as a level: sorted files with Bloom filters, and its bitmap."""
        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        rows.repartitionByRange("digest").sortWithinPartitions("digest").write.options(**filters).parquet(f"{path}/digests")
        level = self.spark.read.parquet(f"{path}/digests")
        n = level.count()
        membership(level.select(filter_bit(F.col("digest"), filter_bits(n)).alias("bit"))).write.parquet(f"{path}/filter")
        return path, n

    def lookup(self, asked: DataFrame) -> DataFrame:
        """``digest, keep_id, n`` of those of ``asked(digest)``, distinct, that the index holds."""
        found = self.spark.createDataFrame([], "digest binary, keep_id long, n long")
        for path, rows in self.levels():
            filter_ = self.spark.read.parquet(f"{path}/filter")
            likely = written(possible_members(asked.withColumn("bit", filter_bit(F.col("digest"), filter_bits(rows))), filter_), "likely")
            level = self.spark.read.parquet(f"{path}/digests")
            few = likely.limit(PUSHED + 1).collect()  # PUSHED digests at most are used
            if len(few) <= PUSHED:
                met = level.where(F.col("digest").isin([bytes(r.digest) for r in few])) if few else level.where("false")
            else:
                met = level.join(likely, "digest", "left_semi")
            found = found.unionByName(met.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "n"))
        return found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def add(self, docs: DataFrame, stored: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; per row of it ``id``, ``digest``, ``keep_id``, ``group_size`` and ``kept`` over all batches.

        Identifiers are integers, and the smallest stays.  ``stored`` are the documents added so far: hits are
        compared with the texts of their keepers, and two texts of one digest are an error.  Keepers of earlier
        batches that a smaller identifier displaces are not told here; ``keepers`` gives them as they are now.
        """
        groups = written(exact_groups(docs, id_col, text_col, "smallest", self.digest), "batch")
        own = groups.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("n"))
        own = written(own.withColumn("keep_id", F.col("keep_id").cast("long")), "own")
        held = written(self.lookup(own.select("digest")), "held")
        if stored is not None:
            self._verified(docs, stored, held, id_col, text_col)
        self._commit(self._compacted([self._level(own), *self.levels()]))
        before = held.select("digest", F.col("keep_id").alias("old"), F.col("n").alias("more"))
        rows = groups.join(before, "digest", "left")
        keep = F.least("keep_id", "old")
        return rows.select("id", "digest", keep.alias("keep_id"), (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))

    def keepers(self) -> DataFrame:
        """``digest, keep_id, n`` of everything added so far."""
        tables = [self.spark.read.parquet(f"{path}/digests") for path, _ in self.levels()]
        whole = self.spark.createDataFrame([], "digest binary, keep_id long, n long")
        for t in tables:
            whole = whole.unionByName(t)
        return whole.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def _verified(self, docs: DataFrame, stored: DataFrame, held: DataFrame, id_col: str, text_col: str) -> None:
        size = filter_bits(held.count())
        bits = membership(held.select(filter_bit(F.col("digest"), size).alias("bit")))

        def texts(rows: DataFrame) -> DataFrame:
            text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
            told = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), self.digest(text).alias("digest"))
            return possible_members(told.withColumn("bit", filter_bit(F.col("digest"), size)), bits)

        keepers = texts(stored).join(held.select("digest", F.col("keep_id").alias("id")), ["digest", "id"]).select("digest", F.col("text").alias("known"))
        wrong = texts(docs).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).join(keepers, "digest").where("text <> known")
        if not wrong.isEmpty():
            raise ValueError("two texts have one digest; the index needs a stronger one")

    def _compacted(self, levels: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """Merge the newest levels while the next one is not ``FANOUT`` times as large."""
        while len(levels) > 1 and levels[1][1] < FANOUT * levels[0][1]:
            two = [self.spark.read.parquet(f"{path}/digests") for path, _ in levels[:2]]
            merged = two[0].unionByName(two[1]).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            levels = [self._level(merged), *levels[2:]]
        return levels
