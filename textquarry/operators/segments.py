"""Stored postings that grow by segments, and BM25 over them that skips blocks by their maxima.

* **Segments.**  A refresh adds one segment of the new rows and *tombstones* for rows that went; nothing else is written.
  ``FAN`` segments of like size are merged into one from their blocks, without reading a text again.
* **Blocks.**  A segment's rows are dealt into buckets of about ``BUCKET``; a block holds a term's postings in one bucket: row
  numbers as differences, weights and places, and apart from these its number of rows, greatest weight and least length.
* **Skipping.**  Maxima alone bound what a bucket's rows can score for a question.  The buckets of the greatest bounds are
  read first; the k-th best score there limits the rest, and only blocks of buckets whose bound reaches it are read.
* Phrases of several terms are matched where all their terms occur, as their frequency must be known before anything is scored.

Scores equal those of ``retrieval.bm25`` over the rows that live.

Defined cases: rows without a term count in the collection; an identifier that comes back lives in its newest segment only;
no rows give no results; a question without words has none.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import B, K1, PUSHED_TERMS, postings, query_phrases

#: Rows of a bucket, about; segments of a size that are merged; buckets that a question reads first.
BUCKET, FAN, FIRST = 256, 4, 2
#: Slack of bounds, above rounding errors of scores.
SLACK = 1e-9
AT = ["segment", "bucket"]


@dataclass
class Segment:
    """``blocks(segment, bucket, term, n, top, short, gaps, tf, spots)`` and ``rows(segment, bucket, row, id, len)``; ``path`` is where they
    are stored, ``size`` their number of rows."""

    name: str
    size: int
    blocks: DataFrame
    rows: DataFrame
    path: str | None = None


@dataclass
class Segments:
    """Segments, oldest first, and ``dead(segment, id)``."""

    spark: SparkSession
    parts: list[Segment]
    dead: DataFrame
    merged: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, rows: DataFrame, weights: dict[str, float] | None = None) -> Segments:
        spark = rows.sparkSession
        id_type = rows.schema["id"].dataType.simpleString()
        return cls(spark, [segment(rows, weights)], spark.createDataFrame([], f"segment string, id {id_type}"))

    def refreshed(self, rows: DataFrame, weights: dict[str, float] | None = None) -> Segments:
        """Of a new whole collection ``rows(id, ...)``: a segment of the rows that are new, tombstones for those that went."""
        known = self.live().select("segment", "id")
        gone = written(known.join(rows.select("id"), "id", "left_anti").select("segment", "id"), "gone")
        fresh = written(rows.join(known.select("id"), "id", "left_anti"), "fresh")
        parts = self.parts if fresh.isEmpty() else [*self.parts, segment(fresh, weights)]
        return Segments(self.spark, parts, self.dead.unionByName(gone))._compacted()

    def _compacted(self) -> Segments:
        """Tiers of ``FAN`` segments become one of the next; one merge for each tier that is full."""
        now = self
        while True:
            tiers: dict[int, list[Segment]] = {}
            for part in now.parts:
                tiers.setdefault(int(math.log(max(part.size, 1), FAN)), []).append(part)
            full = next((tier for _, tier in sorted(tiers.items()) if len(tier) >= FAN), None)
            if full is None:
                return now
            names = [p.name for p in full]
            chosen = Segments(now.spark, full, now.dead)
            one = packed(chosen.postings(), chosen.live().select("id", "len"))
            parts = [p for p in now.parts if p.name not in names]
            now = Segments(now.spark, [*parts, one], now.dead.where(~F.col("segment").isin(names)), [*now.merged, *names])

    def _union(self, name: str) -> DataFrame:
        whole = getattr(self.parts[0], name)
        for part in self.parts[1:]:
            whole = whole.unionByName(getattr(part, name))
        return whole

    def live(self) -> DataFrame:
        return self._union("rows").join(self.dead, ["segment", "id"], "left_anti")

    def blocks(self) -> DataFrame:
        return self._union("blocks")

    def postings(self) -> DataFrame:
        """``term, id, len, tf, spots`` of the rows that live."""
        return decoded(self.blocks()).join(self.live(), [*AT, "row"]).select("term", "id", "len", "tf", "spots")

    def saved(self, folder: str) -> str:
        """Write the segments that are not stored yet, the tombstones and a list of all; gives the list's path."""
        folder = folder.rstrip("/")
        for part in self.parts:
            if part.path is None:
                part.path = f"{folder}/segments/{part.name}"
                part.blocks.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{part.path}/blocks")
                part.rows.write.parquet(f"{part.path}/rows")
        path = f"{folder}/lists/{uuid.uuid4().hex}"
        self.dead.write.parquet(f"{path}/dead")
        listed = [(i, p.name, p.size, p.path) for i, p in enumerate(self.parts)]
        self.spark.createDataFrame(listed, "place long, name string, size long, path string").coalesce(1).write.parquet(f"{path}/parts")
        return path

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Segments:
        """By the path that ``saved`` gave."""
        parts = spark.read.parquet(f"{path}/parts").orderBy("place").collect()  # a row a segment
        stored = [Segment(p.name, p.size, spark.read.parquet(f"{p.path}/blocks"), spark.read.parquet(f"{p.path}/rows"), p.path) for p in parts]
        return cls(spark, stored, spark.read.parquet(f"{path}/dead"))

    def bm25(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """``q, rank, id, score`` of the best ``k`` for each of ``questions(q, question)``; ties by ``id``."""
        return _Search(self, questions, k).best()


def segment(rows: DataFrame, weights: dict[str, float] | None = None) -> Segment:
    """A segment of ``rows(id, ...)``, tokenised."""
    posted = written(postings(rows, weights), "posted")
    columns = F.dense_rank().over(Window.orderBy("column"))
    # A handful of column names, so that a place is one number.
    names = posted.select("column").where("column IS NOT NULL").distinct().withColumn("c", columns.cast("long"))
    spot = F.col("c") * (1 << 40) + F.col("at")
    terms = posted.where("term IS NOT NULL").join(F.broadcast(names), "column")
    counted = terms.groupBy("term", "id", "len").agg(F.sum("w").alias("tf"), F.array_sort(F.collect_list(F.struct(spot.alias("spot"), "w"))).alias("spots"))
    return packed(counted, posted.select("id", "len").distinct())


def packed(counted: DataFrame, lengths: DataFrame) -> Segment:
    """Blocks of ``counted(term, id, len, tf, spots)`` and of all rows ``lengths(id, len)``."""
    name = uuid.uuid4().hex
    lengths = written(lengths, "lengths")
    size = lengths.count()
    bucket = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // BUCKET)))).alias("bucket")
    within = Window.partitionBy("bucket").orderBy("id")
    rows = lengths.select(F.lit(name).alias("segment"), bucket, "id", "len").withColumn("row", F.row_number().over(within))
    rows = written(rows.select("segment", "bucket", "row", "id", "len"), "rows")
    placed = counted.drop("len").join(rows, "id")
    item = F.array_sort(F.collect_list(F.struct("row", "tf", "spots"))).alias("items")
    grouped = placed.groupBy("segment", "bucket", "term").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("top"), F.min("len").alias("short"), item)
    gaps = F.transform("items", lambda x, i: x["row"] - F.when(i > 0, F.get(F.col("items"), i - 1)["row"]).otherwise(0))
    blocks = grouped.select("segment", "bucket", "term", "n", "top", "short", gaps.alias("gaps"), F.col("items.tf").alias("tf"), F.col("items.spots").alias("spots"))
    return Segment(name, size, written(blocks, "blocks"), rows)


def decoded(blocks: DataFrame) -> DataFrame:
    """``segment, bucket, term, row, tf, spots``, differences summed."""
    numbers = F.aggregate("gaps", F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))))
    each = F.explode(F.arrays_zip(numbers.alias("row"), F.col("tf"), F.col("spots"))).alias("x")
    return blocks.select(*AT, "term", each).select(*AT, "term", F.col("x.row").alias("row"), F.col("x.tf").alias("tf"), F.col("x.spots").alias("spots"))


def gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class _Search:
    """One batch of questions; the steps are tables of their own, so that a test can count what is read."""

    def __init__(self, segments: Segments, questions: DataFrame, k: int) -> None:
        self.k, self.segments = k, segments
        self.asked = written(query_phrases(questions), "asked")
        terms = self.asked.select(F.explode("phrase").alias("term")).distinct()
        few = terms.limit(PUSHED_TERMS + 1).collect()
        blocks = segments.blocks()
        self.blocks = blocks.where(F.col("term").isin([r.term for r in few])) if len(few) <= PUSHED_TERMS else blocks.join(terms, "term", "left_semi")
        self.live = segments.live()
        self.stats = written(self.live.agg(F.count(F.lit(1)).alias("all"), F.avg("len").alias("mean")), "stats")
        self.maxima = written(self._maxima(), "maxima")

    def _phrases(self) -> DataFrame:
        """``phrase, segment, bucket, row, tf, len`` of the rows that hold a phrase of several terms at consecutive places."""
        longer = self.asked.select("phrase").distinct().where(F.size("phrase") > 1)
        parts = longer.select("phrase", F.array_distinct("phrase").alias("terms")).select("phrase", F.size("terms").alias("of"), F.explode("terms").alias("term"))
        common = self.blocks.select(*AT, "term").join(parts, "term").groupBy(*AT, "phrase", "of").agg(F.count(F.lit(1)).alias("have")).where("have = of")
        needed = common.join(parts.select("phrase", "term"), "phrase").select(*AT, "term").distinct()
        found = decoded(self.blocks.join(needed, [*AT, "term"], "left_semi"))
        spots = found.select(*AT, "row", "term", F.explode("spots").alias("s")).select(*AT, "row", "term", "s.spot", "s.w")
        placed = spots.join(longer.select("phrase", F.posexplode("phrase").alias("place", "term")), "term")
        runs = placed.groupBy("phrase", *AT, "row", "w", (F.col("spot") - F.col("place")).alias("from")).agg(F.count(F.lit(1)).alias("found"))
        many = runs.where(F.col("found") == F.size("phrase")).groupBy("phrase", *AT, "row").agg(F.sum("w").alias("tf"))
        return many.join(self.live, [*AT, "row"]).select("phrase", *AT, "row", "id", "len", "tf")

    def _maxima(self) -> DataFrame:
        """``phrase, segment, bucket, idf, top, short``: what bounds a phrase's share in the scores of a bucket."""
        single = self.asked.select("phrase").distinct().where(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term"))
        met = self.blocks.select(*AT, "term", "n", "top", "short").join(single, "term")
        self.longer = written(self._phrases(), "phrases")
        more = self.longer.groupBy("phrase", *AT).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("top"), F.min("len").alias("short"))
        bounds = met.select("phrase", *AT, "n", "top", "short").unionByName(more)
        # Blocks of buckets with tombstones are decoded to count the dead; others' counts stand.
        dead = self.segments._union("rows").join(self.segments.dead, ["segment", "id"]).select(*AT, "row")
        touched = self.blocks.join(dead.select(*AT).distinct(), AT, "left_semi").join(single.select("term"), "term", "left_semi")
        less = decoded(touched).join(dead, [*AT, "row"]).groupBy(F.array("term").alias("phrase")).agg(F.count(F.lit(1)).alias("less"))
        df = bounds.groupBy("phrase").agg(F.sum("n").alias("n")).join(less, "phrase", "left").select("phrase", (F.col("n") - F.coalesce("less", F.lit(0))).alias("df"))
        odds = F.ln((F.col("all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = df.where("df > 0").crossJoin(F.broadcast(self.stats)).select("phrase", F.when(odds > 0, odds).otherwise(1e-6).alias("idf"), "mean")  # one row of two numbers
        return bounds.join(idf, "phrase").select("phrase", *AT, "idf", "mean", "top", "short")

    def bounded(self) -> DataFrame:
        """``q, segment, bucket, bound, place``: the most a bucket's row can score, the greatest first."""
        each = self.maxima.join(self.asked, "phrase").groupBy("q", *AT).agg(F.sum(F.col("times") * F.col("idf") * gain(F.col("top"), F.col("short"), F.col("mean"))).alias("bound"))
        return each.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), *AT)))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """``q, id, score`` of the rows of ``pairs(q, segment, bucket)``.  What a phrase adds to a row is made once."""
        phrases = self.maxima.select("phrase", *AT, "idf", "mean")
        wanted = written(pairs.join(self.asked, "q").join(phrases, ["phrase", *AT]), "wanted")
        single = wanted.where(F.size("phrase") == 1).select(*AT, F.col("phrase")[0].alias("term")).distinct()
        one = decoded(self.blocks.join(single, [*AT, "term"], "left_semi").withColumn("spots", F.transform("tf", lambda _: F.lit(0))))
        one = one.join(self.live, [*AT, "row"]).select(F.array("term").alias("phrase"), *AT, "id", "len", "tf")
        shares = one.unionByName(self.longer.select("phrase", *AT, "id", "len", "tf")).join(wanted, ["phrase", *AT])
        own = F.col("times") * F.col("idf") * gain(F.col("tf"), F.col("len"), F.col("mean"))
        return shares.groupBy("q", "id").agg(F.sum(own).alias("score"))

    def reading(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs that are read first, their scores, and the pairs that their k-th best scores leave."""
        bounds = written(self.bounded(), "bounds")
        first = bounds.where(F.col("place") <= FIRST).select("q", *AT)
        scores = written(self.scored(first), "scores")
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        limit = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") == self.k).select("q", F.col("score").alias("limit"))
        rest = bounds.where(F.col("place") > FIRST).join(limit, "q", "left").where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit") - SLACK))
        return first, scores, written(rest.select("q", *AT), "rest")

    def best(self) -> DataFrame:
        _, scores, rest = self.reading()
        total = scores.unionByName(self.scored(rest))
        order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
        return total.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= self.k).select("q", "rank", "id", "score")
