"""Ranking: BM25 with phrases, exact nearest neighbours, rank fusion, reranking, merging of spans.

Every operator works on a batch of questions keyed by ``q``.  Questions are the small side; whether they are
broadcast is Spark's decision by their measured size, never assumed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# Parameters of the ranking functions.
K1, B = 1.2, 0.75
WEIGHTS = {"content": 1.0, "symbol_name": 2.0, "path": 0.5}
RRF_K, KEEP, GAP = 60, 12, 2
TOKEN = r"([\p{L}\p{N}]+)"
QUERY_WORD = r"((?U:\w+))"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def query_phrases(questions: DataFrame) -> DataFrame:
    """``q, phrase, times``: the words of ``questions(q, question)`` as arrays of terms.

    A word may fall into several terms (``get_user`` does), which then count as a phrase.  Words that a
    question repeats count each time.
    """
    words = questions.select("q", F.explode(F.regexp_extract_all(F.lower("question"), F.lit(QUERY_WORD), F.lit(1))).alias("word"))
    phrases = words.select("q", tokens(F.col("word")).alias("phrase")).where(F.size("phrase") > 0)
    return phrases.groupBy("q", "phrase").agg(F.count(F.lit(1)).alias("times"))


def postings(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``term, id, len, w, column, at``: every term of ``rows(id, ...)`` with its place, and its row's length in terms.

    Rows without a term have one posting with a null term, so that they are counted.
    """
    weights = weights or WEIGHTS
    columns = [c for c in weights if c in rows.columns]

    def posted_terms(column: str) -> Column:
        found = tokens(F.coalesce(F.col(column), F.lit("")))
        return F.transform(found, lambda t, i: F.struct(F.lit(float(weights[column])).alias("w"), F.lit(column).alias("column"), t.alias("term"), i.alias("at")))

    terms = rows.select("id", F.concat(*map(posted_terms, columns)).alias("terms"))
    return terms.select("id", F.size("terms").alias("len"), F.explode_outer("terms").alias("t")).select("t.term", "id", "len", "t.w", "t.column", "t.at")


def collection_stats(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row ``n, avgdl``: how many rows there are, and their mean length in terms."""
    columns = [c for c in weights or WEIGHTS if c in rows.columns]
    lengths = [F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(TOKEN)) for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(sum(lengths, F.lit(0))).alias("avgdl"))


#: Terms of a batch of questions that are pushed down to stored postings at most; more are joined.
PUSHED_TERMS = 2000


def bm25_over(posted: DataFrame, stats: DataFrame, questions: DataFrame, k: int = 10, prune: bool = False) -> DataFrame:
    """``q, rank, id, score`` of the best ``k`` by ``postings`` and ``collection_stats``; ties by ``id``.

    What a phrase adds to a row's score does not depend on the question, so it is computed once per phrase and row,
    and questions meet these numbers, not the tokens.  With ``prune`` the questions' terms, if there are few, are
    pushed down, so that postings stored in the order of terms are read for these alone.
    """
    asked = query_phrases(questions)
    phrases = asked.select("phrase").distinct()
    if prune:
        few = phrases.select(F.explode("phrase").alias("term")).distinct().limit(PUSHED_TERMS + 1).collect()
        if len(few) <= PUSHED_TERMS:
            posted = posted.where(F.col("term").isin([r.term for r in few]))
    # Single terms are summed as they are; longer phrases must stand at consecutive places of one column.
    single = phrases.where(F.size("phrase") == 1).select("phrase", F.col("phrase")[0].alias("term"))
    one = posted.join(single, "term").groupBy("phrase", "id", "len").agg(F.sum("w").alias("tf"))
    longer = phrases.where(F.size("phrase") > 1).select("phrase", F.posexplode("phrase").alias("place", "term"))
    runs = posted.join(longer, "term").groupBy("phrase", "id", "len", "column", "w", (F.col("at") - F.col("place")).alias("from")).agg(F.count(F.lit(1)).alias("found"))
    many = runs.where(F.col("found") == F.size("phrase")).groupBy("phrase", "id", "len").agg(F.sum("w").alias("tf"))
    tf = one.unionByName(many).where("tf > 0")  # always so; with it both uses below share one shuffle
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, "phrase").crossJoin(F.broadcast(stats))  # one row of two numbers
    odds = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(odds > 0, odds).otherwise(F.lit(1e-6))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    total = scored.select("phrase", "id", gain.alias("gain")).join(asked, "phrase").groupBy("q", "id").agg(F.sum(F.col("gain") * F.col("times")).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", F.col("rank").cast("long").alias("rank"), "id", "score")


#: A batch of questions counts as small by the cells of its table of questions and phrases; entries of a table that a task makes at a time.
CELLS, DENSE = 1 << 20, 1 << 22
#: Terms of rows that a worker takes at a time.
HELD_TERMS = 1 << 20
#: Slack of scores, above rounding to nine places.
SLACK = 2e-9


def bm25(rows: DataFrame, questions: DataFrame, k: int = 10, weights: dict[str, float] | None = None, once: bool = False) -> DataFrame:
    """The same over ``rows(id, ...)`` that have no stored postings.

    For a small batch of questions a row's terms stay in its task: the row is cut to the phrases that it holds, and a table of
    rows and phrases times one of phrases and questions gives its scores.  Many questions are joined, as are different rows
    that share an ``id``.  Copies of a row add up; with ``once`` they are one row of the collection, as in stored postings.
    """

    def joined() -> DataFrame:
        posted = postings(rows, weights)
        if not once:
            return bm25_over(posted, collection_stats(rows, weights), questions, k)
        lengths = posted.select("id", "len").distinct()
        return bm25_over(posted, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")), questions, k)

    asked = query_phrases(questions)
    few = asked.limit(CELLS + 1).collect()
    if not few or len(few) > CELLS or len({r.q for r in few}) * len({tuple(r.phrase) for r in few}) > CELLS:
        return joined()
    phrases = sorted({tuple(r.phrase) for r in few})
    counts = [F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("ids")]
    held = written(held_phrases(rows, phrases, weights), "held")
    stats = held.agg(*counts).first()
    if stats.n and stats.ids < stats.n:
        copies = held.groupBy("id", "len", "phrases", "tf").agg(F.count(F.lit(1)).alias("copies"))
        held = written(copies.select("id", "len", "phrases", F.transform("tf", lambda x: x * F.col("copies")).alias("tf")), "held")
        merged = held.agg(*counts).first()
        if merged.ids < merged.n:
            return joined()
        stats = merged if once else stats
    df = np.zeros(len(phrases))
    for r in held.select(F.explode("phrases").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("df")).collect():  # a row a phrase
        df[r.p] = r.df
    total = best_held(held, few, phrases, stats.n, stats.avgdl or 1.0, df, k)
    asking = rows.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(r.q for r in few))), f"place int, q {questions.schema['q'].dataType.simpleString()}")
    total = total.join(F.broadcast(asking), "place").select("q", "id", "score")  # a row a question, of a small batch
    best = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", F.col("rank").cast("long").alias("rank"), "id", "score")


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")


def held_parts(batch: pa.RecordBatch, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch by about ``HELD_TERMS``; ``lengths`` are the terms of its rows."""
    upto = np.cumsum(lengths) // HELD_TERMS
    edges = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(start, stop - start) for start, stop in zip(edges, edges[1:]) if start < stop)


def held_phrases(rows: DataFrame, phrases: list[tuple[str, ...]], weights: dict[str, float] | None = None) -> DataFrame:
    """``id, len, phrases, tf``: of every row its length in terms, the numbers of the phrases that it holds and their weighted counts."""
    weights = weights or WEIGHTS
    columns = [c for c in weights if c in rows.columns]
    terms = pa.array(sorted({t for p in phrases for t in p}), pa.string())
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    single = np.full(len(terms) + 1, -1)
    for i, p in enumerate(phrases):
        if len(p) == 1:
            single[number[p[0]]] = i
    longer: dict[int, list[tuple[int, list[int]]]] = {}
    for i, p in enumerate(phrases):
        if len(p) > 1:
            longer.setdefault(number[p[0]], []).append((i, [number[t] for t in p]))
    id_type = rows.schema["id"].dataType.simpleString()

    def found(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and phrases, one for each place where a phrase begins."""
        own = np.repeat(np.arange(len(column)), _sizes(column))
        codes = pc.fill_null(pc.index_in(column.flatten(), value_set=terms), len(terms)).to_numpy(zero_copy_only=False)
        at, what = [np.arange(len(codes))], [single[codes]]
        for first, several in longer.items():
            begins = np.flatnonzero(codes == first)
            for phrase, parts in several:
                here = begins[begins + len(parts) <= len(codes)]
                for i, part in enumerate(parts):
                    here = here[(codes[here + i] == part) & (own[here + i] == own[here])]
                at.append(here)
                what.append(np.full(len(here), phrase))
        at, what = np.concatenate(at), np.concatenate(what)
        return own[at[what >= 0]], what[what >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held_parts(batch, sum(_sizes(batch.column(i + 1)) for i in range(len(columns)))):
                lengths = sum(_sizes(part.column(i + 1)) for i in range(len(columns)))
                pairs, w = [], []
                for i, c in enumerate(columns):
                    own, what = found(part.column(i + 1))
                    pairs.append(own * len(phrases) + what)
                    w.append(np.full(len(own), float(weights[c])))
                pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
                tf = np.bincount(inverse, np.concatenate(w), len(pair))
                pair, tf = pair[tf > 0], tf[tf > 0]
                offsets = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * len(phrases)).astype("i4"))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((pair % len(phrases)).astype("i4"), tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths.astype("i4")), *lists], ["id", "len", "phrases", "tf"])

    found_terms = rows.select("id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"terms{i}") for i, c in enumerate(columns)])
    return found_terms.mapInArrow(run, f"id {id_type}, len int, phrases array<int>, tf array<double>")


def best_held(held: DataFrame, asked: list[Row], phrases: list[tuple[str, ...]], n: int, avgdl: float, df: np.ndarray, k: int) -> DataFrame:
    """``place, id, score``: for each question, by its place among those of ``asked``, the rows that may be among its best ``k``."""
    odds = np.log((n - df + 0.5) / (df + 0.5))
    idf = np.where(odds > 0, odds, 1e-6)
    places = {q: i for i, q in enumerate(dict.fromkeys(r.q for r in asked))}
    number = {p: i for i, p in enumerate(phrases)}
    times = np.zeros((len(phrases), len(places)))
    for r in asked:
        times[number[tuple(r.phrase)], places[r.q]] = r.times
    step = max(1, DENSE // max(times.shape))
    id_type = held.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own = np.repeat(np.arange(part.num_rows), _sizes(part.column(2)))
                what, tf = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                length = part.column(1).to_numpy(zero_copy_only=False)[own]
                table = np.zeros((part.num_rows, len(phrases)))
                table[own, what] = idf[what] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))
                scores = table @ times
                # Ties at the k-th place stay; ``id`` decides when all rows are known.
                last = np.partition(scores, -k, axis=0)[-k] if k < len(scores) else np.zeros(len(places))
                row, place = np.nonzero((scores > 0) & (scores >= last - SLACK))
                yield pa.RecordBatch.from_arrays([pa.array(place.astype("i4")), part.column(0).take(pa.array(row)), pa.array(scores[row, place])], ["place", "id", "score"])

    return held.mapInArrow(run, f"place int, id {id_type}, score double")


def normalised(vector: Column) -> Column:
    """A vector of length one, in doubles; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    # The norm goes into an array of one, over which the outer lambda runs: it is evaluated once, not per element.
    divided = F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)), lambda n: F.transform(wide, lambda x: x / n))
    return divided[0]


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """``q, rank, id, distance``: exact nearest of ``vectors(id, v)`` for each of ``queries(q, v)``.

    Queries are counted and dealt into blocks of about ``block``, the only thing that is broadcast; every
    task compares its own vectors with a block, and best lists are cut per task before they move.
    """
    made = queries.select("q", normalised(F.col("v")).alias("w"))
    rows = vectors.select("id", normalised(F.col("v")).alias("v"))
    blocks = max(1, -(-queries.count() // block))
    best = Window.partitionBy("q").orderBy(F.round("distance", 9), "id")
    found = None
    for i in range(blocks):
        part = made.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        pairs = rows.crossJoin(F.broadcast(part)).select("q", "id", l2(F.col("v"), F.col("w")).alias("distance"))
        pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = pairs if found is None else found.unionByName(pairs)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id", "distance")


def hash_vectors(texts: DataFrame, key: str, dimensions: int = 32) -> DataFrame:
    """``key, v``: signed counts of hashed words as a vector of length one; keys without a word have none.

    Words stay in their task, and each that a part of a batch holds is hashed once; a row's sums move, as rows may share a key.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in held_parts(batch, _sizes(batch.column(1))):
                sizes = _sizes(part.column(1))
                told = part.column(1).flatten().dictionary_encode()
                # The last bits decide both the place and the sign.
                tail = np.array([int.from_bytes(hashlib.sha256(w.encode()).digest()[-2:], "big") for w in told.dictionary.to_pylist()], "i8")[told.indices.to_numpy()]
                sign = np.where(tail // dimensions % 2 == 0, 1, -1)
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dimensions + tail % dimensions, sign, len(sizes) * dimensions)
                held = np.flatnonzero(sizes)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(held) + 1) * dimensions).astype("i4")), pa.array(sums.reshape(-1, dimensions)[held].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(held)), lists], [key, "raw"])

    words = texts.select(key, F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s]+)"), F.lit(1)).alias("words"))
    sums = [F.sum(F.get("raw", F.lit(i))).alias(f"d{i}") for i in range(dimensions)]
    rows = words.mapInArrow(run, f"{key} {key_type}, raw array<double>").groupBy(key).agg(*sums).select(key, F.array(*[f"d{i}" for i in range(dimensions)]).alias("raw"))
    return rows.select(key, normalised(F.col("raw")).alias("v"))


def hash_embedding(texts: DataFrame, key: str, dimensions: int = 32) -> DataFrame:
    """``key, dim, value``: the same with a row per value; zeros are left out."""
    rows = hash_vectors(texts, key, dimensions).select(key, F.posexplode("v").alias("dim", "value"))
    return rows.select(key, F.col("dim").cast("long").alias("dim"), "value").where("value <> 0")


def reciprocal_rank_fusion(lists: list[DataFrame], top: int = 30, k: int = RRF_K) -> DataFrame:
    """``q, rank, id, score`` from ranked lists ``(q, rank, id)``; ties by the lists' own ranks in order."""
    tagged = [df.select("q", "id", "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    own = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank{i}") for i in range(len(lists))]
    fused = union.groupBy("q", "id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"), *own)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), *[F.asc_nulls_last(f"rank{i}") for i in range(len(lists))], "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("q", "rank", "id", "score")


def reranked(ranked: DataFrame, orders: DataFrame, keep: int = KEEP) -> DataFrame:
    """Apply ``orders(q, order)``, zero-based places or null, to ``ranked(q, rank, id)``.

    Lists of ``keep`` or fewer stay as they are; without an order a list is cut; places not named drop out.
    """
    size = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    named = orders.select("q", "order").where("order IS NOT NULL")
    rows = ranked.join(size, "q").join(named, "q", "left")
    place = F.array_position("order", (F.col("rank") - 1).cast("int"))
    new = F.when((F.col("n") <= keep) | F.col("order").isNull(), F.col("rank")).when(place > 0, place)
    return rows.withColumn("new", new).where(F.col("new") <= keep).select("q", F.col("new").cast("long").alias("rank"), "id")


def merge_adjacent(spans: DataFrame, gap: int = GAP) -> DataFrame:
    """Merge spans ``(q, rank, id, path, start, end, symbol, content)`` of a file that touch or nearly do.

    A span joins those before it while it starts no later than ``gap`` lines after the last of their ends.
    Files come in the order in which the ranking first names them.
    """
    inside = Window.partitionBy("q", "path").orderBy("start", "rank")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("file_rank", F.min("rank").over(Window.partitionBy("q", "path")))
    pieces = F.array_sort(F.collect_list(F.struct("start", "rank", "id", "symbol", "content")))
    named = lambda x: F.coalesce(x["symbol"], F.lit("")) != ""
    done = rows.groupBy("q", "path", "file_rank", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_merged"), pieces.alias("p"))
    content = F.array_join(F.transform("p", lambda x: x["content"]), "\n")
    return done.select("q", "file_rank", "path", "start", "end", "n_merged", F.col("p")[0]["id"].alias("id"), F.try_element_at(F.filter("p", named), F.lit(1))["symbol"].alias("symbol"), content.alias("content"))
