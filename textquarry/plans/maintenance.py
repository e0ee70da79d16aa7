"""Queries that keep an index and its records: dangling references, summaries, statistics, unions, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, extraction, graph, incremental, structured, summaries
from .catalogue import Tables, query
from .corpus import LOC, PATH, _snapshots, as_files


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 10 THEN l_partkey END AS resolved_symbol_id FROM lineitem JOIN part ON l_partkey = p_partkey")
def dangling_references(t: Tables) -> DataFrame:
    """Line items refer to parts; small parts are gone."""
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("resolved_symbol_id"))
    return incremental.without_dangling(refs, t.part.where("p_size > 10").select(F.col("p_partkey").alias("symbol_id")))


@query(f"""WITH f AS (SELECT {PATH} AS path, source, doc_id, text FROM documents)
SELECT path, CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' ELSE 'repo' END AS scope, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN source ELSE 'all' END AS content FROM f""")
def best_summaries(t: Tables) -> DataFrame:
    """Paths that have a summary of every scope, of the two wider ones, or of the widest alone."""
    files = as_files(t.documents)
    every = F.array(F.struct(F.lit("repo").alias("scope"), F.lit("all").alias("content")), F.struct(F.lit("directory").alias("scope"), F.split("path", "/")[0].alias("content")), F.struct(F.lit("file").alias("scope"), F.col("content_hash").alias("content")))
    rows = files.select(F.col("path").alias("target_path"), F.explode(F.slice(every, F.lit(1), (3 - F.col("doc_id") % 3).cast("int"))).alias("s")).select("target_path", "s.scope", "s.content")
    return structured.best_summary(rows, files.select("path"))


@query(f"""
SELECT 'file' AS scope, {PATH} AS target_path, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS source_hash FROM documents WHERE doc_id % 10 <> 0 AND (doc_id % 7 = 0 OR doc_id % 10 = 3) AND {LOC} >= 5""")
def stale_summaries(t: Tables) -> DataFrame:
    """Summaries that the newer snapshot needs and the older one's do not give."""
    old, new = _snapshots(t.documents)
    # An exclamation mark at the end adds no line to a text that does not end with a break.
    make = lambda files: summaries.file_summaries(files, least=5)
    return summaries.stale(make(new), make(old)).select("scope", "target_path", "source_hash")


@query("SELECT lang, sha256(text) AS text_hash, count(*) AS n FROM documents WHERE text <> '' GROUP BY ALL")
def reassembled_files(t: Tables) -> DataFrame:
    """Whole texts put together again from chunks without overlap, in order."""
    chunks = chunking.window_chunks(t.documents, "doc_id", "lang", size=500, overlap=0)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "")
    files = chunks.groupBy("doc_id", "lang").agg(body.alias("text"))
    return files.groupBy("lang", F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status, lang FROM documents)
SELECT status, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM s GROUP BY status""")
def index_statistics(t: Tables) -> DataFrame:
    """Files by what happened to them between two snapshots, with their languages."""
    old, new = _snapshots(t.documents)
    status = incremental.diff(old, new).join(old.select("path", "language").unionByName(new.select("path", "language")).distinct(), "path")
    return status.groupBy("status").agg(F.count_distinct("path").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query("SELECT o_custkey AS source, max(o_orderdate) AS created_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS repo FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def latest_ready(t: Tables) -> DataFrame:
    """Per customer the latest order that is ready."""
    ready = t.orders.where("o_orderstatus <> 'F'")
    return ready.groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_orderdate").alias("created_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("repo"))


@query("""
WITH a AS (SELECT s_nationkey AS q, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier),
b AS (SELECT s_nationkey AS q, l_partkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT s_nationkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)),
u AS (SELECT q, id, rank, 0 AS part FROM a UNION ALL SELECT q, id, rank, 1 FROM b WHERE (q, id) NOT IN (SELECT (q, id) FROM a))
SELECT q, row_number() OVER (PARTITION BY q ORDER BY part, rank) AS rank, id FROM u""")
def ranked_union(t: Tables) -> DataFrame:
    """By nation: its suppliers, then the numbers of the parts they sell that are none of theirs."""
    from pyspark.sql import Window

    by = lambda c: F.row_number().over(Window.partitionBy("q").orderBy(c))
    first = t.supplier.select(F.col("s_nationkey").alias("q"), F.col("s_suppkey").alias("id")).withColumn("rank", by("id"))
    sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("q"), F.col("l_partkey").alias("id")).distinct()
    return graph.ranked_union(first.select("q", "rank", "id"), sold.withColumn("rank", by("id")).select("q", "rank", "id"))


@query("""SELECT concat('pkg/m', p_partkey, '.py') AS path, concat('pkg.m', p_size) AS module, CASE WHEN p_size IN (SELECT p_partkey FROM part) THEN concat('pkg/m', p_size, '.py') END AS target FROM part""")
def import_targets(t: Tables) -> DataFrame:
    """A module per part that imports the module numbered by the part's size."""
    files = t.part.select(F.format_string("pkg/m%d.py", "p_partkey").alias("path"), F.format_string("from pkg.m%d import x\n", "p_size").alias("text"))
    return extraction.import_targets(extraction.import_edges(files), files).select("path", "module", "target")
