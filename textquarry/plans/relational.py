"""Queries that join: lookups, references, resolution, nearest and enclosing matches, answers, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import answers, chunking, evaluation, structured
from .catalogue import Tables, query
from .corpus import LOC, PATH, as_files


@query("""SELECT p_brand AS q, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_type, p_partkey) AS rank, p_partkey AS symbol_id FROM part""")
def definition_lookup(t: Tables) -> DataFrame:
    """All parts as symbols named by brand, looked up by every brand."""
    symbols = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("file_id"), (F.col("p_size") > 25).alias("is_exported"), F.col("p_partkey").alias("start_line"))
    files = t.part.select(F.col("p_type").alias("file_id"), F.col("p_type").alias("path")).distinct()
    names = t.part.select(F.col("p_brand").alias("q"), F.col("p_brand").alias("name")).distinct()
    return structured.definitions(symbols, files, names).select("q", "rank", "symbol_id")


@query(r"""
WITH q AS (SELECT item_id AS q, concat('Where is the function `', p_brand, '_x` or ', replace(p_type, ' ', '_'), ' defined') AS question, p_brand, p_type FROM benchmark JOIN part ON p_partkey = item_id + 1),
s AS (SELECT p_partkey AS symbol_id, replace(p_type, ' ', '_') AS name FROM part)
SELECT q, name, symbol_id FROM q JOIN s ON s.name = replace(p_type, ' ', '_')""")
def locate(t: Tables) -> DataFrame:
    """The first name in each question that is defined, with all its definitions."""
    p = t.benchmark.join(t.part, F.col("p_partkey") == F.col("item_id") + 1)
    question = F.concat(F.lit("Where is the function `"), "p_brand", F.lit("_x` or "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" defined"))
    names = p.select(F.col("item_id").alias("q"), F.posexplode(fn.candidate_names(question)).alias("priority", "name"))
    symbols = t.part.select(F.col("p_partkey").alias("symbol_id"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("name"))
    return structured.located(names, symbols).select("q", "name", "symbol_id")


@query("SELECT c_custkey, c_name, n_name, c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def list_endpoints_left(t: Tables) -> DataFrame:
    known = t.nation.where("n_regionkey <> 2")
    return t.customer.join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "c_mktsegment").orderBy(F.asc_nulls_first("n_name"), "c_custkey")


@query("""SELECT n_name AS caller, o_orderpriority AS name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2 GROUP BY n_name, o_orderpriority""")
def find_references(t: Tables) -> DataFrame:
    """Line items as references resolved to orders, placed in customers, called from nations where known."""
    refs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    refs = refs.select(F.col("l_orderkey").alias("resolved_symbol_id"), F.col("c_custkey").alias("from_file_id"), F.col("c_nationkey").cast("long").alias("from_symbol_id"), "l_extendedprice")
    orders = t.orders.select(F.col("o_orderkey").alias("symbol_id"), F.col("o_orderpriority").alias("name"))
    nations = t.nation.where("n_regionkey <> 2").select((-F.col("n_nationkey") - 1).cast("long").alias("symbol_id"), F.col("n_name").alias("name"))
    files = t.customer.select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    names = orders.select("name", F.col("name").alias("q")).distinct()
    refs = refs.withColumn("from_symbol_id", -F.col("from_symbol_id") - 1)
    found = structured.references(refs, orders.unionByName(nations), files, names)
    return found.groupBy("caller", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"""
WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((len(text) - 1500) / 1300.0)) AS BIGINT) + 1)) AS k FROM documents WHERE len(text) > 0),
c AS (SELECT doc_id, k, substr(text, k * 1300 + 1, 1500) AS content, substr(text, 1, k * 1300) AS before FROM w),
r AS (SELECT doc_id, k, 1 + len(before) - len(replace(before, chr(10), '')) AS s, len(before) - len(replace(before, chr(10), '')) + len(content) - len(replace(substr(content, 1, len(content) - 1), chr(10), '')) AS e FROM c),
p AS (SELECT doc_id, unnest(range(1, {LOC} + 1)) AS line FROM documents),
j AS (SELECT p.doc_id, p.line, r.k, row_number() OVER (PARTITION BY p.doc_id, p.line ORDER BY r.e - r.s, r.s, r.k) AS rn FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND r.s <= p.line AND p.line <= r.e)
SELECT doc_id, line, k AS range_id FROM j WHERE rn = 1""")
def enclosing_range(t: Tables) -> DataFrame:
    """For every line of every document the smallest chunk around it."""
    chunks = chunking.window_chunks(t.documents, "doc_id").select("doc_id", F.col("k").alias("range_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    points = t.documents.where("text <> ''").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), fn.line_count(F.col("text")))).alias("line")).withColumn("point_id", F.col("line"))
    return structured.smallest_enclosing(points, chunks, "doc_id").select("doc_id", "line", "range_id")


@query("""
WITH s AS (SELECT p_partkey AS id, p_brand AS file, concat(p_type, p_size) AS name FROM part), n AS (SELECT file, name, count(*) AS c, min(id) AS m FROM s GROUP BY file, name),
w AS (SELECT name, count(*) AS c, min(id) AS m FROM s GROUP BY name), l AS (SELECT l_orderkey, l_linenumber, concat('Brand#', 11 + l_suppkey % 5) AS file, concat(p_type, p_size) AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN n.c = 1 THEN n.m WHEN n.c > 1 THEN NULL WHEN w.c = 1 THEN w.m END AS resolved FROM l LEFT JOIN n ON l.file = n.file AND l.name = n.name LEFT JOIN w ON l.name = w.name""")
def resolve_unique(t: Tables) -> DataFrame:
    symbols = t.part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), F.concat("p_type", F.col("p_size").cast("string")).alias("name"))
    calls = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (11 + F.col("l_suppkey") % 5).cast("string")).alias("file"), F.concat("p_type", F.col("p_size").cast("string")).alias("name"))
    return structured.resolved(calls, symbols).select("l_orderkey", "l_linenumber", "resolved")


@query("""
WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'click'),
j AS (SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id, abs(l.t - r.t) AS distance, row_number() OVER (PARTITION BY l.event_id ORDER BY CASE WHEN r.t IS NULL THEN 1 ELSE 0 END, abs(l.t - r.t), r.event_id) AS rn FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT user_id, left_id, right_id, distance FROM j WHERE rn = 1""")
def nearest_match(t: Tables) -> DataFrame:
    """For every click the same user's other event that is nearest in time."""
    e = t.events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"), F.col("t").alias("at"))
    right = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("right_id"), F.col("t").alias("start"))
    return structured.nearest_start(left, right, ["user_id"])


def _turns(t: Tables) -> DataFrame:
    c = t.conversations
    user = c.where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select(F.col("conv_id").alias("of"), (F.col("turn") - 1).alias("at"), F.col("text").alias("answer"))
    return user.join(reply, (F.col("session") == F.col("of")) & (F.col("turn") == F.col("at")), "left").select("session", "turn", "question", "answer")


@query(r"""
WITH p AS (SELECT u.conv_id AS session, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS back FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS place FROM r WHERE back <= 3)
SELECT session, place, turn, sha256(question) AS question_hash, sha256(answer) AS answer_hash,
       regexp_matches(question, '(?i)\b(?:it|its|it''s|this|that|these|those|they|them|their|the same|that one|the above|the previous one)\b') AS follow_up FROM k""")
def recent_turns(t: Tables) -> DataFrame:
    rows = answers.recent_turns(_turns(t))
    return rows.select("session", "place", "turn", F.sha2("question", 256).alias("question_hash"), F.sha2("answer", 256).alias("answer_hash"), "follow_up")


@query("""
WITH p AS (SELECT u.conv_id AS session, CASE WHEN u.text IS NOT NULL THEN greatest(1, length(u.text) // 4) END AS i, CASE WHEN a.text IS NOT NULL THEN greatest(1, length(a.text) // 4) END AS o FROM conversations u
LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
s AS (SELECT session, count(*) AS calls, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens FROM p GROUP BY session)
SELECT session, calls, input_tokens, output_tokens, round(input_tokens / 1000 * 0.003 + output_tokens / 1000 * 0.015, 9) AS cost FROM s""")
def answer_usage(t: Tables) -> DataFrame:
    """Tokens that the turns of each conversation take and give, and their cost."""
    size = lambda c: F.when(F.col(c).isNotNull(), fn.token_estimate(F.col(c)))
    rows = answers.usage(_turns(t).select("session", size("question").alias("input_tokens"), size("answer").alias("output_tokens")), "session")
    return rows.withColumn("cost", F.round("cost", 9))


CASES = ["where is %s", "how does %s work", "which npm packages use %s", "trace the route of %s", "what does this repo do with %s", "list all endpoints of %s", "%s", "how is %s implemented"]
CASE_SQL = "CASE (conv_id + turn) % 8 " + " ".join("WHEN {} THEN concat('{}', text, '{}')".format(i, *c.split("%s")) for i, c in enumerate(CASES)) + " END"


@query(rf"""
WITH q AS (SELECT conv_id, turn, {CASE_SQL} AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)\btrace\b|\bwalk me through\b') THEN 'explain'
  WHEN regexp_matches(q, '(?i)\b(?:library|libraries|packages?|dependency|dependencies|npm|pypi|gems?|crates?)\b') THEN 'dependencies'
  WHEN regexp_matches(q, '(?i)\b(?:endpoints?|routes?)\b|\bapi\s+(?:does|expose|surface|look)\b|\brest\s+api\b|\bhttp\s+(?:api|endpoints?)\b') THEN 'endpoints'
  WHEN regexp_matches(q, '(?i)^\s*where\s+(?:is|are|does)\b|\bwhich file\b') THEN 'locate' WHEN regexp_matches(q, '(?i)\bwhat does this (?:repo|project|codebase|application|app|service) do\b|\bsummar(?:y|ize)\b') THEN 'overview'
  WHEN regexp_matches(q, '(?i)\bhow does\b|\bhow is .*implemented\b') THEN 'explain' END AS route FROM q""")
def route_questions(t: Tables) -> DataFrame:
    """Every turn, asked in one of eight ways."""
    question = F.col("text")
    for i, case in enumerate(CASES):
        before, after = case.split("%s")
        question = F.when((F.col("conv_id") + F.col("turn")) % len(CASES) == i, F.concat(F.lit(before), "text", F.lit(after))).otherwise(question)
    return t.conversations.select("conv_id", "turn", fn.route_question(question).alias("route"))


@query(f"""
WITH d AS (SELECT doc_id, {PATH} AS path, {LOC} AS loc FROM documents),
c AS (SELECT doc_id, 1 + doc_id % 9 <= 2 + doc_id % 9 AND 2 + doc_id % 9 <= loc AS a, doc_id % 4 <> 0 AND loc >= 1 AS b FROM d)
SELECT doc_id AS answer_id, CAST(a::INT + b::INT AS BIGINT) AS n_valid, CAST(3 - a::INT - b::INT AS BIGINT) AS n_invalid, (a::INT + b::INT) / 3.0::DOUBLE AS validity, NOT b OR NOT a AS unsupported_claim FROM c""")
def verify_citations(t: Tables) -> DataFrame:
    """Answers that cite their document: lines that may lie beyond its end, an unknown file, and a first line."""
    files = as_files(t.documents)
    i = F.col("doc_id")
    mark = lambda path, a, b: F.concat(F.lit("["), path, F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("]"))
    text = F.concat(F.lit("It is here "), mark(F.col("path"), 1 + i % 9, 2 + i % 9), F.lit(" and "), mark(F.lit("no/such.py"), F.lit(1), F.lit(2)), F.lit(". Nothing is cited.\nAlso "), mark(F.col("path"), F.when(i % 4 == 0, 0).otherwise(1), F.lit(1)))
    return answers.verification(files.select(i.alias("answer_id"), text.alias("text")), files.select("path", "loc"))


def _scores(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = t.events
    hit = evaluation.recall_hit(F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("event_id") % 3).cast("string"))), F.array((F.col("user_id") % 3).cast("string"), F.lit("x")))
    return e.select(F.col("event_type").alias("route"), hit.alias("recall_hit"), (F.col("value") / 100).alias("citation_validity"), (k % 3).alias("correctness"), F.col("value").alias("latency_ms"), k.alias("input_tokens"), F.round(fn.cost(k, F.col("user_id")), 9).alias("cost_usd"), F.when(F.col("event_id") % 13 == 0, F.lit("failed")).alias("error"))


METRICS = """
count(*) AS n, count(error) AS n_errors, round(avg(hit), 6) AS recall, round(avg(value / 100), 6) AS validity, round(avg(k % 3), 6) AS correctness, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50,
round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95, CAST(coalesce(sum(k), 0) AS BIGINT) AS input_tokens, round(coalesce(sum(round(k / 1000.0::DOUBLE * 0.003 + user_id / 1000.0::DOUBLE * 0.015, 9)), 0), 4) AS cost_usd"""


@query(f"""
WITH s AS (SELECT event_type AS route, value, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 13 = 0 THEN 'failed' END AS error,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = user_id % 3 THEN 1.0 ELSE 0.0 END AS hit FROM events)
SELECT route, {METRICS} FROM s GROUP BY ROLLUP (route)""")
def eval_by_route(t: Tables) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("recall", "validity", "correctness", "p50", "p95")}
    return evaluation.by_route(_scores(t)).withColumns(rounded | {"cost_usd": F.round("cost_usd", 4)})


@query("""
WITH m AS (SELECT event_type AS metric, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)
SELECT 'all' AS suite, metric, day AS "at", value, lag(value) OVER (PARTITION BY metric ORDER BY day) AS previous, round(value - lag(value) OVER (PARTITION BY metric ORDER BY day), 6) AS delta FROM m""")
def report_delta(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.lit("all").alias("suite"), F.col("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("at")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.deltas(daily).withColumn("delta", F.round("delta", 6))


def _by_range(t: Tables) -> DataFrame:
    """Parts by brand and fifty keys, so that groups grow in number, not in length."""
    return t.part.withColumn("p_brand", F.concat("p_brand", F.lit("/f"), F.floor(F.col("p_partkey") / 50).cast("string")))


RANGES = "(SELECT * REPLACE (concat(p_brand, '/f', p_partkey // 50) AS p_brand) FROM part)"


@query("SELECT p_brand AS manifest, count(*) AS n, string_agg(p_name, ', ' ORDER BY p_name) AS names FROM part GROUP BY p_brand")
def manifest_group(t: Tables) -> DataFrame:
    return structured.by_manifest(t.part.select(F.col("p_brand").alias("manifest"), F.col("p_name").alias("name")))


@query(f"""SELECT p_brand AS q, concat('Parts of ', p_brand, chr(10), string_agg(concat('- ', p_name, ' (', p_size, ')'), chr(10) ORDER BY p_type, p_partkey)) AS text FROM {RANGES} GROUP BY p_brand""")
def structured_answers(t: Tables) -> DataFrame:
    line = F.format_string("- %s (%d)", "p_name", "p_size")
    return answers.listed_answer(_by_range(t).withColumn("q", F.col("p_brand")), "q", F.concat(F.lit("Parts of "), "p_brand"), line, ["p_type", "p_partkey"])


@query("""
WITH a AS (SELECT conv_id * 1000 + turn AS q, role AS route, string_split(text, ' ') AS w FROM conversations), e AS (SELECT q, 1 + len(w) + 1 + 2 AS n, w FROM a), x AS (SELECT q, n, w, unnest(range(0, n)) AS seq FROM e)
SELECT q, seq, CASE WHEN seq = 0 THEN 'status' WHEN seq = 1 THEN 'sources' WHEN seq = n - 2 THEN 'citations' WHEN seq = n - 1 THEN 'done' ELSE 'token' END AS event, CASE WHEN seq > 1 AND seq < n - 2 THEN w[seq - 1] END AS token FROM x""")
def answer_events(t: Tables) -> DataFrame:
    """Every turn's text as an answer, streamed as events."""
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("role").alias("route"), "text", F.array(F.struct(F.col("conv_id").alias("id"))).alias("sources"))
    return answers.events(rows).select("q", F.col("seq").cast("long").alias("seq"), "event", F.when(F.col("event") == "token", F.get_json_object("data", "$.text")).alias("token"))
