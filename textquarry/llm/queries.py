"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_trees, exact_dedup, line_dedup, mixing, prefix_trie, pu_quality, quality_rules, secrets, simhash, spelling, substring_dedup, warc
from .common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


#: The table of pages has no dates; a crawl's own date goes here.
CAPTURED = "2024-01-01T00:00:00Z"


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = pu_quality.scored(docs, pu_quality.fit(docs, quality_labels(spark, sf_dir)))
    held = pu_quality.held_out(F.col("id")).alias("held_out")
    return rows.select(F.col("id").alias("doc_id"), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_labels(spark, sf_dir).where("label = 1")
    return quality_rules.quality_rules(documents(spark, sf_dir), trusted).withColumnRenamed("id", "doc_id")


def _kept_digest(rows: DataFrame, counted: str) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.col("n_tokens").alias(counted), "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(substring_dedup.substring_deduplicated(documents(spark, sf_dir)), "n_words")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(line_dedup.line_deduplicated(documents(spark, sf_dir)), "n_lines")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.derivatives(warc.responses(pages, CAPTURED))
    columns = "record_type record_id refers_to concurrent_to target_uri date source_headers source_digest content_type block_digest content_length"
    return records.select(F.col("id").alias("page_id"), *columns.split())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), secrets.listed_credentials(F.col("credentials")).alias("credentials"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(documents(spark, sf_dir), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return rows.withColumnRenamed("id", "doc_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.text_scores(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 15)) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s
), l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight LIMIT 1) * weight, cap)) AS target
  FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.*, e.source_size, e.target, e.epochs, CAST(round(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken, source FROM p
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), f AS (
  SELECT doc_id, i, w[i] AS word, len(w) - i >= 19 AS whole, CASE WHEN len(w) - i >= 19 THEN array_to_string(w[i : i + 19], ' ') END AS run FROM p
), r AS (
  SELECT doc_id, i, word, CASE WHEN whole AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM f
), c AS (
  SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), a AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), p AS (
  SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d
), t AS (
  SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '[^\x20\x09-\x0D]') AS token FROM p
), n AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5 AS alone FROM t WHERE token
), r AS (
  SELECT doc_id, i, CASE WHEN next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later,
         CASE WHEN alone AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS itself FROM n
), c AS (
  SELECT doc_id, i, greatest(itself, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS gone FROM r
), a AS (
  SELECT t.doc_id, count(c.i) AS n_lines, CAST(coalesce(sum(c.gone), 0) AS BIGINT) AS n_removed,
         string_agg(CASE WHEN coalesce(c.gone, 0) = 0 THEN line END, chr(10) ORDER BY t.i) AS kept
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM a
"""


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h,
         sha256(concat('response|', coalesce(CAST(page_id AS VARCHAR), ''), '|', coalesce(url, ''))) AS d
  FROM pages
), r AS (
  SELECT *, concat('urn:uuid:', substr(d, 1, 8), '-', substr(d, 9, 4), '-', substr(d, 13, 4), '-', substr(d, 17, 4), '-', substr(d, 21, 12)) AS refers_to,
         concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(h)) AS source_headers,
         concat('sha256:', sha256(h)) AS source_digest,
         regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'),
           '(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|nav|article|aside|footer|header|main|section|title|blockquote|pre|form)\b[^<>]*>', chr(10), 'g'),
           '<[a-zA-Z/!?][^<>]*>', '', 'g') AS bare,
         regexp_extract(h, '(?is)<title\b[^<>]*>(.*?)</title\s*>', 1) AS title,
         regexp_extract_all(h, '(?i)<a\b[^<>]*?\bhref\s*=\s*"([^"<>]*)"', 1) AS links
  FROM p
), u AS (
  SELECT *, replace(replace(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS shown,
         replace(replace(title, '&quot;', '"'), '&amp;', '&') AS heading,
         concat('title: ', trim(regexp_replace(replace(replace(replace(title, '&quot;', '"'), '&amp;', '&'), chr(10), ' '), '[\x20\t\r\x0b\x0c]+', ' ', 'g')),
           coalesce(array_to_string(list_transform(links, lambda x: concat(chr(13), chr(10), 'outlink: ', replace(replace(x, '&quot;', '"'), '&amp;', '&'))), ''), ''),
           chr(13), chr(10), 'source-payload-digest: ', source_digest) AS described
  FROM r
), t AS (
  SELECT *, array_to_string(list_filter(list_transform(string_split(shown, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\t\r\x0b\x0c]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS plain,
         sha256(concat('metadata|', refers_to)) AS m, sha256(concat('conversion|', refers_to)) AS c
  FROM u
), n AS (
  SELECT *, concat('urn:uuid:', substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12)) AS mid,
         concat('urn:uuid:', substr(c, 1, 8), '-', substr(c, 9, 4), '-', substr(c, 13, 4), '-', substr(c, 17, 4), '-', substr(c, 21, 12)) AS cid
  FROM t
)
SELECT page_id, 'metadata' AS record_type, mid AS record_id, refers_to, cid AS concurrent_to, url AS target_uri, '2024-01-01T00:00:00Z' AS date, source_headers, source_digest,
       'application/warc-fields' AS content_type, concat('sha256:', sha256(described)) AS block_digest, CAST(strlen(described) AS BIGINT) AS content_length FROM n
UNION ALL
SELECT page_id, 'conversion', cid, refers_to, mid, url, '2024-01-01T00:00:00Z', source_headers, source_digest,
       'text/plain', concat('sha256:', sha256(plain)), CAST(strlen(plain) AS BIGINT) FROM n
"""


def _op9_sql() -> str:
    """Every kind of part with its place, then weak parts by an inequality join on their document."""
    kinds = [(k, p, g, least, 1 << 30, False) for k, p, g, least in secrets.STRONG] + [(*w[:4], w[4] or 1 << 30, True) for w in secrets.WEAK]
    parts = []
    for kind, pattern, group, least, most, weak in kinds:
        quoted = pattern.replace("'", "''")
        mixed = "".join(f" AND regexp_matches(h[i], '{x}')" for x in secrets.MIXED) if (kind, group) == ("secret", 1) else ""
        parts.append(f"""
SELECT r, '{kind}' AS kind, {secrets.ORDER[kind]} AS ord, {weak} AS weak, start, start + len(h[i]) AS stop FROM (
  SELECT r, h, o, i, CAST(list_sum(list_transform(g[1 : i], lambda x: len(x))) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM (
    SELECT r, h, o, g, unnest(range(1, len(h) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{quoted}', 0) AS h, regexp_extract_all(t, '{quoted}', {group}) AS o, string_split_regex(t, '{quoted}') AS g FROM d)))
WHERE len(o[i]) BETWEEN {least} AND {most}{mixed}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), p AS ({" UNION ALL ".join(parts)}),
c AS (SELECT *, CASE kind WHEN 'assign' THEN 'secret' WHEN 'hex' THEN 'secret' WHEN 'access' THEN 'ident' ELSE kind END AS role FROM p),
n AS (SELECT w.r, w.kind, w.ord, w.start, w.stop, bool_or(c.role = 'ident') AS i, bool_or(c.role = 'secret') AS s
      FROM c w JOIN c ON w.r = c.r AND c.start <= w.stop + {secrets.SCOPE} AND c.stop >= w.start - {secrets.SCOPE} WHERE w.weak GROUP BY ALL),
a AS (SELECT r, kind, ord, start, stop, true AS base FROM p WHERE NOT weak
      UNION ALL SELECT DISTINCT r, kind, ord, start, stop, false FROM n WHERE CASE kind WHEN 'ident' THEN s WHEN 'secret' THEN i ELSE i AND s END),
e AS (SELECT i.r, i.kind, i.ord, i.start, i.stop, c.role, arg_min(concat(c.kind, ':', c.start, ':', c.stop), (greatest(0, c.start - i.stop, i.start - c.stop), c.start, c.ord, c.stop)) AS near
      FROM (SELECT DISTINCT * FROM c WHERE role = 'ident') i JOIN c ON i.r = c.r AND c.role <> 'ident' AND greatest(0, c.start - i.stop, i.start - c.stop) <= {secrets.SCOPE} GROUP BY ALL),
b AS (SELECT r, kind, ord, start, stop, max(near) FILTER (role = 'secret') AS secret, max(near) FILTER (role = 'endpoint') AS endpoint FROM e GROUP BY ALL),
k AS (SELECT r, string_agg(concat_ws('+', concat(kind, ':', start, ':', stop), secret, endpoint), ',' ORDER BY start, ord, stop) AS credentials FROM b WHERE secret IS NOT NULL GROUP BY r),
l AS (SELECT r, count(*) FILTER (base AND kind = 'assign') AS n_assign, count(*) FILTER (base AND kind = 'access') AS n_access, count(*) FILTER (base AND kind = 'hex') AS n_hex,
             string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord, stop) FILTER (base) AS b, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord, stop) AS s FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(credentials, '') AS credentials
FROM d LEFT JOIN l ON d.r = l.r LEFT JOIN k ON d.r = k.r
"""


def _crc32(hexadecimal: str) -> str:
    """The checksum of bytes in hexadecimal, from its eight table entries of one bit."""
    step = "a >> 8"
    for i in range(8):
        v = 1 << i
        for _ in range(8):
            v = v >> 1 ^ 0xEDB88320 * (v & 1)
        step = f"xor({step}, ((xor(a, b) >> {i}) & 1) * {v})"
    byte = f"CAST(concat('0x', {hexadecimal}[2 * i + 1 : 2 * i + 2]) AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len({hexadecimal}) // 2), lambda i: {byte})), lambda a, b: {step}))"


def _op11_sql() -> str:
    """Near words by shared deletions; forms followed recursively."""
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)
  GROUP BY ALL
), x AS (
  SELECT w, c, len(w) AS l, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w))) AS x FROM r
), h AS (
  SELECT w, c, l, {_crc32('x')} AS h FROM x
), u AS (
  SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN concat(w[1 : h % l], w[h % l + 2 :]) ELSE w END AS word, c FROM h
), v AS (
  SELECT * FROM (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM u GROUP BY word) WHERE len(word) >= {spelling.LEAST_LENGTH} AND n >= {spelling.LEAST_COUNT}
), d AS (
  SELECT word, n, i, concat(word[1 : i - 1], word[i + 1 :]) AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)
), p AS (
  SELECT DISTINCT d.word, d.n, v.word AS near, v.n AS near_n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.less = v.word
  UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
), s AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {spelling.TIMES} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN s ON v.word = s.word
), g AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON f.word = g.word JOIN f e ON g.at = e.word WHERE e.form IS NULL
"""


def _op13_sql() -> str:
    """Prefixes by a digest of all their turns; a node's amounts go to every prefix of its smallest member."""
    return f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), x AS (
  SELECT DISTINCT c, c - c % {prefix_trie.EVERY} AS base, hex(encode(CAST(c AS VARCHAR))) AS x FROM t
), h AS (
  SELECT c, base, {_crc32('x')} % {prefix_trie.HEAD} AS h FROM x
), m AS (
  SELECT h.c, t.i, 0 AS own, role, text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT h.c, t.i, 1, role, text FROM h JOIN t ON t.c = h.c AND t.i > h.h
), n AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, len(text) AS size, sha256(concat(len(role), ':', role, text)) AS turn FROM m
), p AS (
  SELECT c, d, size, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM n UNION ALL SELECT c, 0, 0, '' FROM h
), r AS (
  SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM p
), v AS (
  SELECT key, min(c) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
         sha256(coalesce(string_agg(CASE WHEN last THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM r GROUP BY key
), k AS (
  SELECT v.*, coalesce(n, 0) AS n_children FROM v LEFT JOIN (SELECT parent AS of, count(*) AS n FROM v GROUP BY parent) ON key = of
), s AS (
  SELECT r.key, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM k JOIN r ON r.c = k.conv_id AND r.d <= k.depth GROUP BY r.key
)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM k JOIN s ON k.key = s.key LEFT JOIN v u ON k.parent = u.key
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_source_mixing, op3_pu_quality, op4_quality_rules, op5_substring_dedup, op6_line_dedup, op7_simhash, op8_warc_derivatives, op9_secrets, op10_byte_bpe, op11_spelling, op12_lm_scoring, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_source_mixing": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_warc_derivatives": OP8_SQL, "op9_secrets": _op9_sql(), "op11_spelling": _op11_sql(), "op13_prefix_trie": _op13_sql()}
