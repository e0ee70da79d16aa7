"""Queries over documents and pages as files: filters, chunks, browsing, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import chunking, digests, incremental, summaries
from ..sources import files as src
from .catalogue import Tables, query

PATH = "concat(source, '/doc', doc_id, '.md')"
#: Lines of a text with ``\n`` breaks, as SQL.
LOC = "(CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE concat('%', chr(10)) THEN 0 ELSE 1 END END)"


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a path, a language, a content hash, sizes."""
    path = F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", path.alias("path"), "text", F.col("lang").alias("language"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), fn.line_count(F.col("text")).alias("loc"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1")
def content_hash_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"))


def _odd_path() -> Column:
    names = {0: "go.sum", 1: "a.min.js", 2: "x_pb2.py", 3: "logo.PNG", 4: "debug.log", 5: "tests/test_a.py"}
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    for k, v in names.items():
        name = F.when(F.col("doc_id") % 10 == k, F.lit(v)).otherwise(name)
    return F.concat(F.col("source"), F.lit("/"), name)


@query(f"""
WITH p AS (SELECT doc_id, text, CASE doc_id % 10 WHEN 0 THEN 'lockfile' WHEN 1 THEN 'minified' WHEN 2 THEN 'generated' WHEN 3 THEN 'binary_ext' WHEN 4 THEN 'gitignored' END AS named FROM documents)
SELECT doc_id, coalesce(named, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 1048576 THEN 'too_large' WHEN {LOC} > 5000 THEN 'too_many_lines'
       WHEN len(replace(text, chr(10), '')) / greatest({LOC}, 1) > 200 THEN 'avg_line_too_long' END) AS reason, doc_id % 10 = 5 AS is_test,
       CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'python' ELSE 'markdown' END AS language
FROM p""")
def file_filter_reasons(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", _odd_path().alias("path"))
    reason = src.skip_reason(F.col("path"), F.octet_length("text"), F.col("text").cast("binary"), ["*.log", "!keep.log", "# no pattern"])
    return rows.select("doc_id", reason.alias("reason"), src.is_test_path(F.col("path")).alias("is_test"), src.detect_language(F.col("path")).alias("language"))


@query(f"SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS sum_chars, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, CAST(max({LOC}) AS BIGINT) AS max_loc FROM documents GROUP BY lang")
def language_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("sum_chars"), F.sum(F.octet_length("text")).alias("size_bytes"), F.max(fn.line_count(F.col("text"))).alias("max_loc"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, CAST(page_id AS VARCHAR) AS k FROM pages)
SELECT page_id, host, CASE page_id % 4 WHEN 3 THEN NULL ELSE host END AS owner, CASE page_id % 4 WHEN 3 THEN NULL ELSE concat('r', k) END AS repo,
       CASE page_id % 4 WHEN 3 THEN 'local' ELSE 'github' END AS kind FROM p""")
def url_source_parse(t: Tables) -> DataFrame:
    host, k = F.parse_url("url", F.lit("HOST")), F.col("page_id").cast("string")
    rows = t.pages.select("page_id", host.alias("host"), k.alias("k"), "url")
    web = F.concat(F.lit("https://www.github.com/"), "host", F.lit("/r"), "k", F.lit(".git/"))
    deep = F.concat(F.lit("https://github.com/"), "host", F.lit("/r"), "k", F.lit("/tree/main?x=1"))
    ssh = F.concat(F.lit("git@github.com:"), "host", F.lit("/r"), "k", F.lit(".git"))
    kind = F.col("page_id") % 4
    parts = src.source_parts(F.when(kind == 0, web).when(kind == 1, deep).when(kind == 2, ssh).otherwise(F.col("url")))
    rows = rows.withColumn("parts", parts)
    return rows.select("page_id", "host", "parts.owner", "parts.repo", F.when(F.col("parts").isNull(), "local").otherwise("github").alias("kind"))


@query(f"SELECT {PATH} AS entry, 'file' AS kind FROM documents WHERE source = 'src1'")
def list_directory(t: Tables) -> DataFrame:
    return src.list_directory(as_files(t.documents), "src1")


@query("SELECT DISTINCT source AS entry, 'dir' AS kind FROM documents")
def list_root(t: Tables) -> DataFrame:
    return src.list_directory(as_files(t.documents), ".")


@query(f"SELECT path FROM (SELECT {PATH} AS path FROM documents) WHERE path LIKE '%/doc1%.md' ORDER BY path LIMIT 200")
def find_files(t: Tables) -> DataFrame:
    return src.find_files(as_files(t.documents), "*/doc1*.md")


@query(rf"""
WITH l AS (SELECT {PATH} AS path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents), p AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS line FROM l)
SELECT path, line, substr(trim(l[line]), 1, 200) AS text FROM p WHERE regexp_matches(l[line], '\b(?:the|der) (?:and|und)\b') ORDER BY path, line LIMIT 50""")
def grep_lines(t: Tables) -> DataFrame:
    return src.grep(as_files(t.documents), r"\b(?:the|der) (?:and|und)\b")


@query(rf"""
WITH l AS (SELECT {PATH} AS path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents), p AS (SELECT path, l, unnest(range(1, len(l) + 1)) AS line FROM l)
SELECT path, line, substr(trim(l[line]), 1, 200) AS text FROM p WHERE regexp_matches(l[line], '^(?:The|Der|Le|El) .*[a-z]\.$') AND path LIKE '%doc1%' ORDER BY path, line LIMIT 50""")
def grep_anchored(t: Tables) -> DataFrame:
    """Lines found by their ends; the group is named as in Python."""
    return src.grep(as_files(t.documents), r"^(?P<first_word>The|Der|Le|El) .*[a-z]\.$", glob="*doc1*")


@query(rf"""
WITH r AS (SELECT {PATH} AS path, doc_id % 7 AS s, doc_id % 7 + 3 AS e, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents),
c AS (SELECT *, greatest(1, least(s, len(l))) AS first FROM r), d AS (SELECT *, greatest(first, least(len(l), e, first + 399)) AS last FROM c),
u AS (SELECT path, s AS start, e AS "end", CASE WHEN s > len(l) THEN 'start_beyond_end' END AS reason, first, last, l, CASE WHEN s > len(l) THEN [CAST(NULL AS BIGINT)] ELSE range(first, last + 1) END AS n FROM d),
x AS (SELECT path, start, "end", reason, l, unnest(n) AS line FROM u)
SELECT path, start, "end", reason, line, l[line] AS text FROM x""")
def read_slice(t: Tables) -> DataFrame:
    files = as_files(t.documents)
    requests = files.select("path", (F.col("doc_id") % 7).alias("start"), (F.col("doc_id") % 7 + 3).alias("end"))
    return src.read_slices(files, requests, redact=None)


@query("""
WITH d AS (SELECT doc_id, text, len(text) AS n FROM documents WHERE len(text) > 0),
w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((n - 1500) / 1300.0)) AS BIGINT) + 1)) AS k FROM d),
c AS (SELECT doc_id, k, substr(text, k * 1300 + 1, 1500) AS content, substr(text, 1, k * 1300) AS before FROM w)
SELECT doc_id, k, 1 + len(before) - len(replace(before, chr(10), '')) AS start_line,
       1 + len(before) - len(replace(before, chr(10), '')) + (len(content) - 1) - len(replace(substr(content, 1, len(content) - 1), chr(10), '')) AS end_line,
       len(content) AS n_chars, greatest(1, len(content) // 4) AS tokens, sha256(content) AS content_hash FROM c""")
def naive_chunks(t: Tables) -> DataFrame:
    rows = chunking.window_chunks(t.documents, "doc_id")
    return rows.select("doc_id", "k", "start_line", "end_line", F.length("content").cast("long").alias("n_chars"), "tokens", F.sha2("content", 256).alias("content_hash"))


def _marked(docs: DataFrame) -> DataFrame:
    """Every fourth line of a text made a heading."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("## "), x)).otherwise(x))
    return docs.select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN concat('## ', l[i]) ELSE l[i] END AS line, (i // 4) AS section FROM p),
g AS (SELECT doc_id, section, min(i) AS start_line, max(i) AS end_line, arg_min(line, i) AS head, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, section)
SELECT doc_id, section, CASE WHEN start_line % 4 = 0 THEN trim(regexp_replace(head, '^#+', '')) END AS heading, start_line, end_line, sha256(content) AS content_hash
FROM g WHERE regexp_replace(content, '[ \t\n\r\f\v]+', '', 'g') <> ''""")
def markdown_sections(t: Tables) -> DataFrame:
    rows = chunking.markdown_sections(_marked(t.documents), "doc_id", max_tokens=1 << 28)
    return rows.select("doc_id", "section", "heading", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN concat('## ', l[i]) ELSE l[i] END AS line, i // 4 AS section FROM p),
g AS (SELECT doc_id, section, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id, section),
k AS (SELECT * FROM g WHERE regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g') <> ''),
w AS (SELECT *, unnest(range(0, CASE WHEN len(text) > 800 THEN CAST(greatest(0, ceil((len(text) - 1500) / 1300.0)) AS BIGINT) + 1 ELSE 1 END)) AS part FROM k),
c AS (
    SELECT doc_id, section, part, first, substr(text, 1, part * 1300) AS before,
           CASE WHEN len(text) > 800 THEN substr(text, part * 1300 + 1, 1500) ELSE text END AS content, len(text) > 800 AS cut
    FROM w),
n AS (
    SELECT *, first + len(before) - len(replace(before, chr(10), '')) AS start_line,
           CASE WHEN cut THEN substr(content, 1, len(content) - 1) ELSE content END AS upto
    FROM c)
SELECT doc_id, section, part, start_line, start_line + len(upto) - len(replace(upto, chr(10), '')) AS end_line, sha256(content) AS content_hash FROM n""")
def markdown_section_windows(t: Tables) -> DataFrame:
    """With the usual bound: sections too large for it come in windows."""
    rows = chunking.markdown_sections(_marked(t.documents), "doc_id", max_tokens=200)
    return rows.select("doc_id", "section", "part", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(r"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, regexp_matches(href, '^https?://') AS is_external, count(*) AS n FROM h GROUP BY ALL""")
def html_link_edges(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href", F.col("href").rlike("^https?://").alias("is_external")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH n AS (SELECT p_partkey, concat(replace(p_brand, '#', 'No'), 'HTTPServer_', replace(p_type, ' ', '-'), p_size, 'Ab') AS name FROM part)
SELECT p_partkey, name, concat(name, ' ', trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(name, '[_\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '\s+', ' ', 'g'))) AS searchable FROM n""")
def split_identifiers(t: Tables) -> DataFrame:
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("No")), F.lit("HTTPServer_"), F.replace("p_type", F.lit(" "), F.lit("-")), F.col("p_size").cast("string"), F.lit("Ab"))
    return t.part.select("p_partkey", name.alias("name")).withColumn("searchable", fn.searchable_name(F.col("name")))


def _planted(docs: DataFrame) -> DataFrame:
    """Each text followed by credentials made from its digest."""
    key = F.upper(F.substring(F.md5("text"), 1, 16))
    return docs.select("doc_id", F.concat("text", F.lit(" AKIA"), key, F.lit(" and ghp_"), F.md5("text"), F.substring(F.md5("text"), 1, 8), F.lit(" sk_live_"), F.substring(F.md5("text"), 1, 20), F.lit(" end")).alias("text"))


@query(r"""
WITH s AS (SELECT doc_id, concat(text, ' AKIA', upper(substr(md5(text), 1, 16)), ' and ghp_', md5(text), substr(md5(text), 1, 8), ' sk_live_', substr(md5(text), 1, 20), ' end') AS t FROM documents),
r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\bAKIA[0-9A-Z]{16}\b', '[REDACTED]', 'g'), '\bgh[pousr]_[A-Za-z0-9]{36,}\b', '[REDACTED]', 'g'), '\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{16,}\b', '[REDACTED]', 'g') AS t FROM s)
SELECT doc_id, sha256(t) AS redacted_hash, (len(t) - len(replace(t, '[REDACTED]', ''))) // 10 AS n_hits FROM r""")
def redact_known(t: Tables) -> DataFrame:
    rows = _planted(t.documents).select("doc_id", fn.redact_known(F.col("text")).alias("t"))
    hits = F.floor((F.length("t") - F.length(F.replace("t", F.lit(fn.REDACTED), F.lit("")))) / len(fn.REDACTED))
    return rows.select("doc_id", F.sha2("t", 256).alias("redacted_hash"), hits.cast("long").alias("n_hits"))


def _replaced(text: str, patterns: list[str]) -> str:
    """Patterns replaced one after the other, as SQL."""
    for pattern in patterns:
        text = f"regexp_replace({text}, '{pattern}', '{fn.REDACTED}', 'g')"
    return text


@query(rf"""
WITH t AS (
    SELECT doc_id, concat(text, ' x ', rtrim(to_base64(unhex(sha256(text))), '='), chr(10), 'end') AS t FROM documents),
k AS (SELECT doc_id, {_replaced("t", fn.KNOWN_SECRETS)} AS t FROM t),
r AS (SELECT doc_id, regexp_split_to_array(t, '{fn.TOKEN_RUN}') AS gaps, regexp_extract_all(t, '{fn.TOKEN_RUN}') AS runs FROM k),
u AS (SELECT doc_id, i, gaps[i] AS gap, coalesce(runs[i], '') AS run FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM r)),
c AS (SELECT run, unnest(string_split(run, '')) AS c FROM (SELECT DISTINCT run FROM u WHERE run <> '')),
n AS (SELECT run, c, count(*) AS n FROM c WHERE c <> '' GROUP BY run, c),
e AS (SELECT run, -sum(n / len(run) * log2(n / len(run))) AS entropy FROM n GROUP BY run),
h AS (
    SELECT doc_id, i, concat(gap, CASE WHEN regexp_matches(run, '[0-9]') AND entropy >= {fn.MIN_ENTROPY} THEN '{fn.REDACTED}' ELSE run END) AS part
    FROM u LEFT JOIN e USING (run)),
d AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS t FROM h GROUP BY doc_id)
SELECT doc_id, sha256(t) AS redacted_hash, contains(t, '{fn.REDACTED}') AS hit FROM d""")
def redact_entropy(t: Tables) -> DataFrame:
    """Texts followed by the base64 of their digest, which only its entropy gives away."""
    token = F.regexp_replace(F.base64(F.unhex(F.sha2("text", 256))), "=", "")
    rows = t.documents.select("doc_id", fn.redact_secrets(F.concat("text", F.lit(" x "), token, F.lit("\nend"))).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("redacted_hash"), F.contains("t", F.lit("[REDACTED]")).alias("hit"))


@query(r"""
WITH c AS (SELECT doc_id, unnest(string_split(sha256(text), '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS k FROM c WHERE c <> '' GROUP BY doc_id, c)
SELECT doc_id, round(-sum(k / 64.0 * log2(k / 64.0)), 6) AS entropy FROM n GROUP BY doc_id""")
def token_entropy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(fn.shannon_entropy(F.sha2("text", 256)), 6).alias("entropy"))


@query("SELECT source AS dir, count(*) AS n_children, sha256(string_agg(concat(sha256(text), chr(0)), '' ORDER BY sha256(text))) AS hash FROM documents GROUP BY source")
def directory_hashes(t: Tables) -> DataFrame:
    files = as_files(t.documents).select(fn.parent_directory(F.col("path")).alias("dir"), "content_hash")
    return digests.combined(files, "content_hash").select("dir", F.col("n").alias("n_children"), "hash")


@query("SELECT a.dir, count(*) AS n FROM (SELECT unnest(['deep', concat('deep/', source), concat('deep/', source, '/', lang)]) AS dir FROM documents) a GROUP BY a.dir")
def ancestor_directories(t: Tables) -> DataFrame:
    path = F.concat_ws("/", F.lit("deep"), "source", "lang", F.col("doc_id").cast("string"))
    return t.documents.select(F.explode(fn.ancestors(path)).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH f AS (
    SELECT {PATH} AS path, source AS dir, sha256(text) AS h, trim(regexp_extract(text, '{summaries.SENTENCE}', 1)) AS content
    FROM documents WHERE {LOC} >= 5),
fl AS (SELECT *, concat(path, ': ', content) AS line FROM f),
d AS (
    SELECT dir, sha256(string_agg(concat(h, chr(0)), '' ORDER BY h)) AS h,
           trim(regexp_extract(coalesce(min_by(line, path) FILTER (regexp_matches(line, '{summaries.SENTENCE}')), ''), '{summaries.SENTENCE}', 1)) AS content
    FROM fl GROUP BY dir),
dl AS (SELECT *, concat(dir, ': ', content) AS line FROM d),
r AS (
    SELECT sha256(string_agg(concat(h, chr(0)), '' ORDER BY h)) AS h,
           trim(regexp_extract(coalesce(min_by(line, dir) FILTER (regexp_matches(line, '{summaries.SENTENCE}')), ''), '{summaries.SENTENCE}', 1)) AS content
    FROM dl HAVING count(*) > 0)
SELECT 'file' AS scope, path AS target_path, content, h AS source_hash FROM f
UNION ALL SELECT 'directory', dir, content, h FROM d
UNION ALL SELECT 'repo', '.', content, h FROM r""")
def directory_summaries(t: Tables) -> DataFrame:
    """File summaries, their directories' and the root's."""
    files = as_files(t.documents)
    return summaries.hierarchy(summaries.file_summaries(files, least=5), depth=1)


OLD = f"(SELECT {PATH} AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3)"
NEW = f"(SELECT {PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 0)"


def _snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole table twice: each version lacks some files, and some changed in between."""
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return as_files(docs.where("doc_id % 10 <> 3")), as_files(changed.where("doc_id % 10 <> 0"))


@query(f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status
FROM {OLD} o FULL JOIN {NEW} n ON o.path = n.path""")
def diff_snapshots(t: Tables) -> DataFrame:
    return incremental.diff(*_snapshots(t.documents))


@query("""
WITH f AS (SELECT concat(source, '/doc', doc_id, '.md') AS path, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0),
w AS (SELECT path, text, unnest(range(0, CAST(greatest(0, ceil((len(text) - 1500) / 1300.0)) AS BIGINT) + 1)) AS k FROM f WHERE len(text) > 0)
SELECT path, k, sha256(substr(text, k * 1300 + 1, 1500)) AS content_hash FROM w""")
def incremental_apply(t: Tables) -> DataFrame:
    """An index of chunks brought up to date equals one built anew."""
    old, new = _snapshots(t.documents)
    build = lambda files: chunking.window_chunks(files, "path").select("path", "k", F.sha2("content", 256).alias("content_hash"))
    return incremental.refreshed(build(old), new, incremental.diff(old, new), build)
