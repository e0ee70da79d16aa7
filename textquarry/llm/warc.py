"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

Both refer to the response by its identifier and name each other; they carry the response's target, date,
HTTP headers and payload digest unchanged, and a digest and a length of their own block.  Identifiers follow
from digests, so a task that runs again makes the same records.  Every page is worked on by itself and
nothing moves between tasks; every scan of a page is linear in its length.  ``serialised`` writes records out as
WARC/1.1 text, the response's HTTP header lines among their named fields as ``WARC-Source-Header``.

``read_responses`` reads the response records of gzipped WARC files (one gzip member a record, or one a file).  Spark
decompresses a file as a stream and cuts it where a record's version line may begin; each record's own length then
decides where it ends, so pages that hold such a line stay whole, and no file is held in memory.

Plain text: scripts, styles and comments go (to the end of the page where they are not closed), block
elements break lines, other tags go, entities are decoded, white space is collapsed, empty lines go.

Defined cases: null addresses and pages count as empty; an empty page has an empty text and a digest of
it; a record that its file cuts short is read as far as it goes and marked ``truncated``; bytes that are no UTF-8 are
replaced; a record without a length or an identifier, and what stands between records, is no record; repeated rows give repeated records with equal identifiers; null identifiers of pages stay null; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN = re.compile(r"<script\b[^<>]*>.*?(?:</script\s*>|\Z)|<style\b[^<>]*>.*?(?:</style\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S | re.A)
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|nav|article|aside|footer|header|main|section|title|blockquote|pre|form)\b[^<>]*>", re.I | re.A)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
TITLE, TITLE_END = re.compile(r"<title\b[^<>]*>", re.I | re.A), re.compile(r"</title\s*>", re.I | re.A)
LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*"([^"<>]*)\"""", re.I | re.A)
SPACE = re.compile(r"[\x20\t\r\x0b\x0c]+")


def plain_text(page: str) -> str:
    text = html.unescape(TAG.sub("", BLOCK.sub("\n", HIDDEN.sub(" ", page))))
    lines = (SPACE.sub(" ", x).strip(" ") for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def page_fields(page: str) -> str:
    """``application/warc-fields``: the page's title and its links in order, repeats included."""
    start = TITLE.search(page)
    # If nothing closes the first title, nothing closes a later one either.
    end = TITLE_END.search(page, start.end()) if start else None
    shown = SPACE.sub(" ", html.unescape(page[start.end() : end.start()]).replace("\n", " ")).strip(" ") if end else ""
    links = [f"outlink: {html.unescape(x)}" for x in LINK.findall(page)]
    return "\r\n".join([f"title: {shown}", *links])


def _identifier(*parts: Column | str) -> Column:
    digest = F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)
    groups = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *groups))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, which has no headers or dates of its own."""
    page, url = F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"))
    name = _identifier("response", F.coalesce(own.cast("string"), F.lit("")), url)
    return pages.select(own.alias("id"), name.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), header.alias("http_headers"), _digest(page).alias("payload_digest"), page.alias("payload"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records per response: ``id, record_type, record_id, refers_to, concurrent_to, target_uri, date,
    source_headers, source_digest, content_type, block_digest, content_length, block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [p or "" for p in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array(map(page_fields, pages), pa.string()), pa.array(map(plain_text, pages), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], ["id", "refers_to", "target_uri", "date", "source_headers", "source_digest", "fields", "text"])

    id_type = found.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, refers_to string, target_uri string, date string, source_headers string, source_digest string, fields string, text string"
    rows = found.select("id", "record_id", "target_uri", "date", "http_headers", "payload_digest", "payload").mapInArrow(run, schema)
    described = F.concat(F.col("fields"), F.lit("\r\nsource-payload-digest: "), F.coalesce("source_digest", F.lit("")))
    names = {kind: _identifier(kind, F.col("refers_to")) for kind in ("metadata", "conversion")}

    def record(kind: str, other: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), names[kind].alias("record_id"), names[other].alias("concurrent_to"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(record("metadata", "conversion", "application/warc-fields", described), record("conversion", "metadata", "text/plain", F.col("text")))
    rows = rows.select("*", F.explode(both).alias("r"))
    return rows.select("id", "r.record_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "source_headers", "source_digest", "r.content_type", _digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block")


def serialised(records: DataFrame) -> DataFrame:
    """One string per record, header and block.  Written with ``lineSep="\\r\\n\\r\\n"`` they form a WARC file.

    Named fields may come any number of times, so each line of the response's HTTP header is one.
    """
    fields = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    ids = {"record_id", "refers_to", "concurrent_to"}
    head = [F.concat(F.lit(f"{k}: <" if c in ids else f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">" if c in ids else "")) for k, c in fields.items()]
    source = F.transform(F.split(F.coalesce("source_headers", F.lit("")), "\r?\n"), lambda line: F.concat(F.lit("WARC-Source-Header: "), line))
    return records.select(F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *head, source), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Derivatives as gzipped WARC files, one gzip stream a file as Spark's writer makes them."""
    write_text(serialised(records), path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: What a record's version line begins with.
VERSION = b"WARC/1."
#: The named fields of a response that are read, and the least that must be there.
FIELDS = ["record_id", "target_uri", "date", "http_headers", "payload_digest", "payload"]


def _header(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Named fields of a record that begins after ``VERSION``, and where its block begins; null if it has none."""
    end = piece.find(b"\r\n\r\n")
    lines = piece[:end].split(b"\r\n") if end >= 0 else []
    if not lines or not re.fullmatch(rb"\d+", lines[0]):
        return None
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(b":") for line in lines[1:]) if colon}
    return (fields, end + 4) if fields.get(b"content-length", b"").isdigit() and fields.get(b"warc-record-id") else None


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[bytes, bytes], bytes, bool]]:
    """``file, fields, block, truncated`` from the pieces of each file in order.

    A piece that is shorter than its record's length goes on with the next one: the cut was within its block.
    """
    held, file, want = bytearray(), None, 0
    fields: dict[bytes, bytes] | None = None

    def done() -> Iterator[tuple[str, dict[bytes, bytes], bytes, bool]]:
        if fields is not None:
            yield file, fields, bytes(held[:want]), len(held) < want

    for name, piece in pieces:
        if fields is not None and name == file and len(held) < want:
            held += VERSION + piece
            continue
        yield from done()
        file, found = name, _header(piece)
        fields, at = found if found else (None, 0)
        if fields is not None:
            held, want = bytearray(piece[at:]), int(fields[b"content-length"])
    yield from done()


_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]+)[^\r\n]*\r?\n")
BOMS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
#: Bytes of a page in which a declaration of its charset is looked for.
DECLARED = 1024


def http_fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lowered name; of a name that repeats, the last."""
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(b":") for line in head.splitlines()[1:]) if colon}


def unchunked(body: bytes) -> bytes:
    """A chunked body without its sizes; what is no chunk ends it, and a body that has none stays."""
    parts, at = [], 0
    while m := _CHUNK.match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(parts)
        parts.append(body[m.end() : m.end() + n])
        at = m.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(parts) if parts else body


def uncompressed(body: bytes, encodings: bytes) -> bytes:
    """A body without its content encodings, the last applied first; up to where it is broken or cut, and as it is where an
    encoding is not known or not what the body has."""
    for name in reversed([e.strip().lower() for e in encodings.split(b",")]):
        ways = {b"gzip": [31], b"x-gzip": [31], b"deflate": [15, -15]}.get(name, [])
        for wbits in ways:
            reader = zlib.decompressobj(wbits)
            made = bytearray()
            try:
                for at in range(0, len(body), 1 << 16):
                    made += reader.decompress(body[at : at + (1 << 16)])
            except zlib.error:
                if not made:
                    continue
            body = bytes(made)
            break
    return body


def text_of(body: bytes, content_type: bytes) -> str:
    """A body as text: by a byte order mark, the header's charset, the page's own, or as UTF-8; bytes that do not fit are replaced."""
    for mark, name in BOMS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    found = _CHARSET.search(content_type) or _CHARSET.search(body, 0, DECLARED)
    try:
        return body.decode(found[1].decode("ascii"), "replace") if found else body.decode("utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _response(fields: dict[bytes, bytes], block: bytes) -> list[str | None]:
    head, blank, body = block.partition(b"\r\n\r\n")
    told = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    http = http_fields(head)
    if b"chunked" in http.get(b"transfer-encoding", b"").lower():
        body = unchunked(body)
    # The payload is what the transfer carried; its digest is of these bytes, not of their text.
    digest = told(b"warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
    text = text_of(uncompressed(body, http.get(b"content-encoding", b"")), http.get(b"content-type", b"")) if blank else ""
    return [told(b"warc-record-id").strip("<>"), told(b"warc-target-uri"), told(b"warc-date"), head.decode("utf-8", "replace"), digest, text]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of gzipped WARC files: ``id`` (the record's identifier), ``record_id, target_uri, date,
    http_headers, payload_digest, payload, truncated``, as ``derivatives`` takes them.

    Bodies are freed of transfer and content encodings and read by their charset.  A digest that the record lacks is taken of
    the payload's bytes.  A folder without such files has no records.
    """
    pieces = spark.read.option("lineSep", VERSION.decode()).option("pathGlobFilter", "*.gz").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = ((f.as_py(), p.as_py()) for batch in batches for f, p in zip(batch.column(0), batch.column(1)))
        for _, fields, block, truncated in _records(flow):
            if fields.get(b"warc-type", b"").lower() == b"response":
                made = [pa.array([x], pa.string()) for x in _response(fields, block)]
                yield pa.RecordBatch.from_arrays([*made, pa.array([truncated])], [*FIELDS, "truncated"])

    # A gzipped file is read by one task from its start to its end, so its pieces come in order.
    found = pieces.mapInArrow(run, ", ".join(f"{f} string" for f in FIELDS) + ", truncated boolean")
    return found.select(F.col("record_id").alias("id"), *FIELDS, "truncated")


def serialised_responses(found: DataFrame) -> DataFrame:
    """The same records as WARC text, as ``serialised`` gives derivatives."""
    body = F.concat("http_headers", F.lit("\r\n\r\n"), "payload")
    head = [F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <"), "record_id", F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Payload-Digest: "), "payload_digest"), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return found.select(F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), body).alias("value"))
