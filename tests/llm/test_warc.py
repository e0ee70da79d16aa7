import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from textquarry.llm import warc

DATE = "2024-01-01T00:00:00Z"


def test_plain_text():
    cases = {
        "": "",
        "<p>a<p>b</p>": "a\nb",
        "<title>T &amp; U</title><style>x</style><script>if (a < b) '</p>'</script>body": "T & U\nbody",
        "a<!-- c --> b<b>c</b> &#233;&eacute;&nbsp;x": "a bc éé\xa0x",
        "open<script>never closed <p>x": "open",
        "1 < 2 > 1 <br> <> x": "1 < 2 > 1\n<> x",
        "  many \t spaces \n\n\n lines ": "many spaces\nlines",
    }
    assert {k: warc.plain_text(k) for k in cases} == cases


def test_fields_name_title_and_links():
    page = '<title> A\n b </title><a class="x" href="/1">1</a><A HREF="http://x/?a&amp;b">2</A><a name="n">3</a><a href="/1">1</a>'
    assert warc.page_fields(page).split("\r\n") == ["title: A b", "outlink: /1", "outlink: http://x/?a&b", "outlink: /1"]


def pages(spark):
    rows = [(1, "http://a/", "<title>A</title><p>x é 漢"), (2, None, None), (None, "http://b/", ""), (1, "http://a/", "<title>A</title><p>x é 漢"), (3, "http://c/", "<p>" + "long " * 40_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "record_id", "block", "text", "payload", "date", "fields")})


def test_records_of_odd_pages(spark):
    found = warc.responses(pages(spark), DATE)
    records = warc.derivatives(found)
    rows, given = records.collect(), {r.record_id: r for r in found.collect()}
    assert len(rows) == 10 and warc.derivatives(warc.responses(pages(spark).where("false"), DATE)).collect() == []
    for r in rows:
        source = given[r.refers_to]
        assert (r.source_headers, r.source_digest, r.target_uri, r.date) == (source.http_headers, source.payload_digest, source.target_uri, DATE)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert r.block == warc.plain_text(source.payload) if r.record_type == "conversion" else r.block.startswith("title: ")
        other = next(o for o in rows if o.record_id == r.concurrent_to)
        assert other.refers_to == r.refers_to and other.record_type != r.record_type
    assert len({r.record_id for r in rows}) == 8  # the repeated page repeats its records


def test_file_round_trip(spark, tmp_path):
    records = warc.derivatives(warc.responses(pages(spark), DATE))
    warc.write_warc(records, f"file://{tmp_path}/out")
    data = b"".join(gzip.open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/*.gz")))
    got = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        own = [x.removeprefix("WARC-Source-Header: ") for x in lines if x.startswith("WARC-Source-Header: ")]
        assert own[0] == "HTTP/1.1 200 OK" and len(own) == 3 and own[1] == "Content-Type: text/html; charset=utf-8"
        n = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        got.append((fields["WARC-Record-ID"].strip("<>"), fields["WARC-Refers-To"].strip("<>"), rest[:n].decode()))
        data = rest[n + 4 :]
    assert sorted(got) == sorted((r.record_id, r.refers_to, r.block) for r in records.collect())


def test_scans_of_megabyte_pages_are_linear():
    import time

    pages = ["<title>" * 150_000, "<title>x</title" * 70_000, "<a " * 350_000, "<a href=" * 130_000, "<a href = " * 100_000, "<script>" * 130_000, "<!--" * 250_000, "</script " * 120_000, "<" * 1_000_000, "&" * 1_000_000, "<p" * 500_000, "<a href" + " " * 1_000_000]
    began = time.time()
    for page in pages:
        warc.page_fields(page)
        warc.plain_text(page)
    assert time.time() - began < 20
    assert warc.page_fields("<title>a<title>b</title>c</title>") == "title: a<title>b" and warc.page_fields("<title>a") == "title: "


def test_read_derive_write_read(spark, tmp_path):
    made = warc.responses(pages(spark), DATE).withColumn("payload", F.when(F.col("id") == 1, F.concat("payload", F.lit("<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz WARC/1."))).otherwise(F.col("payload")))
    warc.write_text(warc.serialised_responses(made), f"file://{tmp_path}/in")
    read = warc.read_responses(spark, f"file://{tmp_path}/in")
    columns = ["record_id", "target_uri", "date", "http_headers", "payload_digest", "payload"]
    assert sorted(map(str, read.select(*columns).collect())) == sorted(map(str, made.select(*columns).collect()))
    assert read.where("truncated").count() == 0
    records = warc.derivatives(read)
    warc.write_warc(records, f"file://{tmp_path}/out")
    assert warc.read_responses(spark, f"file://{tmp_path}/out").collect() == []  # derivatives are no responses
    assert sorted((r.refers_to, r.block_digest) for r in records.collect()) == sorted((r.refers_to, r.block_digest) for r in warc.derivatives(made).collect())


def test_reading_members_and_broken_records(spark, tmp_path):
    def record(kind, name, block, length=None, version=b"WARC/1.0", more=b""):
        return version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + name + b">\r\n" + more + b"Content-Length: " + str(len(block) if length is None else length).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\n"
    one = [record(b"warcinfo", b"i", b"software: x"), record(b"response", b"a", http + b"<p>\xff\xe9 WARC/1.0\r\n", more=b"WARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:X\r\n"), record(b"request", b"q", b"GET /\r\n\r\n"), record(b"response", b"b", b"no header")]
    two = [record(b"response", b"c", http + b"cut", length=1000)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, one)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"junk WARC/1.x" + b"".join(two)))
    (tmp_path / "none.warc.gz").write_bytes(gzip.compress(b""))
    got = {r.record_id: r for r in warc.read_responses(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].payload == "<p>\ufffd\ufffd WARC/1.0\r\n" and got["a"].payload_digest == "sha1:X" and got["a"].http_headers == "HTTP/1.1 404 Not Found\r\nServer: x"
    assert (got["b"].http_headers, got["b"].payload, got["b"].truncated) == ("no header", "", False)
    assert got["c"].truncated and got["c"].payload.startswith("cut")


def test_charsets_and_encodings(spark, tmp_path):
    import hashlib
    import zlib

    def record(name, head, body):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <" + name + b">\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    latin, japanese = "café".encode("latin-1"), "<meta charset='Shift_JIS'>日本".encode("shift_jis")
    packed = gzip.compress("é zipped".encode())
    chunked = b"5;x=1\r\n" + packed[:5] + b"\r\n" + b"%x\r\n" % len(packed[5:]) + packed[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(b"raw deflate") + raw.flush()
    cases = {
        "latin": (b"Content-Type: text/html; charset=iso-8859-1", latin, "café", latin),
        "meta": (b"Content-Type: text/html", japanese, "<meta charset='Shift_JIS'>日本", japanese),
        "bom": (b"Content-Type: text/html; charset=latin-1", b"\xef\xbb\xbf\xc3\xa9", "é", b"\xef\xbb\xbf\xc3\xa9"),
        "none": (b"Server: x", "é".encode(), "é", "é".encode()),
        "unknown": (b"Content-Type: text/html; charset=klingon", "é\xff".encode("latin-1"), "\ufffd\ufffd", b"\xe9\xff"),
        "gzip": (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked, "é zipped", packed),
        "deflate": (b"content-encoding: deflate", deflated, "raw deflate", deflated),
        "lying": (b"Content-Encoding: gzip", b"plain", "plain", b"plain"),
        "cut": (b"Content-Encoding: gzip", gzip.compress(b"whole " * 9_000)[:60], None, gzip.compress(b"whole " * 9_000)[:60]),
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(k.encode(), head, body)) for k, (head, body, _, _) in cases.items()))
    got = {r.record_id: r for r in warc.read_responses(spark, f"file://{tmp_path}/in").collect()}
    for name, (_, _, text, payload) in cases.items():
        assert got[name].payload_digest == "sha256:" + hashlib.sha256(payload).hexdigest(), name
        assert got[name].payload == text if text is not None else got[name].payload.startswith("whole whole"), name
    (tmp_path / "empty").mkdir()
    assert warc.read_responses(spark, f"file://{tmp_path}/empty").collect() == []
