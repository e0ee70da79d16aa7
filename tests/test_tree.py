"""A tree of files as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from textquarry.sources import files, tree

CONTENT = {
    "a.py": b"x = 1\n",
    "empty.py": b"",
    "sub/b.md": b"# b\n",
    "sub/deep/c.txt": b"c" * 50,
    "sub/deep/old/d.txt": b"d",
    "node_modules/x/y.js": b"1",
    "logs/keep.txt": b"k",
    "yarn.lock": b"l",
    "m.min.js": b"m",
    "api_pb2.py": b"g",
    "pic.PNG": b"\x89",
    "bad.txt": b"\xff\xfe\xfa",
    "skip.tmp": b"t",
    "keep.tmp": b"t",
    "wide.txt": b"w" * 300,
    "x/migrations/1.py": b"m",
    ".gitignore": b"*.tmp\n!keep.tmp\nlogs/\n/sub/deep/old\n",
}


@pytest.fixture
def root(tmp_path):
    for path, content in CONTENT.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/tree/{path}"), exist_ok=True)
        with open(f"{tmp_path}/tree/{path}", "wb") as f:
            f.write(content)
    return f"{tmp_path}/tree"


def test_kept_and_skipped_with_reasons(spark, root):
    kept, skipped = files.read_tree(spark, f"file://{root}")
    assert {r.path for r in kept.collect()} == {"a.py", "sub/b.md", "sub/deep/c.txt", "keep.tmp", ".gitignore"}
    want = {"empty.py": "empty", "yarn.lock": "lockfile", "m.min.js": "minified", "api_pb2.py": "generated", "pic.PNG": "binary_ext", "bad.txt": "non_utf8", "skip.tmp": "gitignored", "wide.txt": "avg_line_too_long"}
    assert {r.path: r.reason for r in skipped.collect()} == want
    kept, _ = files.read_tree(spark, root, ignore=[])
    assert {"logs/keep.txt", "skip.tmp", "sub/deep/old/d.txt"} <= {r.path for r in kept.collect()}


def test_names_are_judged_as_by_columns(spark):
    lines = CONTENT[".gitignore"].decode().splitlines()
    rows = [(p, n) for p in [*CONTENT, "A.MIN.CSS", "x.generated.ts", "noending", "go.sum", "a.tar.gz"] for n in (0, 5, files.MAX_BYTES + 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    got = [r.reason for r in df.select(files.skip_reason(F.col("path"), F.col("size"), ignore=lines).alias("reason")).collect()]
    assert got == [tree.named_reason(p, n, tree.Ignored(lines)) for p, n in rows]


def test_roots_that_are_no_folders_are_errors(spark, root):
    for path in (f"{root}/nothing", f"{root}/a.py"):
        with pytest.raises(Exception, match="is not a directory"):
            files.read_tree(spark, path)[0].collect()
    with pytest.raises(Exception, match="more than 100 bytes"):
        files.read_tree(spark, root, max_bytes=100)[0].collect()


def test_pruned_folders_are_not_listed_and_partitions_are_cut_by_bytes(root):
    reader = tree.TreeReader({"path": root, "partition_bytes": "60"})
    parts = reader.partitions()
    assert set(reader.listed) == {"", "sub/", "sub/deep/", "x/"}
    sizes = [sum(n for _, n, reason in p.files if reason is None) for p in parts]
    assert len(parts) > 2 and all(s <= 60 or len([f for f in p.files if f[2] is None]) == 1 for s, p in zip(sizes, parts))


def test_filters_reach_the_listing(spark, root):
    tree.register(spark)
    df = spark.read.format("tree").load(root)
    assert {r.path for r in df.where(F.col("path").startswith("sub/")).collect()} == {"sub/b.md", "sub/deep/c.txt"}
    assert {r.path for r in df.where((F.col("size") > 4) & (F.col("size") < 60)).collect()} >= {"a.py", "sub/deep/c.txt"}
    assert [r.path for r in df.where(F.col("path").isin("a.py", "zzz")).collect()] == ["a.py"]
    reader = tree.TreeReader({"path": root})
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.StringStartsWith(("path",), "sub/de"), ds.GreaterThan(("size",), 10), ds.EqualTo(("reason",), "x")]))
    assert [type(f) for f in left] == [ds.EqualTo] and [f[0] for p in reader.partitions() for f in p.files] == ["sub/deep/c.txt"]
    assert set(reader.listed) == {"", "sub/", "sub/deep/"}
