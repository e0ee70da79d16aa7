"""A tree of files as a Spark data source: ``spark.read.format("tree").load(root)`` after ``register``.

The root is listed folder by folder, as Spark's own file sources are listed, by the driver and by names and sizes only.
Folders that are left out are never listed.  Files that their name or size leaves out carry their reason and are not
read; the others are cut in partitions of about ``PARTITION`` bytes and read by the tasks, some ``BATCH`` bytes at a time.

Filters on ``path`` (equal, one of several, beginning) and ``size`` (comparisons) are pushed down, so that what they leave out is
neither listed as a task's work nor read.  A root that is missing or no folder is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from .files import BINARY, GENERATED, LOCKFILES, MAX_BYTES, MINIFIED, SKIP_DIRS, ignore_pattern

PARTITION, BATCH = 32 << 20, 8 << 20
SCHEMA = "path string, size long, reason string, content binary"
NAMES, TYPES = ["path", "size", "reason", "content"], [pa.string(), pa.int64(), pa.string(), pa.binary()]

_COMPARED = {ds.GreaterThan: int.__gt__, ds.GreaterThanOrEqual: int.__ge__, ds.LessThan: int.__lt__, ds.LessThanOrEqual: int.__le__, ds.EqualTo: int.__eq__}


class Ignored:
    """Whether the lines of an ignore file leave a path out: the last line that matches decides."""

    def __init__(self, lines: list[str]) -> None:
        self.rules = [(re.compile(p), ignores) for p, ignores in filter(None, map(ignore_pattern, lines))]

    def __call__(self, path: str) -> bool:
        return next((ignores for p, ignores in reversed(self.rules) if p.search(path)), False)


def named_reason(path: str, size: int, ignored: Ignored) -> str | None:
    """The first reason by name or size, as ``files.skip_reason`` without contents has it."""
    name, low = path.rsplit("/", 1)[-1], path.lower()
    ending = name.lower().rsplit(".", 1)[-1] if "." in name else ""
    if ignored(path):
        return "gitignored"
    if name in LOCKFILES:
        return "lockfile"
    if low.endswith(tuple(MINIFIED)):
        return "minified"
    if low.endswith(tuple(GENERATED)) or ".generated." in low:
        return "generated"
    if ending in BINARY:
        return "binary_ext"
    return "empty" if size == 0 else "too_large" if size > MAX_BYTES else None


@dataclass
class Files(ds.InputPartition):
    files: list[tuple[str, int, str | None]]


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        root = options["path"]
        self.system, self.root = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), re.sub(r"^file:", "", root))
        self.root = self.root.rstrip("/") or "/"
        self.lines = options["ignore"].split("\n") if "ignore" in options else None
        self.skipped = [*SKIP_DIRS] + ([] if options.get("migrations", "false") == "true" else ["migrations"])
        self.partition = int(options.get("partition_bytes", PARTITION))
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None
        self.filters: list[ds.Filter] = []
        self.listed: list[str] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802  a name of the interface
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("path",) and isinstance(f, ds.EqualTo | ds.In | ds.StringStartsWith) or column == ("size",) and type(f) in _COMPARED:
                self.filters.append(f)
            else:
                yield f

    def _passes(self, path: str, size: int) -> bool:
        for f in self.filters:
            if f.attribute == ("size",):
                holds = _COMPARED[type(f)](size, f.value)
            elif isinstance(f, ds.In):
                holds = path in f.value
            else:
                holds = path == f.value if isinstance(f, ds.EqualTo) else path.startswith(f.value)
            if not holds:
                return False
        return True

    def _within(self, folder: str) -> bool:
        """Whether a folder may hold a path that the filters let pass."""
        for f in self.filters:
            if f.attribute == ("path",):
                named = list(f.value) if isinstance(f, ds.In) else [f.value]
                below = isinstance(f, ds.StringStartsWith) and folder.startswith(f.value)
                if not below and not any(p.startswith(folder) for p in named):
                    return False
        return True

    def checked(self) -> None:
        if self.system.get_file_info(self.root).type != pafs.FileType.Directory:
            raise ValueError(f"{self.root} is not a directory")

    def _files(self) -> Iterator[tuple[str, int, str | None]]:
        self.checked()
        lines = self.lines
        if lines is None:
            own = f"{self.root.rstrip('/')}/.gitignore"
            there = self.system.get_file_info(own).type == pafs.FileType.File
            lines = self.system.open_input_stream(own).read().decode("utf-8", "ignore").splitlines() if there else []
        ignored, folders = Ignored(lines), [""]
        while folders:
            folder = folders.pop()
            self.listed.append(folder)
            below = []
            for info in sorted(self.system.get_file_info(pafs.FileSelector(f"{self.root.rstrip('/')}/{folder}".rstrip("/") or "/")), key=lambda x: x.base_name):
                path = f"{folder}{info.base_name}"
                if info.type == pafs.FileType.Directory:
                    if info.base_name not in self.skipped and not ignored(f"{path}/") and self._within(f"{path}/"):
                        below.append(f"{path}/")
                elif info.type == pafs.FileType.File and self._passes(path, info.size):
                    yield path, info.size, named_reason(path, info.size, ignored)
            folders += reversed(below)

    def partitions(self) -> list[Files]:
        made, held, size, total = [], [], 0, 0
        for file in self._files():
            own = file[1] if file[2] is None else 0
            total += file[1]
            if self.most is not None and total > self.most:
                raise ValueError(f"{self.root} has more than {self.most} bytes")
            if held and (size + own > self.partition or len(held) >= 10_000):
                made.append(Files(held))
                held, size = [], 0
            held.append(file)
            size += own
        return [*made, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, n, reason in partition.files:
            content = None
            if reason is None:
                with self.system.open_input_stream(f"{self.root.rstrip('/')}/{path}") as f:
                    content = f.read()
            held.append((path, n, reason, content))
            size += len(content or b"")
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], NAMES)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], NAMES)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "listed"}


class TreeSource(ds.DataSource):
    """Options: ``path``, ``ignore`` (lines of an ignore file, by default the root's own), ``migrations`` (read those folders too),
    ``partition_bytes``, and ``max_bytes``, above which a tree is refused."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
