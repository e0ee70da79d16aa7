"""Table functions for SQL: ``register(spark)``, then ``SELECT * FROM symbols(TABLE(files))``.

Each takes a table with ``path`` and ``text``, other columns are ignored, and gives rows for each of its files, wherever Spark has
them: no file is moved.  A null text is an empty one; a language that is not known has no symbols, calls or endpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import OVERLAP, SIZE
from ..operators.extraction import facts_of_python
from ..operators.source_facts import SCANNED, scanned
from ..operators.spring import routes
from ..sources.files import LANGUAGES


KINDS = {"string": StringType, "long": LongType, "boolean": BooleanType}


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def facts(path: str, text: str) -> Iterator[tuple]:
    language = language_of(path)
    if language == "python":
        try:
            yield from list(facts_of_python(text))
        except (SyntaxError, ValueError, RecursionError):
            return
    elif language in SCANNED:
        yield from scanned(text, language)


class OverFiles:
    """A function over files; ``columns`` is what it gives after the path."""

    columns = ""

    @classmethod
    def analyzed(cls, files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("a table of files is needed: TABLE(...)")
        missing = {"path", "text"} - set(files.dataType.names)
        if missing:
            raise ValueError(f"the table has no {', '.join(sorted(missing))}")
        fields = [c.split() for c in f"path string, {cls.columns}".split(", ")]
        return AnalyzeResult(StructType([StructField(name, KINDS[kind]()) for name, kind in fields]))

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def eval(self, file: Row) -> Iterator[tuple]:
        if file["path"] is not None:
            for row in self.rows(file["path"], file["text"] or ""):
                yield (file["path"], *row)


class Symbols(OverFiles):
    columns = "name string, kind string, parent_symbol string, start_line long, end_line long, is_exported boolean"

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return Symbols.analyzed(files)

    def rows(self, path, text):
        return ((f[2], f[1], f[3], f[4], f[5], f[7]) for f in facts(path, text) if f[0] == "symbol")


class Calls(OverFiles):
    columns = "target_name string, caller string, line long"

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return Calls.analyzed(files)

    def rows(self, path, text):
        return ((f[2], f[3], f[4]) for f in facts(path, text) if f[0] == "call")


class Endpoints(OverFiles):
    """Of Spring controllers; those of other frameworks come from ``extraction.endpoints``."""

    columns = "method string, route string, handler string, line long, guarded boolean"

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return Endpoints.analyzed(files)

    def rows(self, path, text):
        return routes(text) if language_of(path) == "java" else iter(())


class Chunks(OverFiles):
    """Windows of characters, as ``chunking.window_chunks`` cuts them."""

    columns = "k long, content string, start_line long, end_line long"

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        return Chunks.analyzed(files)

    def rows(self, path, text):
        step, line, at = SIZE - OVERLAP, 1, 0
        last = max(0, -(-(len(text) - SIZE) // step)) if text else -1
        for k in range(last + 1):
            line, at = line + text.count("\n", at, k * step), k * step
            content = text[at : at + SIZE]
            yield k, content, line, line + content.count("\n", 0, len(content) - 1)


FUNCTIONS = {"symbols": Symbols, "calls": Calls, "endpoints": Endpoints, "chunks": Chunks}


def register(spark: SparkSession) -> list[str]:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    return list(FUNCTIONS)
