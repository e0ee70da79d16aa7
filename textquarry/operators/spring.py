"""Endpoints of Spring controllers, from the declarations of a source and the annotations before each.

Only a class with ``RestController`` or ``Controller`` has endpoints, and only its own ``RequestMapping`` gives their prefix;
any of its methods may have one, whatever its visibility.  A source whose brackets do not match has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import detect_language
from .lexer import blanked, brackets, declarations, line_of, line_starts

# Annotations of the framework.
CONTROLLERS = ("RestController", "Controller")
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": None}
GUARDS = ("PreAuthorize", "Secured", "RolesAllowed")

_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)\s*+(\()?")
_MODIFIER = re.compile(r"(?:public|private|protected|static|final|abstract|default|synchronized|native|sealed|non-sealed|strictfp)\b")
_STRING = re.compile(r'"((?:\\.|[^"\\\n])*)"')
_CLASS = re.compile(r"class\s++\w+")
_METHOD = re.compile(r"(?:<[^()]*?>\s*+)?[\w.]++(?:\s*+<[^()]*>)?(?:\s*+\[\s*+\])*\s*+(?<=[\s>\]])(\w+)\s*+\(")
_BLANK = re.compile(r"\s*+")


def _annotations(text: str, bare: str, pairs: dict[int, int], at: int) -> tuple[list[tuple[str, str, int]], int]:
    """Name, first string and place of the annotations from ``at`` on, and where what they are for begins."""
    found = []
    while True:
        at = _BLANK.match(bare, at).end()
        if m := _ANNOTATION.match(bare, at):
            end, string = m.end(1), None
            if m[2]:
                end = pairs[m.start(2)] + 1
                string = _STRING.search(text, m.start(2), end)
            found.append((m[1], string[1] if string else "", at))
            at = end
        elif m := _MODIFIER.match(bare, at):
            at = m.end()
        else:
            return found, at


def _route(prefix: str, path: str) -> str:
    """Both with a slash before them; only the prefix loses one at its end."""
    rooted = [part if part.startswith("/") else f"/{part}" if part else "" for part in (prefix, path)]
    return rooted[0].rstrip("/") + rooted[1] or "/"


def routes(text: str) -> Iterator[tuple[str | None, str, str, int, bool]]:
    """``method, route, handler, line, guarded`` of each endpoint of one source."""
    bare = blanked(text, "java")
    pairs = brackets(bare)
    if pairs is None:
        return
    line = line_of(line_starts(text))
    bodies = [(0, len(bare), None)]
    while bodies:
        start, stop, prefix = bodies.pop(0)
        for begin, braces, _ in declarations(bare, pairs, start, stop):
            given, at = _annotations(text, bare, pairs, begin)
            if braces is not None and _CLASS.match(bare, at):
                own = [g for g in given if g[0] in CONTROLLERS]
                mapped = next((g[1] for g in given if g[0] == "RequestMapping"), "")
                bodies.append((braces + 1, pairs[braces], mapped if own else None))
            elif braces is not None and re.compile(r"(?:interface|enum|record)\b").match(bare, at):
                bodies.append((braces + 1, pairs[braces], None))
            elif prefix is not None and (m := _METHOD.match(bare, at)):
                guarded = any(g[0] in GUARDS for g in given)
                for name, path, place in given:
                    if name in VERBS:
                        yield VERBS[name], _route(prefix, path), m[1], line(place), guarded


def spring_routes(files: DataFrame) -> DataFrame:
    """``path, method, route, handler, line, guarded`` of all Java sources."""
    names = ["path", "method", "route", "handler", "line", "guarded"]
    types = [pa.string()] * 4 + [pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *r) for path, text in zip(*(c.to_pylist() for c in batch.columns)) for r in routes(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    rows = files.where((detect_language(F.col("path")) == "java") & F.contains("text", F.lit("Controller"))).select("path", "text")
    return rows.mapInArrow(run, "path string, method string, route string, handler string, line long, guarded boolean")
