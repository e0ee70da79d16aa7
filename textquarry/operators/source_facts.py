"""Definitions and calls in sources of languages whose grammar is not at hand: JavaScript, TypeScript, Go, Java,
Rust, Ruby.

A small helper inside Arrow batches reads one text: ``lexer`` blanks what is no code, then brackets (Ruby: blocks and
their ``end``) are followed to what heads a definition at the start of a line.  Like a parser it gives up a file whose
brackets do not match: such a file has no facts.  As with Python, nothing inside a function is a definition, and
whatever stands in a class or the like has that as its parent.

Statements of functions above ``LARGE`` characters are facts too, so that chunks hold whole ones.

Not seen: definitions that do not begin a line, functions that are values (arrow functions, methods of object
literals), Java's enums, records and their methods.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import detect_language, spread
from .chunking import MAX_TOKENS
from .extraction import fact_batches, python_facts
from .lexer import SCRIPTS, blanked, brackets, statements

SCANNED = ["javascript", "typescript", "tsx", "go", "java", "rust", "ruby"]
#: Kinds that hold further definitions.
CONTAINERS = ["class", "interface", "struct", "impl", "trait", "enum", "module"]

#: Characters above which a function's statements are told.
LARGE = 4 * MAX_TOKENS

# Heads and calls.  Blanks are taken possessively, so that long runs of them are read once.
_EXPORT = r"^[ \t]*+(?P<shown>export\s++(?:default\s++)?)?(?:declare\s++)?"
_SCRIPT_HEADS = [
    ("function", rf"{_EXPORT}(?:async\s++)?function\b\s*+\*?\s*+(?P<name>[\w$]+)"),
    ("class", rf"{_EXPORT}(?:abstract\s++)?class\s++(?P<name>[\w$]+)"),
]
_METHOD = r"^[ \t]*+(?:(?:public|private|protected|static|async|override|abstract|get|set)\s++)*\*?[ \t]*+(?P<name>\#?[A-Za-z_$][\w$]*)\??\s*+(?:<[^>\n]*>)?(?=\()"
_INTERFACE = ("interface", rf"{_EXPORT}interface\s++(?P<name>[\w$]+)")
_MODIFIERS = r"(?P<shown>(?:@[\w.]+(?:\([^()\n]*\))?[ \t]++|(?:public|private|protected|static|final|abstract|default|synchronized|native|sealed|non-sealed|strictfp)\s++)*+)"
_VISIBLE = r"^[ \t]*+(?P<shown>pub(?:\s*+\([^)\n]*\))?\s++)?"
#: Per language the kinds of heads at a line's start; those of ``within`` count directly inside a class alone.
_HEADS = {
    "javascript": _SCRIPT_HEADS,
    "typescript": [*_SCRIPT_HEADS, _INTERFACE],
    "tsx": [*_SCRIPT_HEADS, _INTERFACE],
    "go": [("function", r"^func\s++(?P<name>\w+)"), ("method", r"^func\s*+\([^)\n]*\)\s*+(?P<name>\w+)"), ("type", r"^type\s++(?P<name>\w+)")],
    "java": [(kind, rf"^[ \t]*+{_MODIFIERS}{kind}\s++(?P<name>\w+)") for kind in ("class", "interface")],
    "rust": [
        ("function", rf"{_VISIBLE}(?:(?:default|const|async|unsafe|extern)\s++(?:\"\s*+\"\s++)?)*fn\s++(?P<name>\w+)"),
        *[(kind, rf"{_VISIBLE}(?:unsafe\s++)?{kind}\s++(?P<name>\w+)") for kind in ("struct", "enum", "trait")],
        ("impl", r"^[ \t]*+(?P<shown>(?!))?(?:unsafe\s++)?impl\b(?P<name>[^{;\n]*)"),
    ],
}
_WITHIN = {
    "javascript": [("method", _METHOD)],
    "typescript": [("method", _METHOD)],
    "tsx": [("method", _METHOD)],
    "java": [("method", rf"^[ \t]*+{_MODIFIERS}(?:<[^()\n]*>\s*+)?(?:[\w.<>\[\],?& \t]+?[ \t\]>])?(?P<name>\w+)\s*+(?=\()")],
}
_COMPILED = {(lang, part): [(kind, re.compile(p, re.M)) for kind, p in heads] for part, table in (("any", _HEADS), ("within", _WITHIN)) for lang, heads in table.items()}
#: Heads that are definitions without a body too: up to ``;``, or in Go up to the line's end.
_BODILESS = {("java", "method"), ("rust", "struct"), ("go", "type")}
#: What stands before a brace that begins a type, not a body.
_TYPED = re.compile(r"(?:\)\s*+:|[<,|&:]|\bextends\s)\s*+\Z")
_CLOSES = {")": "(", "}": "{"}
_CALL = re.compile(r"(?<![\w$#])([A-Za-z_$][\w$]*)\s*+(?=\()")
_RUBY_CALL = re.compile(r"(?<=\.)([A-Za-z_]\w*)(?![\w?!])|(?<![\w@$:.?!])([A-Za-z_]\w*)(?=\()|^[ \t]*+([a-z_]\w*)(?=[ \t]++[\w:\"'@\[])", re.M)
_BEFORE = re.compile(r"(?:\b(\w+)\s++|(::|@)\s*+)\Z")
_NO_CALL = set("if for while switch catch try synchronized return throw function func fn pub def class new match loop until unless elsif case when else do end then in and or not await typeof yield module begin rescue ensure self nil true false".split())
_NOT_AFTER = {"function", "func", "fn", "def", "new", "class", "interface", "type"}
#: By language, names before a parenthesis that are no calls, and a parenthesis behind which a name was declared.
_NO_CALLS = {**dict.fromkeys(SCRIPTS, {"super"}), "java": {"super", "this"}, "go": {"type", "const", "var", "import"}, "rust": {"Fn", "FnMut", "FnOnce"}, "ruby": set()}
_DECLARED = {**dict.fromkeys(SCRIPTS, re.compile(r"\)\s*+\{")), "java": re.compile(r"\)\s*+(?:throws\s[\w.,\s]*+)?\{")}
_ARROW = re.compile(r"\)\s*+(?::[^=;{}]*+)?=>")
_RUBY_HEAD = re.compile(r"^[ \t]*+(?:(?P<def>def)\s++(?:self\.|\w+\.)?(?P<name>[A-Za-z_]\w*[?!=]?|[^\w\s(]+)|(?P<kind>class|module)\s++(?P<holder>[A-Z][\w:]*))")
_RUBY_OPENS = re.compile(r"^[ \t]*+(?:class|module|def|if|unless|case|while|until|for|begin)\b|[=(]\s*+(?:if|unless|case|begin|while)\b|\bdo\b[ \t]*+(?:\|[^|\n]*\|)?[ \t]*+$")
_RUBY_SINGLE = re.compile(r"^[ \t]*+def\s[^\n=(]*+(?:\([^)\n]*+\))?[ \t]*+=[ \t]|;[ \t]*+end\b[ \t]*+$|^[ \t]*+(?:def|class|module)\b.*\bend[ \t]*+$")


def _named(kind: str, m: re.Match) -> str:
    if kind != "impl":
        return m["name"]
    name = m["name"].split(" where ")[0].strip()
    if name.startswith("<"):  # the block's own parameters
        depth = 0
        for i, c in enumerate(name):
            depth += (c == "<") - (c == ">" and name[i - 1] != "-")
            if not depth:
                name = name[i + 1 :].strip()
                break
    return name.split(" for ")[-1].strip()


def _shown(language: str, name: str, m: re.Match, above: bool | None) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language == "java":
        return "public" in (m["shown"] or "")
    if language == "rust":
        return bool(m["shown"])
    return bool("shown" in m.re.groupindex and m["shown"]) or bool(above)


def _braced(bare: str, language: str) -> tuple[list[tuple], set[int]] | None:
    """``kind, name, parent, from, to, exported`` by offsets, and where names stand that are heads' own; None where
    brackets do not match."""
    heads: dict[int, tuple[str, re.Match, bool]] = {}
    for part in ("within", "any"):
        for kind, pattern in _COMPILED.get((language, part), []):
            for m in pattern.finditer(bare):
                if m["name"] not in _NO_CALL or part == "any":
                    heads[m.end()] = (kind, m, part == "within")
    marks = sorted([*((m.start(), m[0]) for m in re.finditer(r"[(){};]", bare)), *((at, "") for at in heads)])
    found: list[tuple] = []
    stack: list[tuple[str, tuple | None]] = []  # a bracket and, for a body, what it is the body of
    scope: list[tuple] = []  # (kind, name, exported) of open bodies
    own: set[int] = set()
    waiting: tuple | None = None
    for at, mark in [*marks, (len(bare), "")]:
        if waiting and (language, waiting[0]) == ("go", "type") and at > waiting[3]:
            found.append((*waiting[:3], waiting[4], waiting[3] - 1, waiting[5]))
            waiting = None
        if at not in heads and not mark:
            break
        if mark == "":
            kind, m, within = heads[at]
            inside = scope[-1] if scope else None
            if inside and inside[0] not in CONTAINERS or waiting and len(stack) > waiting[6]:
                continue
            if within and not (inside and inside[0] in ("class", "interface") and stack and stack[-1][1] is not None):
                continue
            name = _named(kind, m)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            line_end = bare.find("\n", at)
            waiting = (kind, name, inside[1] if inside else None, line_end if line_end >= 0 else len(bare), start, _shown(language, name, m, inside and inside[2]), len(stack))
            own.add(m.start("name"))
        elif mark in "({":
            body = waiting if mark == "{" and waiting and len(stack) == waiting[6] else None
            if body and language in SCRIPTS and _TYPED.search(bare, max(at - 80, 0), at):
                body = None  # a type in braces, before the body
            if body:
                waiting = None
                scope.append((body[0], body[1], body[5]))
            stack.append((mark, body))
        elif mark in ")}":
            if not stack or stack[-1][0] != _CLOSES[mark]:
                return None
            body = stack.pop()[1]
            if waiting and len(stack) < waiting[6]:
                waiting = None
            if body:
                scope.pop()
                found.append((*body[:3], body[4], at, body[5]))
        elif waiting and len(stack) == waiting[6]:  # a semicolon before any body
            if (language, waiting[0]) in _BODILESS:
                found.append((*waiting[:3], waiting[4], at, waiting[5]))
            waiting = None
    return None if stack else (found, own)


def _blocks(bare: str) -> tuple[list[tuple], set[int]] | None:
    """The same of a Ruby text, by blocks and their ``end``."""
    found, own, stack, at = [], set(), [], 0
    for line in bare.split("\n"):
        head = _RUBY_HEAD.match(line)
        inside = stack[-1][1] if stack else None
        one = None
        if head and not (inside and inside[0] not in CONTAINERS):
            kind, name = ("method", head["name"]) if head["def"] else (head["kind"], head["holder"])
            own.add(at + head.start("name" if head["def"] else "holder"))
            one = (kind, name, inside[1] if inside else None, at + len(line) - len(line.lstrip()), True)
        if _RUBY_SINGLE.search(line):
            if one:
                found.append((*one[:4], at + len(line.rstrip()) - 1, True))
        elif re.match(r"[ \t]*end\b", line):
            if not stack:
                return None
            body = stack.pop()[0]
            if body:
                found.append((*body[:4], at + len(line.rstrip()) - 1, True))
        elif _RUBY_OPENS.search(line):
            stack.append((one, one or inside))
        at += len(line) + 1
    return None if stack else (found, own)


def _annotated(lines: list[str], start: int) -> int:
    """The first of the annotation lines directly above a line."""
    while start > 1 and lines[start - 2].lstrip().startswith("@"):
        start -= 1
    return start


def scanned(text: str, language: str) -> Iterator[tuple]:
    """The facts of one source, with the columns that ``python_facts`` has after the path."""
    bare = blanked(text, language)
    read = _blocks(bare) if language == "ruby" else _braced(bare, language)
    if read is None:
        return
    found, own = read
    pairs = (brackets(bare) or {}) if language != "ruby" else {}
    if language == "go":
        found += _grouped(bare, pairs)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lines = bare.split("\n")
    line = lambda at: bisect_right(starts, at)
    opens = {close: at for at, close in pairs.items()}
    bodies = []
    for kind, name, parent, first, last, shown in sorted(found, key=lambda f: (f[3], -f[4])):
        start, end = line(first), line(last)
        if language == "java" and (above := _annotated(lines, start)) < start:
            start, first = above, starts[above - 1]
        stop = text.find("\n", first)
        signature = text[first : stop if stop >= 0 else len(text)]
        if kind not in CONTAINERS:
            bodies.append((first, last, name))
        yield ("symbol", kind, name, parent, start, end, signature.strip(), shown, None)
        if kind not in CONTAINERS and last - first > LARGE:
            if language == "ruby":
                parts = _ruby_statements(lines, start + 1, end - 1)
            else:
                inner = statements(bare, pairs, opens[last] + 1, last, language in (*SCRIPTS, "go")) if last in opens else ()
                parts = ((line(a), line(z)) for a, z in inner)
            for a, z in parts:
                yield ("statement", None, name, parent, a, z, None, None, None)
    opened = [b[0] for b in bodies]
    listed = _not_called(bare, language, found, pairs)
    for m in (_RUBY_CALL if language == "ruby" else _CALL).finditer(bare):
        name, at = m[m.lastindex], m.start(m.lastindex)
        before = _BEFORE.search(bare[max(at - 40, 0) : at])
        if at in own or name in _NO_CALL or name in _NO_CALLS[language] or before and (before[1] in _NOT_AFTER or before[2] == "::" or before[2] == "@" and language == "java"):
            continue
        close = pairs.get(m.end())
        if close is not None and (language in _DECLARED and _DECLARED[language].match(bare, close) or name == "async" and _ARROW.match(bare, close)):
            continue
        if language == "java" and before and before[1] == "record" or any(a < at < z for a, z in listed[max(bisect_right(listed, (at,)) - 1, 0) :][:1]) and (language == "rust" or not bare[bare.rfind("\n", 0, at) + 1 : at].strip()):
            continue
        i = bisect_right(opened, at) - 1
        inside = bodies[i] if i >= 0 and at <= bodies[i][1] else None
        yield ("call", None, name, inside and inside[2], line(at), line(at), None, None, None)


def _grouped(bare: str, pairs: dict[int, int]) -> list[tuple]:
    """Types of Go that are declared together."""
    found = []
    for m in re.finditer(r"^type[ \t]*+\(", bare, re.M):
        for first, last in statements(bare, pairs, m.end(), pairs[m.end() - 1], True):
            name = re.compile(r"\w+").match(bare, first)
            if name:
                found.append(("type", name[0], None, first, last, name[0][:1].isupper()))
    return found


def _not_called(bare: str, language: str, found: list[tuple], pairs: dict[int, int]) -> list[tuple[int, int]]:
    """Where names before parentheses are members that are told, not called: interfaces of Go, enums of Rust."""
    if language == "go":
        return sorted((m.end() - 1, pairs[m.end() - 1]) for m in re.finditer(r"\binterface\s*+\{", bare))
    return sorted((first, last) for kind, _, _, first, last, _ in found if kind == "enum") if language == "rust" else []


def _ruby_statements(lines: list[str], first: int, last: int) -> Iterator[tuple[int, int]]:
    """Lines of the statements between two lines, blocks as wholes."""
    depth, begin = 0, first
    for n in range(first, last + 1):
        bare = lines[n - 1]
        if re.match(r"[ \t]*end\b", bare):
            depth -= 1
        elif _RUBY_OPENS.search(bare) and not _RUBY_SINGLE.search(bare):
            depth += 1
        depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
        goes_on = n < last and re.match(r"[ \t]*[.&]", lines[n])
        if depth <= 0 and bare.strip() and not goes_on and not re.search(r"[,\\+|&.=]\s*$", bare):
            yield begin, n
            begin, depth = n + 1, 0
    if begin <= last and any(x.strip() for x in lines[begin - 1 : last]):
        yield begin, last


def source_facts(files: DataFrame) -> DataFrame:
    """Symbols, calls and endpoints of all sources in languages that are known."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, language, text in zip(*batch.columns):
                yield from ((path.as_py(), *fact) for fact in scanned(text.as_py(), language.as_py()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fact_batches(found(batches))

    language = detect_language(F.col("path"))
    rows = files.where(language.isin(SCANNED)).select("path", language.alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    parsed = python_facts(files)
    return parsed.unionByName(spread(rows).mapInArrow(run, parsed.schema))
