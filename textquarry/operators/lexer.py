"""What of a source is code: a scanner with a stack of modes, each text read once from left to right.

``blanked`` gives a text of the same length and lines in which comments, the insides of strings and regular expressions
are blanks, so brackets and names that are left are code.  Modes nest: a template in a script may hold code that holds a
template, and so may a string in Ruby.  A slash begins a regular expression where the token before it cannot end a value.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

SCRIPTS = ("javascript", "typescript", "tsx")
_LEFT, _RIGHT = "([{", {")": "(", "]": "[", "}": "{"}

#: What ends plain code, by language.  A scan goes on behind what it finds, so none of these looks further than it takes.
_STOPS = {
    **dict.fromkeys(SCRIPTS, re.compile(r"//|/\*|[\"'`{}/]")),
    "go": re.compile(r"//|/\*|[\"'`]"),
    "java": re.compile(r'//|/\*|"""|["\']'),
    "rust": re.compile(r"""//|/\*|(?<![\w])(?:b?r\#*"|b')|["']"""),
    "ruby": re.compile(r"""[\#"'`{}/\n]|^=begin\b|^__END__$|<<[~-]?(?:["'`]\w+["'`]|[A-Z_]\w*)|%[wWiIqQr]?[\[({<|!]""", re.M),
}
_STRINGS = {q: re.compile(rf"{q}(?:\\(?:.|\n)|[^{q}\\\n])*+(?:{q}|(?=\n)|\Z)") for q in "\"'"}
_LONG = {q: re.compile(rf"(?s){q}(?:\\.|[^{q}\\])*+(?:{q}|\Z)") for q in "\"'"}
_RAW = re.compile(r"`[^`]*+(?:`|\Z)")
_CHAR = re.compile(r"b?'(?:\\[^\n']++'?|[^'\\\n])'")
_TEXT = {"`": re.compile(r"\\(?:.|\n)|`|\$\{"), '"': re.compile(r"\\(?:.|\n)|\"|\#\{"), "$": re.compile(r"\\(?:.|\n)|`|\#\{")}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*")
_VALUE = re.compile(r"(?:[\w$)\]}\"]|\+\+|--)\Z")
_KEYWORD = re.compile(r"(?<![\w.$])(?:return|typeof|instanceof|in|of|new|delete|void|throw|case|do|else|yield|await|and|or|not|if|elsif|unless|when|while|until|then)\Z")
_NESTED = re.compile(r"/\*|\*/")
_CLOSING = {"[": "]", "(": ")", "{": "}", "<": ">"}


class _Scan:
    def __init__(self, text: str, language: str) -> None:
        self.text, self.language, self.at = text, language, 0
        self.done: list[str] = []
        #: What encloses the code now: the texts that it lies in, each with the depth of braces of the code in it.
        self.within: list[list] = []
        self.last = ""
        self.heredocs: list[str] = []

    def code(self, to: int) -> None:
        if to > self.at:
            part = self.text[self.at : to]
            self.done.append(part)
            self.last = part.rstrip(" \t\n\r")[-24:] or self.last
            self.at = to

    def blank(self, to: int, edges: bool = False) -> None:
        """Blank up to ``to``; with ``edges`` the quotes at both ends stay."""
        part = self.text[self.at : to]
        bare = re.sub(r"[^\n]", " ", part)
        self.done.append(part[0] + bare[1:-1] + part[-1] if edges and len(part) > 1 and part[-1] == part[0] else bare)
        self.at = to

    def value(self, to: int, edges: bool = True) -> None:
        self.blank(to, edges)
        self.last = '"'

    def comment(self) -> None:
        end = self.text.find("*/", self.at + 2)
        if self.language == "rust":
            depth, end = 0, -1
            for m in _NESTED.finditer(self.text, self.at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    end = m.start()
                    break
        self.blank(end + 2 if end >= 0 else len(self.text))

    def line(self) -> None:
        end = self.text.find("\n", self.at)
        self.blank(end if end >= 0 else len(self.text))

    def inside(self, kind: str) -> None:
        """Text of a template or string up to its end or to code in it; ``kind`` names what ends it."""
        for m in _TEXT[kind].finditer(self.text, self.at):
            if m[0][0] == "\\":
                continue
            self.blank(m.start())
            if len(m[0]) == 2:
                self.blank(m.end())
                self.within.append([kind, 0])
                self.last = "("
            else:
                self.code(m.end())
                self.last = '"'
            return
        self.blank(len(self.text))

    def brace(self) -> None:
        if self.within:
            own = self.within[-1]
            own[1] += 1 if self.text[self.at] == "{" else -1
            if own[1] < 0:
                self.within.pop()
                self.blank(self.at + 1)
                self.inside(own[0])
                return
        self.code(self.at + 1)

    def slash(self) -> None:
        ends = _VALUE.search(self.last) and not _KEYWORD.search(self.last)
        if ends and self.language == "ruby":  # a method's argument: blank before the slash, none behind it
            ends = not (re.search(r"[\w]\Z", self.last) and self.text[self.at - 1 : self.at] in (" ", "\t") and self.text[self.at + 1 : self.at + 2] not in ("", " ", "=", "\n"))
        m = None if ends else _PATTERN.match(self.text, self.at)
        if m:
            self.value(m.end(), False)
        else:
            self.code(self.at + 1)

    def heredoc_bodies(self) -> None:
        """From a line's end: the bodies that the line announced."""
        self.code(self.at + 1)
        for name in self.heredocs:
            end = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$", re.M).search(self.text, self.at)
            self.blank(end.end() if end else len(self.text))
        self.heredocs = []

    def listed(self, opening: str) -> None:
        """A literal between brackets of its own, which may nest."""
        close, depth, at = _CLOSING.get(opening, opening), 0, self.at
        at = self.text.index(opening, at)
        for m in re.compile(rf"\\.|[{re.escape(opening)}{re.escape(close)}]").finditer(self.text, at):
            if m[0][0] != "\\":
                depth += 1 if m[0] == opening and (opening != close or not depth) else -1
                if depth <= 0:
                    self.value(m.end(), False)
                    return
        self.value(len(self.text), False)

    def run(self) -> str:
        while m := _STOPS[self.language].search(self.text, self.at):
            self.code(m.start())
            mark = m[0]
            if mark in ("//", "#"):
                self.line()
            elif mark == "/*":
                self.comment()
            elif mark in "{}":
                self.brace()
            elif mark == "/":
                self.slash()
            elif mark == "\n":
                if self.heredocs:
                    self.heredoc_bodies()
                else:
                    self.code(m.end())
            else:
                (self.ruby if self.language == "ruby" else self.quoted)(mark)
        self.code(len(self.text))
        return "".join(self.done)

    def quoted(self, mark: str) -> None:
        if mark == '"""':
            end = self.text.find('"""', self.at + 3)
            self.value(end + 3 if end >= 0 else len(self.text))
        elif self.language == "rust" and mark[-1] == "'":
            m = _CHAR.match(self.text, self.at)
            self.value(m.end()) if m else self.code(self.at + len(mark))  # else a lifetime
        elif self.language == "rust" and len(mark) > 1:
            end = self.text.find('"' + "#" * mark.count("#"), self.at + len(mark))
            self.value(end + 1 + mark.count("#") if end >= 0 else len(self.text), False)
        elif self.language == "rust":
            self.value(_LONG['"'].match(self.text, self.at).end())
        elif mark == "`" and self.language in SCRIPTS:
            self.code(self.at + 1)
            self.inside("`")
        elif mark == "`":
            self.value(_RAW.match(self.text, self.at).end())
        else:
            self.value(_STRINGS[mark].match(self.text, self.at).end())

    def ruby(self, mark: str) -> None:
        if mark.startswith("=begin"):
            end = re.compile(r"^=end\b", re.M).search(self.text, self.at)
            self.blank(end.end() if end else len(self.text))
        elif mark == "__END__":
            self.blank(len(self.text))
        elif mark.startswith("<<"):
            # An operator before an operand is a shift.
            if mark[2] not in "~-" and re.search(r"[\w)\]]\Z", self.text[max(self.at - 1, 0) : self.at]):
                self.code(self.at + 2)
            else:
                self.heredocs.append(mark[2:].strip("~-\"'`"))
                self.value(self.at + len(mark), False)
        elif mark.startswith("%"):
            spaced = self.text[self.at - 1 : self.at] in (" ", "\t", "\n", "(", ",", "=", "[", "")
            if len(mark) > 2 and spaced or spaced and not _VALUE.search(self.last):
                self.listed(mark[-1])
            else:
                self.code(self.at + 1)
        elif mark == "'":
            self.value(_LONG["'"].match(self.text, self.at).end())
        else:
            self.code(self.at + 1)
            self.inside('"' if mark == '"' else "$")


def blanked(text: str, language: str) -> str:
    """The text with all that is no code as blanks; quotes stay at the ends of strings."""
    return _Scan(text, language).run()


def brackets(bare: str) -> dict[int, int] | None:
    """Places of opening brackets with those of their closing ones; None where they do not match."""
    found: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[()\[\]{}]", bare):
        if m[0] in _LEFT:
            stack.append(m.start())
        elif not stack or bare[stack[-1]] != _RIGHT[m[0]]:
            return None
        else:
            found[stack.pop()] = m.start()
    return None if stack else found


_GOES_ON = re.compile(r"\s*+(?:else\b|catch\b|finally\b|while\b|[,;.?:)\]&|+*/=<>-])")
_UNFINISHED = re.compile(r"[,(\[{.?:&|+*/=<>-]\s*+\Z")


def statements(bare: str, pairs: dict[int, int], start: int, stop: int, by_line: bool) -> Iterator[tuple[int, int]]:
    """First and last places of the statements between ``start`` and ``stop``; ``by_line`` where a line's end may end one."""
    at = begin = start
    stops = re.compile(r"[(\[{;\n]" if by_line else r"[(\[{;]")

    def ended(to: int) -> Iterator[tuple[int, int]]:
        part = bare[begin:to]
        if part.strip():
            yield begin + len(part) - len(part.lstrip()), begin + len(part.rstrip()) - 1

    while m := stops.search(bare, at, stop):
        at = m.end()
        if m[0] in _LEFT:
            at = pairs[m.start()] + 1
            if m[0] != "{" or _GOES_ON.match(bare, at, stop):
                continue
            rest = bare.find("\n", at, stop)
            if bare[at : rest if rest >= 0 else stop].strip() not in ("", "}"):
                continue
        elif m[0] == "\n" and (_UNFINISHED.search(bare, max(begin, m.start() - 200), m.start()) or re.compile(r"\s*+[.?:&|+*/=)\]]").match(bare, at, stop)):
            continue
        yield from ended(at)
        begin = at
    yield from ended(stop)


def declarations(bare: str, pairs: dict[int, int], start: int, stop: int) -> Iterator[tuple[int, int | None, int]]:
    """What a class body or a file declares: where it begins, its braces if it has them, its end."""
    at = begin = start
    stops = re.compile(r"[(\[{;]")
    while m := stops.search(bare, at, stop):
        at = m.end()
        if m[0] in "([":
            at = pairs[m.start()] + 1
        elif m[0] == "{":
            at = pairs[m.start()] + 1
            yield begin, m.start(), at
            begin = at
        else:
            yield begin, None, at
            begin = at


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_of(starts: list[int]) -> Callable[[int], int]:
    return lambda at: bisect_left(starts, at + 1)
