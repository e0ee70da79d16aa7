"""Scalar functions over columns.  All are native expressions; none looks at another row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of known credentials, in the order in which they are replaced.
KNOWN_SECRETS = [
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bASIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"-----BEGIN(?: RSA| EC| OPENSSH| DSA)? PRIVATE KEY-----[\s\S]+?-----END(?: RSA| EC| OPENSSH| DSA)? PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{10,}\b",
]
REDACTED = "[REDACTED]"
TOKEN_RUN, MIN_ENTROPY = r"[A-Za-z0-9+/=_.-]{20,}", 4.2

# The phrases that tell a question's route, in the order in which they are tried.  A phrase starts
# and ends at a word's edge (``^``: at the question's start), and any white space may stand between its words.
SUBJECTS = ["repo", "project", "codebase", "application", "app", "service"]
ROUTE_PHRASES = [
    ("explain", ["trace", "walk me through"]),
    ("dependencies", "library libraries package packages dependency dependencies npm pypi gem gems crate crates".split()),
    ("endpoints", ["endpoint", "endpoints", "route", "routes", "api does", "api expose", "api surface", "api look", "rest api", "http api", "http endpoint", "http endpoints"]),
    ("locate", ["^ where is", "^ where are", "^ where does", "which file", "which module handles", "which class handles", "which function handles"]),
    ("overview", [f"what does this {x} do" for x in SUBJECTS]),
    ("overview", [f"what is this {x} {y}" for x in SUBJECTS for y in ("for", "about")]),
    ("overview", ["give me a overview", "give me an overview", "summary", "summarize"]),
    ("explain", ["how does", "how is ... implemented"]),
]
#: The routes, in the order in which a model's answer is searched for them.
ROUTES = ["dependencies", "endpoints", "locate", "explain", "overview"]


def phrase_pattern(phrase: str) -> str:
    """A phrase as a pattern; ``...`` stands for any words of the same line."""
    start = r"^\s*" if phrase.startswith("^ ") else r"\b"
    parts = [r"\s+".join(part.split()) for part in phrase.removeprefix("^ ").split("...")]
    return start + r"\b.*\b".join(parts) + r"\b"


ROUTE_CUES = [(route, "|".join(map(phrase_pattern, phrases))) for route, phrases in ROUTE_PHRASES]
FOLLOW_UP = r"(?i)\b(?:it|its|it's|this|that|these|those|they|them|their|the same|that one|the above|the previous one)\b"
LOCATE_STOPWORDS = "where is are does do the a an defined define implemented located file files which handles handle module function class method for in of this code codebase repo project find locate what and or to".split()
LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CITATION = r"\[([\w./-]+):(\d+)-(\d+)\]"


def split_identifier(name: Column) -> Column:
    """``HTTPServer_getUserById`` becomes ``http server get user by id``."""
    spaced = F.regexp_replace(name, r"[_\-]+", " ")
    spaced = F.regexp_replace(spaced, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), r"\s+", " "))


def searchable_name(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat_ws(" ", name, split_identifier(name)))


def one_break(text: Column) -> Column:
    """Every line break as ``\\n``."""
    return F.regexp_replace(text, LINE_BREAKS, "\n")


def line_count(text: Column) -> Column:
    """Lines of a text whose breaks are ``\\n``: the end of the last line is no line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def chunk_header(path: Column, parent: Column, imports: Column) -> Column:
    """``# path | class P | imports: a, b``, without the parts that are missing."""
    kind = F.when(parent.isNotNull(), F.concat(F.lit("class "), parent))
    used = F.when(F.size(imports) > 0, F.concat(F.lit("imports: "), F.array_join(imports, ", ")))
    return F.concat_ws(" | ", F.concat(F.lit("# "), path), kind, used)


def redact_known(text: Column) -> Column:
    for pattern in KNOWN_SECRETS:
        text = F.regexp_replace(text, pattern, F.lit(REDACTED))
    return text


def shannon_entropy(text: Column) -> Column:
    """Bits per character: ``log2(n) - sum(k * log2(k)) / n`` over the counts ``k`` of the ``n`` characters.

    The characters are sorted once; a run's counter restarts where the character changes, and each further
    character of a run adds the growth of ``k * log2(k)``.
    """
    n = F.length(text).cast("double")
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        k = F.when(c == s["last"], s["k"] + 1).otherwise(F.lit(1.0))
        grown = F.when(k == 1, F.lit(0.0)).otherwise(k * F.log2(k) - s["k"] * F.log2(F.greatest(s["k"], F.lit(1.0))))
        return F.struct(c.alias("last"), k.alias("k"), (s["sum"] + grown).alias("sum"))

    done = F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), zero, step, lambda s: s["sum"])
    return F.when(n > 0, F.log2(n) - done / n).otherwise(F.lit(0.0))


def redact_entropy(text: Column) -> Column:
    """Long token runs with a digit and high entropy go; the rest stays in place."""
    gaps, runs = F.split(text, TOKEN_RUN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN_RUN})"), F.lit(1))
    hidden = F.transform(runs, lambda r: F.when(r.rlike("[0-9]") & (shannon_entropy(r) >= MIN_ENTROPY), F.lit(REDACTED)).otherwise(r))
    return F.array_join(F.zip_with(gaps, hidden, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")


def redact_secrets(text: Column) -> Column:
    return redact_entropy(redact_known(text))


def route_question(question: Column) -> Column:
    """The first cue that a question has names its route; null if it has none."""
    chosen = F.lit(None).cast("string")
    for name, pattern in reversed(ROUTE_CUES):
        chosen = F.when(question.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(chosen)
    return chosen


def parse_route(answer: Column) -> Column:
    """The first route named in a model's answer, ``explain`` if none is."""
    chosen = F.lit("explain")
    for name in reversed(ROUTES):
        chosen = F.when(F.contains(F.lower(answer), F.lit(name)), F.lit(name)).otherwise(chosen)
    return chosen


def is_follow_up(question: Column) -> Column:
    return question.rlike(FOLLOW_UP)


def candidate_names(question: Column) -> Column:
    """Names a question may be about: quoted in back-ticks, then looking like symbols, then other words."""
    ticked = F.regexp_extract_all(question, F.lit(r"`([A-Za-z_][A-Za-z0-9_]*)`"), F.lit(1))
    words = F.regexp_extract_all(question, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    bare = F.filter(words, lambda w: ~F.lower(w).isin(LOCATE_STOPWORDS))
    symbol = lambda w: w.rlike(r"^[A-Z][a-zA-Z0-9]*[A-Z]|_")
    return F.array_distinct(F.concat(ticked, F.filter(bare, symbol), F.filter(bare, lambda w: ~symbol(w))))


def permalink(owner: Column, repo: Column, sha: Column, path: Column, start: Column, end: Column) -> Column:
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/blob/"), sha, F.lit("/"), path, F.lit("#L"), start.cast("string"))
    return F.when(start == end, base).otherwise(F.concat(base, F.lit("-L"), end.cast("string")))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.003, price_out: float = 0.015) -> Column:
    return tokens_in / 1000 * price_in + tokens_out / 1000 * price_out


def judge_score(answer: Column) -> Column:
    return F.nullif(F.regexp_extract(answer, "([012])", 1), F.lit("")).cast("int")


def rerank_order(answer: Column, n: Column) -> Column:
    """Zero-based places named by a model's answer: in range, each once, order kept; null if none is."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int") - 1)
    order = F.array_distinct(F.filter(named, lambda x: (x >= 0) & (x < n)))
    return F.when(F.size(order) > 0, order)


def parent_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """All directories above a path, the highest first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def combined_hash(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(p, F.lit("\0"))), ""), 256)


def pep508_name(spec: Column) -> Column:
    return F.regexp_extract(F.trim(spec), r"^([A-Za-z0-9._-]+)", 1)


def pep508_version(spec: Column) -> Column:
    rest = F.trim(F.regexp_replace(F.trim(spec), r"^[A-Za-z0-9._-]+", ""))
    return F.nullif(rest, F.lit(""))



def join_route(prefix: Column, path: Column) -> Column:
    """A path below a prefix; without a prefix only a leading slash is added."""
    own = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", ""), own)


def controller_route(prefix: Column, path: Column, slash: bool) -> Column:
    """A method's path below its controller's.  An empty path is a slash, or with ``slash`` false nothing."""
    rooted = lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    own = rooted(path) if slash else F.when(path == "", F.lit("")).otherwise(rooted(path))
    above = F.when(prefix == "", F.lit("")).otherwise(F.regexp_replace(rooted(prefix), "/+$", ""))
    return F.coalesce(F.nullif(F.concat(above, own), F.lit("")), F.lit("/"))



def scrubbed(text: Column, secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit("***")))
