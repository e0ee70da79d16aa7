"""Secret scans with multipart credential linking, all in DataFrame expressions.

**Strong parts** are reported wherever they stand: assignments of long values to secret-like names, access
identifiers, and long runs of lower-case hexadecimal digits.  **Weak parts** mean nothing alone: short
values assigned to secret-like names or bare mixed runs (``secret``), account names (``ident``), and URLs
(``endpoint``).  An interval join links them: two parts are within one scope if no more than ``SCOPE`` code
points lie between them.  A weak identifier is reported if a secret, strong or weak, is in its scope; a weak
secret if an identifier is; an endpoint if both are.  A *credential* is an identifier with the secret nearest to it and,
if there is one, the nearest endpoint, all in its scope.

Each pattern is run once over a text, and only if plain substrings that every match of it holds are there.

Places come from the pieces between the matches and the matches themselves, whose lengths are summed in
blocks.  The interval join cuts each document into bins of one scope's length.  Per bin and role only the
first start and the last end matter to a neighbour, so parts are aggregated before the join, and the join is
an equi-join on document and bin with one partner per row: no pairs within a document are formed.  Identifiers meet the
parts of the bins around them to find the nearest; a bin has room for few parts, so there are few partners.

Defined cases: a null text counts as empty and has no parts; null or repeated identifiers do no harm, as
rows are told apart by a number of their own; places are code points, ends exclusive; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Strong kinds in order: name, pattern, the group that counts, its least length.
NAMES = r"(?i:(password|passwd|secret|token|api_?key))"
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
STRONG = [
    ("assign", NAMES + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
#: Weak kinds in order: name, pattern, the group that counts, its least and greatest length (if there is one).
WEAK = [
    ("secret", NAMES + VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 6, 11),
    ("secret", r"([A-Za-z0-9+/]{32,})", 1, 32, None),
    ("ident", r"(?i:(access_?key_?id|client_?id|key_?id|user_?name|user|login|account))" + VALUE + r"([A-Za-z0-9+/_.@-]+)", 2, 3, None),
    ("endpoint", r"(https?://([A-Za-z0-9.-]+)[A-Za-z0-9.:/_?&=%-]*)", 2, 4, 253),
]
#: What every match of a pattern holds: of each list one substring, in lower case.
ASSIGNED = [":", "="]
HOLDS = {
    STRONG[0][1]: [["passw", "secret", "token", "api"], ASSIGNED],
    STRONG[1][1]: [["akia"]],
    WEAK[2][1]: [["key", "client", "user", "login", "account"], ASSIGNED],
    WEAK[3][1]: [["://"]],
}
#: Runs of one class begin where none stands before: the same matches, found without trying a run's inner places.
SPELLED = {STRONG[2][1]: r"(?<![0-9a-f])([0-9a-f]{16,})", WEAK[1][1]: r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{32,})"}
#: Code points between two parts of one credential at most.
SCOPE = 200
#: What bare runs must hold, so that words and numbers are no candidates.
MIXED = [r"[A-Z]", r"[a-z]", r"[0-9]"]
ORDER = {kind: i for i, kind in enumerate(["assign", "access", "hex", "ident", "secret", "endpoint"])}
ROLE = {"assign": "secret", "hex": "secret", "access": "ident"}
BLOCK = 512
PART = "struct<start:bigint,ord:int,end:bigint,kind:string>"


def _folded(lengths: str, start: str) -> str:
    """SQL: the running start of each ``(gap, hit)`` of an array, given the first one's offset."""
    return f"aggregate({lengths}, struct({start} as at, cast(array() as array<bigint>) as starts), (s, x) -> struct(s.at + x.gap + x.hit as at, array_append(s.starts, s.at + x.gap) as starts), s -> s.starts)"


def _scan(pattern: str, kinds: list[tuple[int, str, int, int, int | None]]) -> list[tuple[str, str]]:
    """Named SQL steps from the columns ``text`` and ``low`` to the arrays of parts ``found<i>`` of ``kinds``: place in
    the list of kinds, name, group, least and greatest length."""
    p = "r'" + SPELLED.get(pattern, pattern).replace("'", "\\x27") + "'"
    blocks = f"transform(sequence(0, cast((size(hits) + {BLOCK - 1}) div {BLOCK} as int) - 1), b -> slice(lengths, b * {BLOCK} + 1, {BLOCK}))"
    holds = " and ".join("(" + " or ".join(f"contains(low, '{x}')" for x in some) + ")" for some in HOLDS.get(pattern, [])) or "true"
    steps = [
        ("hits", f"if({holds}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"),
        ("lengths", f"if(size(hits) = 0, cast(array() as array<struct<gap:bigint,hit:bigint>>), zip_with(slice(split(text, {p}, -1), 1, size(hits)), hits, (g, h) -> struct(cast(length(g) as bigint) as gap, cast(length(h) as bigint) as hit)))"),
        ("blocks", f"if(size(hits) = 0, cast(array() as array<array<struct<gap:bigint,hit:bigint>>>), {blocks})"),
        ("offsets", "aggregate(blocks, struct(0L as at, cast(array() as array<bigint>) as starts), (s, b) -> struct(s.at + aggregate(b, 0L, (t, x) -> t + x.gap + x.hit) as at, array_append(s.starts, s.at) as starts), s -> s.starts)"),
        ("starts", f"flatten(zip_with(blocks, offsets, (b, o) -> {_folded('b', 'o')}))"),
    ]
    for i, kind, group, least, most in kinds:
        own = f"regexp_extract(m.text, {p}, {group})"
        good = f"length({own}) >= {least}" + (f" and length({own}) <= {most}" if most else "")
        if kind == "secret" and group == 1:
            good += "".join(f" and m.text rlike r'{x}'" for x in MIXED)
        steps.append((f"found{i}", f"transform(filter(zip_with(starts, hits, (a, h) -> struct(a as start, h as text)), m -> {good}), m -> cast(struct(m.start, {ORDER[kind]}, m.start + length(m.text), '{kind}') as {PART}))"))
    return steps


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id, strong, weak``: the parts of every row; nothing moves between tasks."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    scans: dict[str, list] = {}
    for i, (kind, pattern, group, least, *most) in enumerate([*STRONG, *WEAK]):
        scans.setdefault(pattern, []).append((i, kind, group, least, most[0] if most else None))
    for pattern, kinds in scans.items():
        for name, step in _scan(pattern, kinds):
            rows = rows.withColumn(name, F.expr(step))
        rows = rows.drop("hits", "lengths", "blocks", "offsets", "starts")
    n = len(STRONG)
    strong = F.concat(*[F.col(f"found{i}") for i in range(n)])
    weak = F.concat(*[F.col(f"found{i}") for i in range(n, n + len(WEAK))])
    return written(rows.select("row", "id", strong.alias("strong"), F.array_distinct(weak).alias("weak")), "parts")


def _binned(parts: DataFrame) -> DataFrame:
    bins = F.expr(f"sequence(start div {SCOPE}, (end - 1) div {SCOPE})")
    return parts.withColumn("bin", F.explode(bins))


def linked(parts: DataFrame) -> DataFrame:
    """``row`` and ``linked``, its array of weak parts whose complements are in scope."""
    role = F.coalesce(*[F.when(F.col("p.kind") == k, F.lit(r)) for k, r in ROLE.items()], F.col("p.kind"))
    some = parts.where(F.size("weak") > 0)
    everything = some.select("row", F.explode(F.concat("strong", "weak")).alias("p")).select("row", "p.start", "p.end", role.alias("role"))
    clipped = _binned(everything).withColumn("first", F.greatest("start", F.col("bin") * SCOPE)).withColumn("last", F.least("end", (F.col("bin") + 1) * SCOPE))
    near = clipped.groupBy("row", "bin", "role").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    seen = near.withColumn("side", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("bin", F.col("bin") + F.col("side"))
    ways = []
    for r in ("ident", "secret"):
        at = lambda side: (F.col("role") == r) & (F.col("side") == side)
        ways += [F.max(F.when(at(0), 1)).alias(f"{r}_here"), F.max(F.when(at(1), F.col("last"))).alias(f"{r}_before"), F.min(F.when(at(-1), F.col("first"))).alias(f"{r}_after")]
    seen = seen.groupBy("row", "bin").agg(*ways)
    weak = _binned(some.select("row", F.explode("weak").alias("p")).select("row", "p", "p.start", "p.end", "p.kind").distinct())
    both = weak.join(seen, ["row", "bin"])

    def close(r: str) -> Column:
        hit = F.col(f"{r}_here").isNotNull() | (F.col(f"{r}_before") >= F.col("start") - SCOPE) | (F.col(f"{r}_after") <= F.col("end") + SCOPE)
        return F.max(F.coalesce(hit, F.lit(False)))

    kinds = both.groupBy("row", "p").agg(close("ident").alias("with_ident"), close("secret").alias("with_secret"))
    told = F.when(F.col("p.kind") == "ident", F.col("with_secret")).when(F.col("p.kind") == "secret", F.col("with_ident")).otherwise(F.col("with_ident") & F.col("with_secret"))
    return kinds.where(told).groupBy("row").agg(F.collect_list("p").alias("linked"))


def credentials(parts: DataFrame) -> DataFrame:
    """``row`` and ``credentials``, an array of ``ident``, ``secret`` and ``endpoint`` (null: none in scope), in order."""
    role = F.coalesce(*[F.when(F.col("p.kind") == k, F.lit(r)) for k, r in ROLE.items()], F.col("p.kind"))
    named = lambda *kinds: F.exists(F.concat("strong", "weak"), lambda p: p["kind"].isin(*kinds))
    some = parts.where(named("ident", "access") & named("assign", "hex", "secret"))
    every = some.select("row", F.explode(F.concat("strong", "weak")).alias("p")).select("row", "p", "p.start", "p.end", role.alias("role"))
    around = F.explode(F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") - 1 + SCOPE) / SCOPE)))
    idents = every.where("role = 'ident'").select(F.col("row").alias("of"), F.col("p").alias("ident"), F.col("start").alias("from"), F.col("end").alias("to"), around.alias("at"))
    others = every.where("role <> 'ident'").select("row", "p", "start", "end", "role", F.explode(F.expr(f"sequence(start div {SCOPE}, (end - 1) div {SCOPE})")).alias("bin"))
    gap = F.greatest(F.lit(0), F.col("start") - F.col("to"), F.col("from") - F.col("end"))
    met = idents.join(others, (F.col("of") == F.col("row")) & (F.col("at") == F.col("bin"))).withColumn("gap", gap).where(F.col("gap") <= SCOPE)
    nearest = lambda r: F.min(F.when(F.col("role") == r, F.struct("gap", "p")))["p"].alias(r)
    found = met.groupBy("of", "ident").agg(nearest("secret"), nearest("endpoint")).where("secret IS NOT NULL")
    return found.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("ident", "secret", "endpoint"))).alias("credentials"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, ``base`` and ``spans``: sorted arrays of parts (``start``, ``ord``, ``end``, ``kind``), and
    ``credentials``, the parts that belong together."""
    parts = _parts(docs, id_col, text_col)
    rows = parts.join(linked(parts).withColumnRenamed("row", "linked_row"), F.col("row") == F.col("linked_row"), "left")
    rows = rows.join(credentials(parts), F.col("row") == F.col("of"), "left")
    none = F.expr(f"cast(array() as array<{PART}>)")
    spans = F.concat("strong", F.coalesce("linked", none))
    own = F.coalesce("credentials", F.expr(f"cast(array() as array<struct<ident:{PART},secret:{PART},endpoint:{PART}>>)"))
    return rows.select("id", F.array_sort("strong").alias("base"), F.array_sort(spans).alias("spans"), own.alias("credentials"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each part, comma-joined."""
    return F.array_join(F.transform(spans, _told), ",")


def _told(p: Column) -> Column:
    return F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))


def listed_credentials(found: Column) -> Column:
    """The parts of each credential joined by ``+``, the credentials by commas."""
    one = lambda c: F.array_join(F.array(*[F.when(c[r].isNotNull(), _told(c[r])) for r in ("ident", "secret", "endpoint")]), "+")
    return F.array_join(F.transform(found, one), ",")
