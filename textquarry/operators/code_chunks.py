"""Chunks of sources by definition, from the facts of one parse and the lines of the file.

A function or method is a chunk, decorators included; a class or the like gives a shell, its lines before the first
definition in it; what stands at the top level between definitions gives ``module`` chunks.  Blank ends are
cut and blank chunks dropped.  Files that do not parse have no facts and are cut into plain windows.

A function above ``max_tokens`` whose statements are known (Python) is packed: windows of as many whole statements as
fit, one at least, each window starting with the last statement of the one before.  A statement's lines begin after
those of the statement before, so comments stay; the first has the function's head too.  Other large chunks come in
windows of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_count
from ..sources.files import detect_language, lines_of
from ..sources.scratch import written
from .chunking import MAX_TOKENS, window_chunks
from .source_facts import CONTAINERS, SCANNED
from .structured import smallest_enclosing

#: Languages whose sources are cut by definitions.
DEFINED = ["python", *SCANNED]
COLUMNS = ["path", "symbol_name", "symbol_kind", "parent_symbol", "start_line", "end_line", "content"]


def _pieces(lines: DataFrame, *keys: str) -> DataFrame:
    """Consecutive lines of each key as one text, without blank ends."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    rows = lines.groupBy(*keys).agg(F.min("line").alias("first"), body.alias("body"))
    return _without_blank_ends(rows)


def _without_blank_ends(rows: DataFrame) -> DataFrame:
    """``start_line, end_line, content`` of ``body``, whose first line is ``first``; blank bodies go."""
    lead = F.regexp_extract("body", r"^((?:[ \t]*\n)*)", 1)
    rows = rows.withColumn("content", F.regexp_replace(F.regexp_replace("body", r"^(?:[ \t]*\n)*", ""), r"\s+$", "")).where("content <> ''")
    start = F.col("first") + F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
    return rows.withColumn("start_line", start.cast("long")).withColumn("end_line", (start + line_count(F.col("content")) - 1).cast("long")).drop("first", "body")


def _packs(statements: Column, most: int) -> Column:
    """Windows ``(start, end)`` over an array of ``(start, end, size)``: greedy, with one statement of overlap."""
    pair = "struct<start:bigint,end:bigint>"
    last = "struct<start:bigint,end:bigint,size:bigint>"
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("start"), F.lit(None).cast(last).alias("last"), F.array().cast(f"array<{pair}>").alias("done"))
    state = lambda n, size, start, x, done: F.struct(n.cast("int").alias("n"), size.alias("size"), start.alias("start"), x.alias("last"), done.alias("done"))
    window = lambda start, x: F.array(F.struct(start.alias("start"), x["end"].alias("end")))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] == 0) | (s["size"] + x["size"] <= most)
        closed = F.concat(s["done"], window(s["start"], s["last"]))
        # The overlap is the last statement, unless it was all of the window or leaves no room for the next.
        again = (s["n"] > 1) & (s["last"]["size"] + x["size"] <= most)
        alone = F.when(s["n"] > 1, F.concat(closed, window(s["last"]["start"], s["last"]))).otherwise(closed)
        return (
            F.when(fits, state(s["n"] + 1, s["size"] + x["size"], F.when(s["n"] == 0, x["start"]).otherwise(s["start"]), x, s["done"]))
            .when(again, state(F.lit(2), s["last"]["size"] + x["size"], s["last"]["start"], x, closed))
            .otherwise(state(F.lit(1), x["size"], x["start"], x, alone))
        )

    return F.aggregate(statements, empty, step, lambda s: F.concat(s["done"], window(s["start"], s["last"])))


def _with_statements(large: DataFrame, facts: DataFrame) -> DataFrame:
    """``large`` chunks with ``ends``, the last lines of their statements; null where none is known."""
    own = ["path", "range_id"]
    parts = facts.where("fact = 'statement'").select(F.col("path").alias("p"), F.col("name").alias("of"), F.col("start").alias("at"), F.col("end").alias("till"))
    held = (F.col("path") == F.col("p")) & (F.col("symbol_name") == F.col("of")) & F.col("at").between(F.col("start_line"), F.col("end_line"))
    functions = large.where(~F.col("symbol_kind").isin(CONTAINERS)).select(*own, "symbol_name", "start_line", "end_line")
    ends = functions.join(parts.hint("merge"), held).groupBy(*own).agg(F.array_sort(F.collect_set("till")).alias("ends"))
    return large.join(ends.hint("merge"), own, "left")


def _packed(functions: DataFrame, most: int) -> DataFrame:
    """Windows of whole statements of ``functions`` with ``ends``."""
    rows = functions.withColumn("rows", F.split("content", "\n", -1))
    # The last statement takes what is left of the function.
    till = F.concat(F.slice("ends", 1, F.size("ends") - 1), F.array(F.col("end_line")))
    begins = F.concat(F.array(F.col("start_line")), F.transform(F.slice(till, 1, F.size(till) - 1), lambda e: e + 1))
    size = lambda a, b: F.aggregate(F.slice("rows", (a - F.col("start_line") + 1).cast("int"), (b - a + 1).cast("int")), F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 1)
    statements = F.zip_with(begins, till, lambda a, b: F.struct(a.alias("start"), b.alias("end"), size(a, b).alias("size")))
    rows = rows.withColumn("statements", statements).withColumn("w", F.explode(_packs(F.col("statements"), most)))
    text = F.array_join(F.slice("rows", (F.col("w.start") - F.col("start_line") + 1).cast("int"), (F.col("w.end") - F.col("w.start") + 1).cast("int")), "\n")
    return _without_blank_ends(rows.select("path", "symbol_name", "symbol_kind", "parent_symbol", F.col("w.start").alias("first"), text.alias("body")))


def definition_chunks(files: DataFrame, facts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``path, symbol_name, symbol_kind, parent_symbol, start_line, end_line, content`` of all sources.

    Facts are written, so that sources are parsed once.  No join is a broadcast: Spark would judge by the size of the
    compressed table that files come from, which says little about their lines and symbols.
    """
    sources = files.where(detect_language(F.col("path")).isin(DEFINED))
    facts = written(facts.where("fact IN ('symbol', 'statement')"), "definitions")
    symbols = facts.where("fact = 'symbol'").select("path", "kind", "name", "parent", "start", "end").withColumn("range_id", F.xxhash64("path", "start", "end", "name"))
    lines = lines_of(sources.join(symbols.select("path").distinct().hint("merge"), "path", "left_semi"), "path")
    # Blocks of one file may share a name: what lies in a block is its own.
    child = symbols.select(F.col("path").alias("p"), F.col("parent").alias("n"), F.col("start").alias("at"))
    holds = (F.col("path") == F.col("p")) & (F.col("name") == F.col("n")) & F.col("at").between(F.col("start"), F.col("end"))
    inner = symbols.where(F.col("kind").isin(CONTAINERS)).join(child.hint("merge"), holds).groupBy("range_id").agg(F.min("at").alias("inner"))
    known = symbols.join(inner.hint("merge"), "range_id", "left")
    rows = smallest_enclosing(lines.select("path", F.col("text").alias("point_id"), "line"), known, "path", "name", "kind", "parent", "inner").withColumnRenamed("point_id", "text")
    defined = rows.where("range_id IS NOT NULL AND (inner IS NULL OR line < inner)")
    named = _pieces(defined, "path", "range_id", "name", "kind", "parent").select("path", "range_id", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), F.col("parent").alias("parent_symbol"), "start_line", "end_line", "content")
    rest = rows.where("range_id IS NULL").withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line")))
    none = F.lit(None).cast("string")
    module = _pieces(rest, "path", "island").select("path", F.lit(None).cast("long").alias("range_id"), none.alias("symbol_name"), F.lit("module").alias("symbol_kind"), none.alias("parent_symbol"), "start_line", "end_line", "content")
    whole = written(named.unionByName(module), "pieces")  # read several times below
    most = 4 * max_tokens
    small = whole.where(F.length("content") <= most).select(*COLUMNS)
    large = _with_statements(whole.where(F.length("content") > most), facts)
    packed = _packed(large.where("ends IS NOT NULL"), most)
    large = large.where("ends IS NULL").withColumnsRenamed({"content": "text", "start_line": "top"})
    cut = window_chunks(large, "path", "symbol_name", "symbol_kind", "parent_symbol", "top", size=most)
    cut = cut.withColumn("start_line", F.col("start_line") + F.col("top") - 1).withColumn("end_line", F.col("end_line") + F.col("top") - 1)
    plain = window_chunks(sources.join(symbols.select("path").distinct().hint("merge"), "path", "left_anti"), "path")
    plain = plain.select("path", none.alias("symbol_name"), F.lit("module").alias("symbol_kind"), none.alias("parent_symbol"), "start_line", "end_line", "content")
    return small.unionByName(packed.select(*COLUMNS)).unionByName(cut.select(*COLUMNS)).unionByName(plain)
