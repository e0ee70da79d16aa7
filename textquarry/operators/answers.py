"""Answers: sessions, citations, event streams and texts of structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION, cost, is_follow_up


def recent_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` of ``turns(session, turn, question, answer)``, numbered from the oldest."""
    last = Window.partitionBy("session").orderBy(F.desc("turn"))
    kept = turns.withColumn("back", F.row_number().over(last)).where(F.col("back") <= n)
    order = Window.partitionBy("session").orderBy("turn")
    return kept.select("session", F.row_number().over(order).cast("long").alias("place"), "turn", "question", "answer", is_follow_up(F.col("question")).alias("follow_up"))


def citations(answers: DataFrame) -> DataFrame:
    """``answer_id, claim, at, path, start_line, end_line`` of each ``[path:start-end]`` of ``answers(answer_id, text)``."""
    pieces = F.filter(F.split("text", r"(?<=[.!?])\s+|\n+", -1), lambda c: F.trim(c) != "")
    claims = answers.select("answer_id", F.posexplode(pieces).alias("claim", "body"))
    groups = [F.regexp_extract_all("body", F.lit(CITATION), F.lit(i)).alias(n) for i, n in ((1, "p"), (2, "s"), (3, "e"))]
    rows = claims.select("answer_id", "claim", F.posexplode(F.arrays_zip(*groups)).alias("at", "c"))
    return rows.select("answer_id", "claim", "at", F.col("c.p").alias("path"), F.expr("try_cast(c.s as bigint)").alias("start_line"), F.expr("try_cast(c.e as bigint)").alias("end_line"))


def verified(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with ``valid`` (the file is known and the lines lie in it) and ``number``, in order, of valid ones."""
    known = files.select(F.col("path").alias("known"), "loc")
    rows = citations(answers).join(known, F.col("path") == F.col("known"), "left")
    good = F.coalesce((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("loc")), F.lit(False))
    order = Window.partitionBy("answer_id", "valid").orderBy("claim", "at")
    rows = rows.withColumn("valid", good).drop("known", "loc")
    return rows.withColumn("number", F.when(F.col("valid"), F.row_number().over(order)).cast("long"))


def verification(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Per answer ``n_valid, n_invalid, validity`` and whether some claim has citations but no valid one."""
    claims = verified(answers, files).groupBy("answer_id", "claim").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"))
    found = claims.groupBy("answer_id").agg(F.sum("good").alias("n_valid"), F.sum("bad").alias("n_invalid"), F.max((F.col("good") == 0).cast("int")).alias("unsupported"))
    rows = answers.select("answer_id").join(found, "answer_id", "left").fillna(0)
    total = F.col("n_valid") + F.col("n_invalid")
    return rows.select("answer_id", "n_valid", "n_invalid", (F.col("n_valid") / F.nullif(total, F.lit(0))).alias("validity"), (F.col("unsupported") == 1).alias("unsupported_claim"))


def without_invalid(text: Column, valid: Column) -> Column:
    """An answer's text without the markers that are not in the array ``valid``."""
    gaps, marks = F.split(text, CITATION, -1), F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    kept = F.transform(marks, lambda m: F.when(F.array_contains(valid, m), m).otherwise(F.lit("")))
    return F.array_join(F.zip_with(gaps, kept, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def events(answers: DataFrame) -> DataFrame:
    """``q, seq, event, data``: the ordered events of ``answers(q, route, text, sources)``."""
    word = lambda w: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(w.alias("text"))).alias("data"))
    one = lambda name, data: F.array(F.struct(F.lit(name).alias("event"), data.alias("data")))
    steps = F.concat(
        one("status", F.to_json(F.struct(F.lit("routing").alias("stage")))),
        one("sources", F.to_json("sources")),
        F.transform(F.split("text", " ", -1), word),
        one("citations", F.to_json(F.regexp_extract_all("text", F.lit(CITATION), F.lit(0)))),
        one("done", F.to_json(F.struct("route"))),
    )
    return answers.select("q", F.posexplode(steps).alias("seq", "e")).select("q", "seq", "e.event", "e.data")


def ordered_events(how: DataFrame, lines: DataFrame, files: DataFrame, tools: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """``q, seq, event, data`` for ``how(q, route, searched, candidates, seeds)`` and ``lines(q, ord, line, path, start_line, end_line, symbol)``.

    The order is: routing; for searched answers retrieving, expanding, generating; sources; generating again, tools with their
    status; tokens; citations; done.  A failure ends an answer: its error follows what there was before the tokens.
    Sources, citations and tokens are a row each, so no answer is gathered; ``ord`` puts the lines in order.
    """
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("a"), none.alias("b"), F.lit(None).cast("long").alias("c"), none.alias("d"))
    data = lambda *columns: F.to_json(F.struct(*columns))
    shape = lambda df, step, event, told, order=empty, place=F.lit(0): df.select("q", F.lit(step).alias("step"), order.alias("ord"), place.cast("long").alias("place"), F.lit(event).alias("event"), told.alias("data"))
    status = lambda df, step, stage, detail: shape(df, step, "status", data(F.lit(stage).alias("stage"), detail.alias("detail")))
    searched = how.where("searched")
    parts = [
        status(how, 0, "routing", F.format_string("routed to '%s'", "route")),
        status(searched, 1, "retrieving", F.lit("hybrid search (dense + BM25)")),
        status(searched, 2, "expanding", F.lit("graph expansion (definitions, callers, imports)")),
        status(searched, 3, "generating", F.format_string("reranking %d candidate(s)", "candidates")),
        status(searched, 5, "generating", F.format_string("agent investigating with %d seed chunk(s)", "seeds")),
        shape(lines.where("path IS NOT NULL"), 4, "sources", data("path", "start_line", "end_line", "symbol"), F.col("ord")),
    ]
    if tools is not None:
        called = tools.join(searched.select("q"), "q", "left_semi")
        parts.append(shape(called, 6, "tool", data("name", "input", "result_summary"), place=F.col("place") * 2))
        parts.append(shape(called, 6, "status", data(F.lit("tool_call").alias("stage"), F.col("result_summary").alias("detail")), place=F.col("place") * 2 + 1))
    told, ended = (how, lines), None
    if failures is not None:
        failed = failures.select("q", "message")
        parts.append(shape(failed, 7, "error", data("message")))
        told = tuple(df.join(failed.select("q"), "q", "left_anti") for df in (how, lines))
    ended, said = told
    words = said.select("q", "ord", F.posexplode(F.split("line", " ", -1)).alias("place", "word"))
    parts.append(shape(words, 8, "token", data(F.concat("word", F.lit(" ")).alias("text")), F.col("ord"), F.col("place")))
    cited = verified(said.select(F.struct("q", "ord").alias("answer_id"), F.col("line").alias("text")), files).where("valid")
    cited = cited.select("answer_id.q", "answer_id.ord", (F.col("claim") * 10_000 + F.col("at")).alias("place"), "path", "start_line", "end_line")
    parts.append(shape(cited, 9, "citations", data("path", "start_line", "end_line"), F.col("ord"), F.col("place")))
    parts.append(shape(ended, 10, "done", data(F.when(F.col("searched"), "explain").otherwise(F.col("route")).alias("route"))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    seq = F.row_number().over(Window.partitionBy("q").orderBy("step", "ord", "place")) - 1
    return whole.select("q", seq.cast("long").alias("seq"), "event", "data")


def usage(turns: DataFrame, *keys: str) -> DataFrame:
    """Per answer the calls of a model, their tokens and what these cost; ``turns`` has ``input_tokens`` and
    ``output_tokens``, null where a call reported none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    rows = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), total("input_tokens"), total("output_tokens"))
    return rows.withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens")))


def listed_answer(rows: DataFrame, key: str, title: Column, line: Column, order: list[str]) -> DataFrame:
    """A markdown answer per ``key``: a title, then a line per row in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    done = rows.groupBy(key).agg(items.alias("items"), F.first(title).alias("title"))
    return done.select(key, F.concat_ws("\n", F.col("title"), F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("text"))


def contexts(ranked: DataFrame) -> DataFrame:
    """``q, context``: the chunks of ``(q, rank, path, start_line, end_line, content)`` as one prompt."""
    item = F.struct("rank", F.concat(F.format_string("[%s:%d-%d]\n", "path", "start_line", "end_line"), F.col("content")).alias("t"))
    return ranked.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n---\n\n").alias("context"))
