"""The whole index of a set of files, and batches of questions answered from it.

Building cuts each file by what it is (sections, definitions, windows), reads symbols, calls, endpoints and
dependencies out of it, links chunks by calls and headers, and lays out postings by term and vectors by chunk.
Questions come in batches keyed by ``q``; each goes the way of its route.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.files import detect_language
from ..sources.scratch import written
from . import answers, chunking, code_chunks, extraction, graph, incremental, retrieval, source_facts, structured, summaries, vector_lists
from .segments import Segments

#: How many of a file's imports its chunks' headers name, and where they are looked for.
HEADER_IMPORTS, HEADER_CHARS = 6, 2000
#: Names in a line of dependencies; characters of a chunk that a reranking model reads.
NAMES, SNIPPET = 200, 400
TABLES = ["files", "chunks", "facts", "edges"]
#: From ``q, prompt`` to ``q, answer``.
Rerank = Callable[[DataFrame], DataFrame]
CHUNK = ["path", "symbol_name", "symbol_kind", "parent_symbol", "start_line", "end_line", "content"]


@dataclass
class Answers:
    """``how(q, question, route, searched, candidates, seeds)`` and ``lines(q, ord, line, path, start_line, end_line, symbol)``."""

    how: DataFrame
    lines: DataFrame


@dataclass
class Index:
    """Tables of one snapshot.

    ``files`` has ``path, text, content_hash, loc``; ``chunks`` has ``chunk_id``, the columns of ``CHUNK``, ``header``
    and ``tokens``; ``facts`` are those of sources in all languages that are known; ``edges`` has ``src, dst, kind, ord``
    over chunks; ``lists`` are inverted lists of vectors, ``postings`` segments of words.  An index that was never stored has
    no segments yet: its words are searched where they are, and are laid out when it is saved or refreshed.
    """

    files: DataFrame
    chunks: DataFrame
    facts: DataFrame
    edges: DataFrame
    lists: vector_lists.Lists
    postings: Segments | None

    @classmethod
    def build(cls, files: DataFrame, redact: Callable[[Column], Column] | None = fn.redact_secrets, most: int | None = None) -> Index:
        """Secrets are redacted in whole texts before anything is cut, so none is split over two chunks.

        With ``most`` an index of more chunks is refused before anything is made of them.
        """
        # Written, as each kind of chunk reads it: redaction is the dearest step and runs once.
        clean = files if redact is None else written(files.withColumn("text", redact(F.col("text"))), "clean")
        facts = written(source_facts.source_facts(clean), "facts")
        chunks = written(chunks_of(clean, facts), "chunks")
        if most is not None:
            within_cap(chunks, most)
        edges = written(edges_of(chunks, facts), "edges")
        return cls(files, chunks, facts, edges, vector_lists.built(written(vectors_of(chunks), "vectors")), None)

    def segments(self) -> Segments:
        return Segments.of(_searched(self.chunks)) if self.postings is None else self.postings

    def refreshed(self, files: DataFrame, redact: Callable[[Column], Column] | None = fn.redact_secrets) -> Index:
        """The index of a new snapshot.  Chunks, vectors and facts of unchanged files are kept; new chunks are a segment of
        postings and are placed in the lists that are there; references are resolved anew over all files, so none dangles."""
        status = incremental.diff(self.files, files)
        clean = files if redact is None else files.withColumn("text", redact(F.col("text")))
        facts = written(incremental.refreshed(self.facts, clean, status, source_facts.source_facts), "facts")
        chunks = written(incremental.refreshed(self.chunks, clean, status, lambda f: chunks_of(f, source_facts.source_facts(f))), "chunks")
        vectors = self.lists.vectors
        kept = vectors.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi").select("id", "v")
        fresh = vectors_of(chunks.join(vectors.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"))
        centres = vector_lists.centres_of(self.lists)
        lists = vector_lists.built(kept.unionByName(fresh), centres if len(centres) else None)
        return Index(files, chunks, facts, written(edges_of(chunks, facts), "edges"), lists, self.segments().refreshed(_searched(chunks)))

    def saved(self, folder: str, batch: int | None = None, before_commit: Callable[[], None] | None = None) -> Index:
        """Written as Parquet in a folder of its own and read back; segments that are stored already stay where they are.

        The version's name is added to ``versions`` when all its tables are there, so an index may be saved to the
        folder that it was read from, and a job that fails leaves the version before it in place.  Of two savers the
        later one's version counts.  ``batch`` is the number of the stream's batch that made the version, stored with its name.
        """
        spark, folder = self.files.sparkSession, folder.rstrip("/")
        path = f"{folder}/version-{uuid.uuid4().hex}"
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.lists.vectors.repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{path}/vectors")
        self.lists.cells.write.parquet(f"{path}/cells")
        self.lists.centroids.write.parquet(f"{path}/centroids")
        version = [(time.time_ns(), path, self.segments().saved(folder), batch)]
        if before_commit is not None:
            before_commit()
        spark.createDataFrame(version, "at long, path string, postings string, batch long").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
        return Index.opened(spark, folder)

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> Index:
        """The last version that was saved."""
        last = _last_version(spark, folder)
        if last is None:
            raise ValueError(f"{folder} holds no index")
        read = lambda name: spark.read.parquet(f"{last.path}/{name}")
        lists = vector_lists.Lists(read("vectors"), read("cells"), read("centroids"))
        return cls(*map(read, TABLES), lists, Segments.opened(spark, last.postings))

    def counts(self) -> DataFrame:
        return self.files.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("text")).alias("size_bytes"), F.sum("loc").alias("loc"))

    def endpoints(self) -> DataFrame:
        return extraction.endpoints(self.files)

    def dependencies(self) -> DataFrame:
        return extraction.dependencies(self.files)

    def summaries(self, depth: int = 1) -> DataFrame:
        return summaries.hierarchy(summaries.file_summaries(self.files), depth)

    def search(self, questions: DataFrame, k: int = 10, top: int = 30) -> DataFrame:
        """``q, rank, id, score``: BM25, over postings if there are any, and nearest hashed vectors, fused."""
        asked = retrieval.hash_vectors(questions.select("q", F.col("question").alias("text")), "q")
        words = retrieval.bm25(_searched(self.chunks), questions, k, once=True) if self.postings is None else self.postings.bm25(questions, k)
        return retrieval.reciprocal_rank_fusion([vector_lists.search(self.lists, asked, k), words], top)

    def contexts(self, questions: DataFrame, k: int = 10, hops: int = graph.HOPS, budget: int = graph.BUDGET) -> DataFrame:
        """``q, rank, id``: what is found, and after it the chunks that calls and headers link to it, within a budget."""
        found = written(self.search(questions, k).select("q", "rank", "id"), "found")
        tokens = self.chunks.select(F.col("chunk_id").alias("id"), "tokens")
        more = graph.expand(found, self.edges, tokens, hops, budget).select("q", (F.col("hop") * 1_000_000 + F.col("rank")).alias("rank"), "id")
        return graph.ranked_union(found, more)

    def reranked(self, questions: DataFrame, ranked: DataFrame, rerank: Rerank | None = None, keep: int = retrieval.KEEP) -> DataFrame:
        """The best ``keep`` of ``ranked(q, rank, id)``.

        ``rerank`` gets ``q, prompt`` of the questions with more than ``keep`` candidates and gives ``q, answer``, in which the
        model names snippets by number.  Without it, or where it gives nothing of use, the order stays.
        """
        orders = ranked.select("q", F.lit(None).cast("array<int>").alias("order")).limit(0)
        if rerank is not None:
            shown = ranked.join(self.chunks.select(F.col("chunk_id").alias("id"), "path", "symbol_name", "start_line", "end_line", "content"), "id")
            place = F.format_string("%d. [%s:%d-%d] ", F.col("rank"), "path", "start_line", "end_line")
            told = F.concat(place, F.coalesce("symbol_name", F.lit("")), F.lit("\n"), F.substring("content", 1, SNIPPET))
            # A question has at most as many candidates as the search and the budget of expansion let through.
            listed = shown.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", told.alias("told")))).alias("snippets")).where(F.col("n") > keep)
            prompt = F.concat(F.col("question"), F.lit("\n\n"), F.array_join(F.transform("snippets", lambda x: x["told"]), "\n\n"))
            prompts = written(listed.join(questions.select("q", "question"), "q").select("q", "n", prompt.alias("prompt")), "prompts")
            named = rerank(prompts.select("q", "prompt")).join(prompts.select("q", "n"), "q")
            orders = named.select("q", fn.rerank_order(F.col("answer"), F.col("n")).alias("order"))
        return retrieval.reranked(ranked, orders, keep)

    def spans(self, questions: DataFrame, k: int = 10, rerank: Rerank | None = None) -> DataFrame:
        """The context of each question, reranked, adjacent chunks merged: ``q, file_rank, path, start, end, content``."""
        return self._merged(self.reranked(questions, written(self.contexts(questions, k), "contexts"), rerank))

    def _merged(self, ranked: DataFrame) -> DataFrame:
        found = ranked.join(self.chunks, F.col("id") == F.col("chunk_id"))
        rows = found.select("q", "rank", "id", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("symbol_name").alias("symbol"), "content")
        return retrieval.merge_adjacent(rows)

    def definitions(self, questions: DataFrame) -> DataFrame:
        """``q, ord, line, path, start_line, end_line, symbol``: where the first name of a question that is defined is defined;
        other questions have no row."""
        names = questions.select("q", F.posexplode(fn.candidate_names(F.col("question"))).alias("priority", "name"))
        found = structured.located(names, extraction.symbols(self.facts))
        line = F.concat(F.format_string("`%s` (%s) is defined in [%s:%d-%d]", "name", "kind", "path", "start_line", "end_line"), F.coalesce(F.concat(F.lit(" — "), F.split("docstring", "\n")[0]), F.lit("")))
        order = F.struct((~F.col("is_exported")).cast("string").alias("a"), F.col("path").alias("b"), F.col("start_line").cast("long").alias("c"), line.alias("d"))
        return found.select("q", order.alias("ord"), line.alias("line"), "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("name").alias("symbol"))

    def listed(self, route: str) -> DataFrame:
        """``ord, line, path, start_line, end_line, symbol``: the lines of the answer that lists all dependencies or endpoints.

        Dependencies have one line a manifest, cut at ``NAMES`` names, so that a line is bounded.
        """
        if route == "dependencies":
            spec = F.when(F.coalesce("version", F.lit("")) == "", F.col("name")).otherwise(F.concat("name", F.lit(" ("), "version", F.lit(")")))
            numbered = self.dependencies().withColumn("spec", spec).withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("name", "spec")) - 1)
            parts = numbered.groupBy("path", F.floor(F.col("place") / NAMES).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "spec"))), lambda x: x["spec"]), ", ").alias("names"))
            rows = parts.join(numbered.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path")
            head = F.when(F.col("part") == 0, F.format_string("**%s** [%s:1-1] — %d dependencies: ", "path", "path", "n")).otherwise(F.format_string("**%s** [%s:1-1], continued: ", "path", "path"))
            line, key, at, symbol = F.concat(head, "names"), (F.col("path"), F.lit(""), F.col("part")), F.lit(1), F.lit(None).cast("string")
        else:
            rows = self.endpoints()
            told = F.format_string("- `%s %s`", F.coalesce("method", F.lit("ANY")), "route")
            handler = F.coalesce(F.concat(F.lit(" -> `"), "handler", F.lit("`")), F.lit(""))
            auth = F.coalesce(F.concat(F.lit(" (requires auth: "), "auth", F.lit(")")), F.lit(""))
            line, key, at, symbol = F.concat(told, handler, auth, F.format_string(" [%s:%d-%d]", "path", "line", "line")), (F.col("path"), F.lit(""), F.col("line")), F.col("line"), F.col("handler")
        order = F.struct(key[0].alias("a"), key[1].alias("b"), key[2].cast("long").alias("c"), line.alias("d"))
        return rows.select(order.alias("ord"), line.alias("line"), "path", at.cast("long").alias("start_line"), at.cast("long").alias("end_line"), symbol.alias("symbol"))

    def answer_lines(self, questions: DataFrame, k: int = 10, rerank: Rerank | None = None) -> Answers:
        """What answers consist of, a row a line, whatever their length.

        Dependencies and endpoints are listed, names are located, an overview is the root's summary; whatever has no
        such answer is answered from its context, sentence by sentence with its place.
        """
        routed = written(questions.withColumn("route", F.coalesce(fn.route_question(F.col("question")), F.lit("explain"))), "routed")
        of = lambda route: routed.where(F.col("route") == route)
        columns = ["q", "ord", "line", "path", "start_line", "end_line", "symbol"]
        made = self.definitions(of("locate")).select(columns)
        nowhere = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("long").alias("end_line"), F.lit(None).cast("string").alias("symbol")]
        first = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), F.lit("").alias("d")).alias("ord")
        root = self.summaries().where("scope = 'repo' AND content <> ''").select(first, F.col("content").alias("line"), *nowhere)
        made = made.unionByName(of("overview").select("q").crossJoin(F.broadcast(root)))  # one row
        for route, none in (("dependencies", "No dependency manifest was found."), ("endpoints", "No API endpoints were found.")):
            rows = written(self.listed(route), route)
            if rows.isEmpty():
                made = made.unionByName(of(route).select("q", first, F.lit(none).alias("line"), *nowhere))
                continue
            # Every question of the route gets the same lines: a join on a constant, dealt by Spark.
            heads = [] if route == "dependencies" else [of(route).select("q", first, F.lit(f"{rows.count()} endpoint(s):\n").alias("line"), *nowhere)]
            whole = of(route).select("q", "route").join(rows.withColumn("route", F.lit(route)), "route")
            for part in [whole.select(columns), *heads]:
                made = made.unionByName(part)
        made = written(made, "structured")
        rest = written(routed.join(made.select("q").distinct(), "q", "left_anti"), "rest")
        ranked = written(self.contexts(rest.select("q", "question"), k), "contexts")
        spans = written(self._merged(self.reranked(rest, ranked, rerank)), "spans")
        line = F.concat(first_sentence(F.col("content")), F.lit(" "), F.format_string("[%s:%d-%d]", "path", "start", "end"))
        order = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), (F.col("file_rank") * (1 << 32) + F.col("start")).cast("long").alias("c"), line.alias("d"))
        found = spans.select("q", order.alias("ord"), line.alias("line"), "path", F.col("start").cast("long").alias("start_line"), F.col("end").cast("long").alias("end_line"), "symbol")
        how = routed.join(rest.select("q", F.lit(True).alias("searched")), "q", "left").withColumn("searched", F.coalesce("searched", F.lit(False)))
        sizes = how.select("q").join(ranked.groupBy("q").agg(F.count(F.lit(1)).alias("candidates")), "q", "left").join(spans.groupBy("q").agg(F.count(F.lit(1)).alias("seeds")), "q", "left").fillna(0)
        return Answers(written(how.join(sizes, "q"), "how"), made.unionByName(found))

    def answered(self, questions: DataFrame, k: int = 10, rerank: Rerank | None = None, most: int | None = None) -> DataFrame:
        """``q, route, text, n_valid, n_invalid, validity, unsupported_claim`` of ``questions(q, question)``, answers checked.

        A text is one value and holds all lines; with ``most`` its first so many, for callers with a limit.  Answers of
        any length are the rows of ``answer_lines``.
        """
        made = self.answer_lines(questions, k, rerank)
        lines = made.lines
        if most is not None:
            lines = lines.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("ord"))).where(F.col("place") <= most)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text")
        texts = lines.groupBy("q").agg(text)
        rows = written(made.how.join(texts, "q", "left").select("q", "route", F.coalesce("text", F.lit("")).alias("text")), "answers")
        checked = answers.verification(rows.select(F.col("q").alias("answer_id"), "text"), self.files.select("path", "loc"))
        return rows.join(checked.withColumnRenamed("answer_id", "q"), "q")

    def events(self, questions: DataFrame, k: int = 10, rerank: Rerank | None = None, tools: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
        """``q, seq, event, data``: all events of all answers, in order.

        ``tools(q, place, name, input, result_summary)`` are the calls that an agent made, ``failures(q, message)`` what ended an
        answer early.
        """
        made = self.answer_lines(questions, k, rerank)
        return answers.ordered_events(made.how, made.lines, self.files.select("path", "loc"), tools, failures)

    def evaluated(self, golden: DataFrame, k: int = 10) -> DataFrame:
        """``question_id, route, recall_hit, citation_validity`` of a question set: whether an expected file is in a
        question's context or among its citations."""
        asked = golden.select(F.col("id").alias("q"), "question")
        answered = self.answered(asked, k)
        seen = self.contexts(asked, k).join(self.chunks.select(F.col("chunk_id").alias("id"), "path"), "id").select("q", "path")
        cited = answers.citations(answered.select(F.col("q").alias("answer_id"), "text")).select(F.col("answer_id").alias("q"), "path")
        paths = seen.unionByName(cited).groupBy("q").agg(F.collect_set("path").alias("paths"))
        rows = golden.select(F.col("id").alias("q"), F.col("route").alias("expected_route"), "expected_files").join(answered, "q").join(paths, "q", "left")
        hit = F.when(F.size("expected_files") > 0, F.arrays_overlap("expected_files", F.coalesce("paths", F.array().cast("array<string>"))))
        return rows.select(F.col("q").alias("question_id"), "route", (F.col("route") == F.col("expected_route")).alias("route_hit"), hit.alias("recall_hit"), F.col("validity").alias("citation_validity"))


def _last_version(spark: SparkSession, folder: str) -> Row | None:
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/versions").orderBy(F.desc("at"), "path").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _searched(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("id"), "content", fn.searchable_name(F.col("symbol_name")).alias("symbol_name"), "path")


def first_sentence(content: Column) -> Column:
    """The first sentence of a chunk, or its start; brackets go, so that it holds no citation."""
    first = F.regexp_extract(content, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)
    return F.regexp_replace(F.when(first == "", F.substring(content, 1, 120)).otherwise(first), r"[\[\]\n]", " ")


def header_imports(files: DataFrame) -> DataFrame:
    """``path, imports``: the first few modules that a file's beginning imports, each once."""
    heads = files.withColumn("text", F.substring("text", 1, HEADER_CHARS))
    found = extraction.import_edges(heads).groupBy("path", "module").agg(F.min("line").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "module"))), lambda x: x["module"])
    return found.groupBy("path").agg(F.slice(ordered, 1, HEADER_IMPORTS).alias("imports"))


def chunks_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks by what a file is: markdown by sections, sources by definitions, anything else by windows."""
    none = F.lit(None).cast("string")
    language = F.coalesce(detect_language(F.col("path")), F.lit(""))
    sections = chunking.markdown_sections(files.where(language == "markdown").select("path", "text"), "path")
    # What stands after a text's last break is no line of the file.
    last = F.when(F.endswith("content", F.lit("\n")) & (F.col("end_line") > F.col("start_line")), F.col("end_line") - 1).otherwise(F.col("end_line"))
    sections = sections.select("path", F.col("heading").alias("symbol_name"), F.lit("section").alias("symbol_kind"), none.alias("parent_symbol"), "start_line", last.alias("end_line"), "content")
    code = code_chunks.definition_chunks(files.where(language.isin(code_chunks.DEFINED)).select("path", "text"), facts)
    windows = chunking.window_chunks(files.where(~language.isin("markdown", *code_chunks.DEFINED)), "path")
    windows = windows.select("path", none.alias("symbol_name"), F.lit("module").alias("symbol_kind"), none.alias("parent_symbol"), "start_line", "end_line", "content")
    told = summaries.file_summaries(files.select("path", "text", F.md5("text").alias("content_hash"), F.size(F.split("text", "\n")).alias("loc")))
    told = told.where("content <> ''").select(F.col("target_path").alias("path"), none.alias("symbol_name"), F.lit("summary").alias("symbol_kind"), none.alias("parent_symbol"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "content")
    rows = sections.select(*CHUNK).unionByName(code.select(*CHUNK)).unionByName(windows).unionByName(told)
    rows = rows.join(header_imports(files), "path", "left")
    name = F.xxhash64("path", "start_line", "end_line", F.coalesce("symbol_name", F.lit("")), F.md5("content"))
    header = fn.chunk_header(F.col("path"), F.col("parent_symbol"), F.coalesce("imports", F.array().cast("array<string>")))
    return rows.select(name.alias("chunk_id"), *CHUNK, header.alias("header"), fn.token_estimate(F.col("content")).alias("tokens"))


def edges_of(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """``src, dst, kind, ord``: to the head of a chunk's file (0), to what it calls (1), to what calls it (2)."""
    head = chunks.where("symbol_kind = 'module'").groupBy(F.col("path").alias("of")).agg(F.min(F.struct("start_line", "chunk_id"))["chunk_id"].alias("dst"))
    heads = chunks.join(head, F.col("path") == F.col("of")).where("chunk_id <> dst").select(F.col("chunk_id").alias("src"), "dst", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"))
    symbols = extraction.symbols(facts)
    # A symbol's chunk is the shortest of its name in its file.
    owner = chunks.where("symbol_name IS NOT NULL").groupBy(F.col("path").alias("p"), F.col("symbol_name").alias("s")).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "chunk_id"))["chunk_id"].alias("chunk"))
    named = symbols.select(F.col("path").alias("file"), "name", F.xxhash64("path", "name", "start_line").alias("symbol_id"))
    placed = named.join(owner, (F.col("file") == F.col("p")) & (F.col("name") == F.col("s"))).select("symbol_id", F.col("chunk").alias("dst"))
    calls = extraction.calls(facts).where("caller IS NOT NULL").select(F.col("path").alias("file"), F.col("target_name").alias("name"), "caller", "line")
    found = structured.resolved(calls, named).where("resolved IS NOT NULL")
    found = found.join(placed, F.col("resolved") == F.col("symbol_id"))
    callers = owner.select(F.col("p").alias("from_file"), F.col("s").alias("from_name"), F.col("chunk").alias("src"))
    found = found.join(callers, (F.col("file") == F.col("from_file")) & (F.col("caller") == F.col("from_name"))).where("src <> dst")
    found = found.groupBy("src", "dst").agg(F.min("line").cast("long").alias("ord"))
    there = found.select("src", "dst", F.lit(1).alias("kind"), "ord")
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(2).alias("kind"), "ord")
    return heads.unionByName(there).unionByName(back)


def vectors_of(chunks: DataFrame, dimensions: int = 32) -> DataFrame:
    """Hashed vectors of headers and contents; a chunk without words has none."""
    text = F.concat_ws("\n", "header", "content")
    return retrieval.hash_vectors(chunks.select(F.col("chunk_id").alias("id"), text.alias("text")), "id", dimensions)


def within_cap(chunks: DataFrame, most: int) -> None:
    """Refuse an index of more chunks than ``most``."""
    n = chunks.count()
    if n > most:
        raise ValueError(f"{n} chunks are more than {most}")
