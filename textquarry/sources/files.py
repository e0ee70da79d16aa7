"""Files as a DataFrame: reading a tree, filtering, languages, and the browsing operators over it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count, one_break, redact_secrets

# Names and endings by which files are left out.
SKIP_DIRS = ".git node_modules vendor dist build target .venv venv __pycache__ .next .nuxt coverage .mypy_cache .pytest_cache".split()
LOCKFILES = ["package-lock.json", "yarn.lock", "poetry.lock", "Cargo.lock", "go.sum"]
MINIFIED = [".min.js", ".min.css"]
GENERATED = ["_pb2.py", ".pb.go", ".g.dart"]
BINARY = "png jpg jpeg gif bmp ico svg webp avif pdf zip tar gz tgz 7z rar exe dll so dylib bin class jar pyc o a woff woff2 ttf eot otf mp3 mp4 mov avi wav flac db sqlite sqlite3".split()
MAX_BYTES, MAX_LINES, MAX_MEAN_LINE = 1 << 20, 5000, 200
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "md": "markdown", "markdown": "markdown"}
MANIFESTS = ["package.json", "pyproject.toml", "Pipfile", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile"]
TEST_FOLDERS = ["test", "tests", "__tests__", "spec"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, suffix(path))


def is_test_path(path: Column) -> Column:
    """A part of the path is a test folder's name or begins ``test_`` and has an ending, or the file's name says so."""
    named = F.exists(F.split(path, "/"), lambda p: p.isin(TEST_FOLDERS) | p.rlike(r"^test_.+\."))
    return named | base_name(path).rlike(r"(?:_test|\.test|\.spec)\.[^.]+$")


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(MANIFESTS) | base_name(path).rlike(r"^requirements.*\.txt$")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a pattern over paths, and whether it ignores or takes back.

    ``!`` takes back, a backslash makes the next character plain, classes in brackets may be negated by ``!`` or ``^``.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line if ignores else line[1:]
    below = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out = ""
    for part in re.findall(r"/\*\*/|^\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|.", line.lstrip("/")):
        if part[0] == "[" and len(part) > 1:
            out += "(?!/)" + re.sub(r"^\[[!^]", "[^", part).replace("&&", r"&\&")
        elif part[0] == "*":
            out += "[^/]*"
        else:
            out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}.get(part) or re.escape(part[-1])
    return ("^" if anchored else "(?:^|/)") + out + ("/" if below else "(?:/|$)"), ignores


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file leaves a path out: of all lines that match, the last one decides."""
    found = F.lit(False)
    for pattern, ignores in filter(None, map(ignore_pattern, lines)):
        found = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(found)
    return found


def skip_reason(path: Column, size: Column, content: Column | None = None, ignore: list[str] | None = None) -> Column:
    """Why a file is left out, the first reason that holds; null for files that stay.

    Without ``content`` only names and sizes count, so a reader can drop files before their bytes are read.
    """
    name, low = base_name(path), F.lower(path)
    reasons = [("gitignored", ignored(path, ignore or [])), ("lockfile", name.isin(LOCKFILES))]
    reasons.append(("minified", low.rlike("|".join(re.escape(x) + "$" for x in MINIFIED))))
    reasons.append(("generated", low.rlike("|".join(re.escape(x) + "$" for x in GENERATED) + r"|\.generated\.")))
    reasons += [("binary_ext", suffix(path).isin(BINARY)), ("empty", size == 0), ("too_large", size > MAX_BYTES)]
    if content is not None:
        text = one_break(content.cast("string"))
        lines = line_count(text)
        reasons += [("non_utf8", ~F.is_valid_utf8(content.cast("string"))), ("too_many_lines", lines > MAX_LINES)]
        # The mean is over what stands on the lines: breaks are no part of it.
        shown = F.length(F.replace(text, F.lit("\n"), F.lit("")))
        reasons.append(("avg_line_too_long", shown / F.greatest(lines, F.lit(1)) > MAX_MEAN_LINE))
    chosen = F.lit(None).cast("string")
    for label, holds in reversed(reasons):
        chosen = F.when(holds, F.lit(label)).otherwise(chosen)
    return chosen


def in_skipped_directory(path: Column, migrations: bool = False) -> Column:
    names = SKIP_DIRS + ([] if migrations else ["migrations"])
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, names)))


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)`` of a tree of files.  Names and sizes are judged before bytes are read; empty files are skipped.

    ``ignore`` are lines of an ignore file, by default those of the root's own.  A root that is no folder, or a tree whose files
    have more than ``max_bytes`` in all, is refused.
    """
    from .tree import TreeReader, register

    register(spark)
    options = {"ignore": "\n".join(ignore)} if ignore is not None else {}
    options |= {"max_bytes": str(max_bytes)} if max_bytes is not None else {}
    # Refused here, not when rows are asked for.
    reader = TreeReader(options | {"path": root})
    reader.partitions() if max_bytes is not None else reader.checked()
    files = spark.read.format("tree").options(**options).load(root)
    by_name = files.where("reason IS NOT NULL").select("path", "reason")
    read = files.where("reason IS NULL").withColumn("reason", skip_reason(F.col("path"), F.col("size"), F.col("content")))
    kept = read.where("reason IS NULL").select("path", F.col("content").cast("string").alias("text"))
    kept = kept.select("path", "text", detect_language(F.col("path")).alias("language"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), line_count(one_break(F.col("text"))).alias("loc"), is_test_path(F.col("path")).alias("is_test"))
    return kept, by_name.unionByName(read.where("reason IS NOT NULL").select("path", "reason"))


def source_parts(source: Column) -> Column:
    """``(owner, repo)`` of an address of a hosted repository, null for anything else."""
    clean = F.regexp_replace(F.trim(source), "/+$", "")
    ssh = r"^git@github\.com:([^/]+)/([^/?#]+?)(?:\.git)?$"
    web = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?(?:[/?#].*)?$"
    pattern = F.when(clean.rlike(ssh), F.struct(F.regexp_extract(clean, ssh, 1).alias("owner"), F.regexp_extract(clean, ssh, 2).alias("repo")))
    return pattern.when(clean.rlike(web), F.struct(F.regexp_extract(clean, web, 1).alias("owner"), F.regexp_extract(clean, web, 2).alias("repo")))


def glob_pattern(glob: str) -> str:
    """A shell pattern whose ``*`` crosses directories, with classes such as ``[ab]`` and ``[!ab]``."""
    out = ""
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", glob, re.S):
        if part[0] == "[" and len(part) > 1:
            out += re.sub(r"^\[!", "[^", part.replace("\\", r"\\")).replace("&&", r"&\&")
        else:
            out += {"*": ".*", "?": "."}.get(part) or re.escape(part)
    return rf"^(?s:{out})\z"


def find_files(files: DataFrame, glob: str, limit: int = 200) -> DataFrame:
    return files.where(F.col("path").rlike(glob_pattern(glob))).select("path").orderBy("path").limit(limit)


def list_directory(files: DataFrame, directory: str) -> DataFrame:
    """Immediate children ``(entry, kind)``: directories once, files by their path."""
    prefix = "" if directory in ("", ".") else directory.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    below = files.where(F.startswith(F.col("path"), F.lit(prefix))).select("path", rest.alias("rest"))
    nested = F.contains(F.col("rest"), F.lit("/"))
    return below.select(F.when(nested, F.split("rest", "/")[0]).otherwise(F.col("path")).alias("entry"), F.when(nested, F.lit("dir")).otherwise(F.lit("file")).alias("kind")).distinct()


def lines_of(files: DataFrame, *keys: str) -> DataFrame:
    """One row per line: the keys, ``line`` from 1, ``text``."""
    body = one_break(F.col("text"))
    return files.select(*keys, F.posexplode(F.split(F.regexp_replace(body, "\n$", ""), "\n", -1)).alias("at", "text")).select(*keys, (F.col("at") + 1).cast("long").alias("line"), "text")


def line_pattern(spark: SparkSession, pattern: str) -> str:
    """A pattern as Spark's own engine takes it: Python's named groups are respelled, and one that does not compile
    there is taken literally."""
    respelled = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)
    respelled = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", respelled)
    try:
        spark.range(1).select(F.lit("").rlike(respelled)).collect()
    except Exception:  # whatever the engine says of a pattern, it cannot be run
        return re.escape(pattern)
    return respelled


def grep(files: DataFrame, pattern: str, limit: int = 50, glob: str | None = None, redact: Callable[[Column], Column] | None = redact_secrets) -> DataFrame:
    """First matching lines in the order of paths, at most 50.  Each line is searched by itself, so ``^`` and ``$``
    are its ends; a pattern that does not compile is taken literally; secrets in what is shown are redacted."""
    pattern = line_pattern(files.sparkSession, pattern)
    chosen = files if glob is None else files.where(F.col("path").rlike(glob_pattern(glob)))
    found = lines_of(chosen, "path").where(F.col("text").rlike(pattern))
    found = found.select("path", "line", F.substring(F.trim("text"), 1, 200).alias("text")).orderBy("path", "line").limit(min(limit, 50))
    return found if redact is None else found.withColumn("text", redact(F.col("text")))


def read_slices(files: DataFrame, requests: DataFrame, most: int = 400, redact: Callable[[Column], Column] | None = redact_secrets) -> DataFrame:
    """For ``requests(path, start, end)`` the lines asked for, clamped to the file and to ``most`` lines, redacted."""
    rows = requests.join(files.select("path", F.split(F.regexp_replace(one_break(F.col("text")), "\n$", ""), "\n", -1).alias("all")), "path", "left")
    total = F.size("all")
    first = F.greatest(F.lit(1), F.least(F.col("start"), total))
    last = F.greatest(first, F.least(total, F.col("end"), first + (most - 1)))
    reason = F.when(F.col("all").isNull(), "not_found").when(F.col("start") > total, "start_beyond_end")
    rows = rows.withColumn("reason", reason).withColumn("first", first.cast("int")).withColumn("last", last.cast("int"))
    cut = F.when(F.col("reason").isNull(), F.expr("slice(`all`, first, last - first + 1)"))
    return rows.select("path", "start", "end", "reason", "first", F.posexplode_outer(cut).alias("at", "text")).select("path", "start", "end", "reason", (F.col("first") + F.col("at")).cast("long").alias("line"), (F.col("text") if redact is None else redact(F.col("text"))).alias("text"))


def spread(files: DataFrame) -> DataFrame:
    """Files dealt by path over all tasks: texts that are made from a small table lie in few partitions, and parsing them is the work."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def safe_path(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` folded; null if it is absolute or leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("kept"), F.lit(True).alias("inside"))
    up = lambda s: F.struct(F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["inside"] & (F.size(s["kept"]) > 0)).alias("inside"))
    down = lambda s, p: F.struct(F.array_append(s["kept"], p).alias("kept"), s["inside"].alias("inside"))
    done = F.aggregate(parts, start, lambda s, p: F.when(p == "..", up(s)).otherwise(down(s, p)))
    return F.when(~F.startswith(path, F.lit("/")) & done["inside"], F.array_join(done["kept"], "/"))
