"""Facts in files: imports, dependencies, endpoints, and the structure of Python sources.

Line formats, JSON and XML are read by native expressions.  Python's grammar takes a small helper inside
Arrow batches that emits all facts of a file in one parse.  Inputs are ``files(path, text)``.
"""

from __future__ import annotations

import ast
import tomllib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import controller_route, join_route, one_break, pep508_name, pep508_version, redact_secrets
from ..sources.files import base_name, detect_language, lines_of, safe_path, spread
from ..sources.yaml_files import yaml_as_json
from .spring import spring_routes

# How languages spell imports, one line at a time.
IMPORTS = {
    "python": r"^(?:from\s+(\S+)\s+import|import\s+(\S+))",
    "javascript": r"""from\s+["'](\S+?)["']|require\(\s*["'](\S+?)["']\s*\)""",
    "typescript": r"""from\s+["'](\S+?)["']|require\(\s*["'](\S+?)["']\s*\)""",
    "tsx": r"""from\s+["'](\S+?)["']|require\(\s*["'](\S+?)["']\s*\)""",
    "go": r'^\s*(?:import\s+)?"([\w./-]+)"\s*$',
    "java": r"^import\s+(?:static\s+)?([\w.]+);",
    "rust": r"^use\s+([\w:]+)",
    "ruby": r"""require(?:_relative)?\s*["'](\S+?)["']""",
}

# How routes and dependencies are spelled, and what Rails makes of a resource.
RAILS_VERB = r"""^\s*(get|post|put|patch|delete)\s+['"]([^'"]+)['"](?:.*?to:\s*['"]([^'"]+)['"])?"""
RAILS_RESOURCES = r"^\s*(resources?)\s+:(\w+)"
PLURAL = [("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy")]
SINGULAR = [("GET", "/new", "new"), ("POST", "", "create"), ("GET", "", "show"), ("GET", "/edit", "edit"), ("PATCH", "", "update"), ("DELETE", "", "destroy")]
HTTP_METHODS = "get post put patch delete options head trace".split()
ROUTE_METHODS = "GET POST PUT DELETE PATCH OPTIONS HEAD".split()
GRADLE = r"""(implementation|api|compile|testImplementation|testCompile|runtimeOnly|compileOnly)\s+['"]([\w.\-]+):([\w.\-]+):([\w.\-]+)['"]"""
GEM = r"""gem\s+['"]([\w.\-]+)['"](?:\s*,\s*['"]([^'"]+)['"])?"""
GEM_DEV = r"group:\s*:?(?:dev|development|test)|:test"
NPM_SECTIONS = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}

DEPENDENCY = ["path", "ecosystem", "name", "version", "kind"]
ENDPOINT = ["path", "framework", "method", "route", "handler", "line", "auth"]


def _groups(text: Column, pattern: str, *groups: int) -> Column:
    """All matches of a pattern as structs of their groups ``g1``, ``g2`` ..."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def import_edges(files: DataFrame) -> DataFrame:
    """``path, line, module``: every import of every file in a language that is known."""
    rows = lines_of(files.withColumn("language", detect_language(F.col("path"))).where(F.col("language").isin(list(IMPORTS))), "path", "language")
    found = F.array().cast("array<struct<g1:string,g2:string>>")
    for language, pattern in IMPORTS.items():
        two = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if pattern.count("(\\S+") == 2 else F.array().cast("array<string>")
        parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("g1"), two.alias("g2"))
        found = F.when(F.col("language") == language, parts).otherwise(found)
    return rows.select("path", "line", F.explode(found).alias("m")).select("path", "line", F.coalesce(_given(F.col("m.g1")), F.col("m.g2")).alias("module"))


def import_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``path, line, module, target``: the file an import means, null where it is none of these files."""
    python, dots = F.col("path").rlike(r"\.py$"), F.replace(F.col("module"), F.lit("."), F.lit("/"))
    # ``safe_path`` folds any number of levels; what leaves the root is none of these files.
    beside = safe_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("module")))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    none = F.array().cast("array<string>")
    guesses = F.when(python & ~F.startswith("module", F.lit(".")), F.array(F.concat(dots, F.lit(".py")), F.concat(dots, F.lit("/__init__.py"))))
    guesses = guesses.when(~python & F.startswith("module", F.lit(".")) & beside.isNotNull(), F.array(*[F.concat(beside, F.lit(e)) for e in ends])).otherwise(none)
    rows = edges.select("path", "line", "module", F.posexplode_outer(guesses).alias("order", "guess"))
    known = files.select(F.col("path").alias("target"))
    rows = rows.join(known, F.col("guess") == F.col("target"), "left")
    return rows.groupBy("path", "line", "module").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("order"))).alias("target"))


def npm_dependencies(files: DataFrame) -> DataFrame:
    rows = files.where(base_name(F.col("path")) == "package.json")
    kinds = [F.struct(F.lit(k).alias("kind"), F.from_json(F.get_json_object("text", f"$.{s}"), "map<string,string>").alias("m")) for s, k in NPM_SECTIONS.items()]
    rows = rows.select("path", F.explode(F.array(*kinds)).alias("k")).select("path", "k.kind", F.explode("k.m").alias("name", "version"))
    return rows.select("path", F.lit("npm").alias("ecosystem"), "name", "version", "kind")


def requirements(files: DataFrame) -> DataFrame:
    rows = lines_of(files.where(base_name(F.col("path")).rlike(r"^requirements.*\.txt$")), "path")
    spec = F.trim(F.split("text", "#")[0])
    rows = rows.withColumn("spec", spec).where("spec <> ''").where(~F.startswith("spec", F.lit("-")) & (pep508_name(F.col("spec")) != ""))
    kind = F.when(F.lower(base_name(F.col("path"))).rlike("dev|test"), "dev").otherwise("runtime")
    return rows.select("path", F.lit("pypi").alias("ecosystem"), pep508_name(F.col("spec")).alias("name"), pep508_version(F.col("spec")).alias("version"), kind.alias("kind"))


def go_dependencies(files: DataFrame) -> DataFrame:
    """Single lines, and blocks: a line's block state follows from the markers before it in its file."""
    text = one_break(F.col("text"))
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require\s*\(\s*$([\s\S]*?)^\s*\)\s*$"), F.lit(1))
    singles = F.regexp_extract_all(text, F.lit(r"(?m)^\s*require\s+([^(\s].*)$"), F.lit(1))
    rows = files.where(base_name(F.col("path")) == "go.mod").select("path", F.explode(F.concat(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), singles)).alias("text"))
    name, version = (F.regexp_extract("text", r"^\s*(\S+)\s+(v\S+)", i) for i in (1, 2))
    kind = F.when(F.contains("text", F.lit("// indirect")), "optional").otherwise("runtime")
    return rows.where(name != "").select("path", F.lit("go").alias("ecosystem"), name.alias("name"), version.alias("version"), kind.alias("kind"))


def gradle_dependencies(files: DataFrame) -> DataFrame:
    rows = files.where(base_name(F.col("path")).isin("build.gradle", "build.gradle.kts")).select("path", F.explode(_groups(F.col("text"), GRADLE, 1, 2, 3, 4)).alias("m"))
    kind = F.when(F.contains(F.lower("m.g1"), F.lit("test")), "dev").otherwise("runtime")
    return rows.select("path", F.lit("maven").alias("ecosystem"), F.concat_ws(":", "m.g2", "m.g3").alias("name"), F.col("m.g4").alias("version"), kind.alias("kind"))


def gem_dependencies(files: DataFrame) -> DataFrame:
    rows = lines_of(files.where(base_name(F.col("path")) == "Gemfile"), "path").where(F.col("text").rlike(GEM))
    kind = F.when(F.col("text").rlike(GEM_DEV), "dev").otherwise("runtime")
    return rows.select("path", F.lit("rubygems").alias("ecosystem"), F.regexp_extract("text", GEM, 1).alias("name"), _given(F.regexp_extract("text", GEM, 2)).alias("version"), kind.alias("kind"))


def maven_dependencies(files: DataFrame) -> DataFrame:
    """Each ``dependency`` element; namespaces do not matter."""
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    rows = files.where(base_name(F.col("path")) == "pom.xml").select("path", F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    field = lambda f: _given(F.trim(F.regexp_extract("d", rf"(?s)<{f}>\s*(.*?)\s*</{f}>", 1)))
    kind = F.when(field("scope") == "test", "dev").otherwise("runtime")
    return rows.where(field("artifactId").isNotNull()).select("path", F.lit("maven").alias("ecosystem"), F.concat_ws(":", field("groupId"), field("artifactId")).alias("name"), field("version").alias("version"), kind.alias("kind"))


def _version(value: object) -> str | None:
    """A TOML dependency's version: the text itself, or that of a table."""
    return value if isinstance(value, str) else value.get("version") if isinstance(value, dict) else None


def _toml_specs(name: str, data: dict) -> Iterator[tuple[str, str, str | None, str]]:
    """``ecosystem, name or spec, version, kind``; a Python spec still holds its version."""
    if name == "Cargo.toml":
        for section, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "dev")):
            yield from (("cargo", n, _version(v), kind) for n, v in (data.get(section) or {}).items())
    elif name == "Pipfile":
        for section, kind in (("packages", "runtime"), ("dev-packages", "dev")):
            yield from (("pypi", n, _version(v), kind) for n, v in (data.get(section) or {}).items())
    else:
        project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
        yield from (("spec", s, None, "runtime") for s in project.get("dependencies") or [])
        for group, specs in (project.get("optional-dependencies") or {}).items():
            yield from (("spec", s, None, "dev" if group in ("dev", "test", "tests") else "optional") for s in specs)
        tables = [(poetry.get("dependencies"), "runtime"), (poetry.get("dev-dependencies"), "dev"), *((g.get("dependencies"), "dev") for g in (poetry.get("group") or {}).values())]
        yield from (("pypi", n, _version(v), kind) for table, kind in tables for n, v in (table or {}).items() if n != "python")


def toml_dependencies(files: DataFrame) -> DataFrame:
    """``pyproject.toml``, ``Pipfile`` and ``Cargo.toml``; a file that does not parse has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *spec) for spec in _toml_specs(path.rsplit("/", 1)[-1], tomllib.loads(text))]
                except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 5)], DEPENDENCY)

    rows = files.where(base_name(F.col("path")).isin("pyproject.toml", "Pipfile", "Cargo.toml")).select("path", "text")
    rows = rows.mapInArrow(run, ", ".join(f"{c} string" for c in DEPENDENCY))
    spec = F.col("ecosystem") == "spec"
    return rows.select("path", F.when(spec, "pypi").otherwise(F.col("ecosystem")).alias("ecosystem"), F.when(spec, pep508_name(F.col("name"))).otherwise(F.col("name")).alias("name"), F.when(spec, pep508_version(F.col("name"))).otherwise(F.col("version")).alias("version"), "kind")


def dependencies(files: DataFrame) -> DataFrame:
    found = npm_dependencies(files)
    for part in (requirements, go_dependencies, gradle_dependencies, gem_dependencies, maven_dependencies, toml_dependencies):
        found = found.unionByName(part(files))
    return found


def _endpoints(rows: DataFrame, framework: str, method: Column, route: Column, handler: Column, line: Column, auth: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("path", F.lit(framework).alias("framework"), method.alias("method"), route.alias("route"), handler.alias("handler"), line.cast("long").alias("line"), (none if auth is None else auth).alias("auth"))


def rails_endpoints(files: DataFrame) -> DataFrame:
    rows = lines_of(files.where(base_name(F.col("path")) == "routes.rb"), "path")
    verbs = rows.where(F.col("text").rlike(RAILS_VERB))
    part = lambda i: F.regexp_extract("text", RAILS_VERB, i)
    single = _endpoints(verbs, "rails", F.upper(part(1)), F.concat(F.lit("/"), F.regexp_replace(part(2), "^/+", "")), _given(part(3)), F.col("line"))
    table = lambda actions: F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(a).alias("a")) for m, s, a in actions])
    named = rows.where(F.col("text").rlike(RAILS_RESOURCES) & ~F.col("text").rlike(RAILS_VERB))
    named = named.withColumn("name", F.regexp_extract("text", RAILS_RESOURCES, 2))
    actions = F.when(F.regexp_extract("text", RAILS_RESOURCES, 1) == "resources", table(PLURAL)).otherwise(table(SINGULAR))
    named = named.withColumn("x", F.explode(actions))
    return single.unionByName(_endpoints(named, "rails", F.col("x.m"), F.concat(F.lit("/"), "name", "x.s"), F.concat_ws("#", "name", "x.a"), F.col("line")))


def next_endpoints(files: DataFrame) -> DataFrame:
    pages = files.where(F.contains(F.concat(F.lit("/"), "path"), F.lit("/pages/api/")))
    route = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^.*?pages", ""), r"\.[^.]*$", ""), "/index$", "")
    none = F.lit(None).cast("string")
    first = _endpoints(pages, "nextjs", none, route, none, F.lit(1))
    app = files.where(F.col("path").rlike(r"(?:^|/)app/.*/route\.(?:ts|js|tsx|jsx)$") & ~F.contains(F.concat(F.lit("/"), "path"), F.lit("/pages/api/")))
    route = F.regexp_replace(F.regexp_replace("path", "^.*?app", ""), r"/route\.[^/]*$", "")
    exported = r"^export\s+(?:(?:async\s+)?function\s+(\w+)|const\s+(\w+)\s*=)"
    lines = lines_of(app, "path").withColumn("name", F.coalesce(_given(F.regexp_extract("text", exported, 1)), F.regexp_extract("text", exported, 2))).where(F.col("name").isin(ROUTE_METHODS))
    named = _endpoints(lines, "nextjs", F.col("name"), route, F.col("name"), F.col("line"))
    bare = app.join(lines.select("path").distinct(), "path", "left_anti")
    return first.unionByName(named).unionByName(_endpoints(bare, "nextjs", none, route, none, F.lit(1)))


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """OpenAPI and Swagger files in JSON and in YAML, which is first put as JSON; what does not parse has none."""
    json = files.where(base_name(F.col("path")).rlike(r"^(?:openapi|swagger)\.json$")).select("path", "text")
    rows = json.unionByName(yaml_as_json(files.where(base_name(F.col("path")).rlike(r"^(?:openapi|swagger)\.ya?ml$"))))
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,string>>")
    rows = rows.select("path", F.explode(paths).alias("route", "item")).select("path", "route", F.explode("item").alias("method", "op")).where(F.lower("method").isin(HTTP_METHODS) & F.startswith(F.trim("op"), F.lit("{")))
    secured = F.coalesce(F.get_json_object("op", "$.security"), F.lit("[]")) != "[]"
    return _endpoints(rows, "openapi", F.upper("method"), F.col("route"), F.get_json_object("op", "$.operationId"), F.lit(1), F.when(secured, F.lit("auth")))


def express_endpoints(files: DataFrame) -> DataFrame:
    """``app.get('/x', [middleware ...,] handler)`` over any number of lines; ``all`` has no method.

    A text is cut where such a call begins.  Of each piece the arguments are read up to the first function written
    in place or the closing parenthesis of the call: the last name is the handler, one that holds ``auth`` the guard.
    """
    head = r"""\b\w+\.(get|post|put|patch|delete|options|head|all)\(\s*(['"`])(/[^'"`]*)\2\s*,\s*"""
    cut = "(?=" + head.replace("(get|", "(?:get|").replace("""(['"`])(/[^'"`]*)\\2""", """['"`]/[^'"`]*['"`]""") + ")"
    rows = files.where(detect_language(F.col("path")).isin("javascript", "typescript", "tsx"))
    rows = rows.select("path", F.posexplode(F.split(one_break(F.col("text")), cut, -1)).alias("at", "piece"))
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    before = F.sum(breaks).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("line", F.coalesce(before, F.lit(0)) + 1).where(F.col("piece").rlike("^" + head))
    part = lambda i: F.regexp_extract("piece", "^" + head, i)
    # Arguments up to a function in place, or to the parenthesis that ends the statement.
    args = F.regexp_extract("piece", r"(?s)^" + head + r"(.*?)(?:(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>|\bfunction\b|\)\s*(?:;|\n|$))", 4)
    named = F.regexp_extract_all(F.regexp_replace(args, r"\([^()]*\)", ""), F.lit(r"([A-Za-z_$][\w$.]*)"), F.lit(1))
    in_place = F.col("piece").rlike(r"(?s)^" + head + r"[^;]*?(?:=>|\bfunction\b)") & ~args.rlike(r"^\s*[\w$.]+\s*$")
    method = F.when(part(1) == "all", F.lit(None)).otherwise(F.upper(part(1)))
    handler = F.when(~in_place & (F.size(named) > 0), F.element_at(named, -1))
    auth = _given(F.regexp_extract(args, r"(?i)\b(\w*auth\w*)\b", 1))
    return _endpoints(rows, "express", method, part(3), handler, F.col("line"), auth)


def _annotated(files: DataFrame, languages: list[str], framework: str, prefix: str, verb: str, guard: str, handler: str, slash: bool) -> DataFrame:
    """Routes by annotations: a controller's prefix holds for the methods of its class.

    A block of lines ends with a method's own line or that of a class, so what a block holds before it are the
    annotations of that method alone; those of a class are not those of its first method.
    """
    rows = lines_of(files.where(detect_language(F.col("path")).isin(languages)), "path")
    upto = Window.partitionBy("path").orderBy("line")
    is_class = F.col("text").rlike(r"^(?!\s*(?://|\*|/\*)).*\bclass\s+\w+")
    ends = F.col("text").rlike(handler) | is_class
    rows = rows.withColumn("block", F.coalesce(F.sum(ends.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    block = Window.partitionBy("path", "block")
    given = F.max(F.when(F.col("text").rlike(prefix), F.regexp_extract("text", prefix, 1))).over(block)
    rows = rows.withColumn("given", F.when(is_class, F.struct(given.alias("prefix"))))
    rows = rows.withColumn("prefix", F.last("given", ignorenulls=True).over(upto)["prefix"])
    rows = rows.withColumn("handler", F.max(F.when(F.col("text").rlike(handler), F.regexp_extract("text", handler, 1))).over(block))
    rows = rows.withColumn("auth", F.max(F.when(F.col("text").rlike(guard), F.lit("auth"))).over(block))
    found = rows.where(F.col("text").rlike(verb) & F.col("prefix").isNotNull() & F.col("handler").isNotNull())
    name = F.upper(F.regexp_extract("text", verb, 1))
    route = controller_route(F.col("prefix"), F.regexp_extract("text", verb, 2), slash)
    return _endpoints(found, framework, F.when(~name.isin("ALL", "REQUEST"), name), route, F.col("handler"), F.col("line"), F.col("auth"))


def nest_endpoints(files: DataFrame) -> DataFrame:
    """A method without a path of its own is at the controller's prefix and a slash."""
    quoted = r"""\(\s*(?:['"`]([^'"`]*)['"`])?"""
    method = r"^\s*(?:@\w+\([^()]*\)\s+)*(?:public\s+|private\s+|protected\s+)?(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|super\b)(\w+)\s*\("
    return _annotated(files, ["typescript", "tsx"], "nestjs", "@Controller" + quoted, "@(Get|Post|Put|Patch|Delete|Options|Head|All)" + quoted, r"@(UseGuards|Auth)\b", method, slash=True)


def spring_endpoints(files: DataFrame) -> DataFrame:
    """A method without a path of its own is at the controller's prefix."""
    rows = spring_routes(files)
    return _endpoints(rows, "spring", F.col("method"), F.col("route"), F.col("handler"), F.col("line"), F.when(F.col("guarded"), "auth"))


#: Columns of facts: what a symbol's, a call's and an endpoint's rows hold.
FACTS = {"path": "string", "fact": "string", "kind": "string", "name": "string", "parent": "string", "start": "long", "end": "long", "extra": "string", "flag": "boolean", "doc": "string"}
FACT_TYPES = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.bool_(), pa.string()]
VERBS = {"get", "post", "put", "patch", "delete", "options", "head"}


#: Facts that a Python worker holds at most before it hands them on.
HELD_FACTS = 4096


def fact_batches(facts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Facts as batches of bounded length, whatever number of files they come from."""
    while rows := list(islice(facts, HELD_FACTS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FACT_TYPES)], list(FACTS))


def facts_of_python(text: str) -> Iterator[tuple]:
    """``fact, kind, name, parent, start, end, extra, exported, docstring`` of one source: symbols, calls, endpoints, and the
    statements that make up a function's body."""
    tree = ast.parse(text)
    source = text.split("\n")
    prefixes: dict[str, str] = {}
    literal = lambda node: node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None
    named = lambda node: node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None
    keyword = lambda call, name: next((k.value for k in call.keywords if k.arg == name), None)
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and named(node.value.func) in ("FastAPI", "APIRouter", "Flask", "Blueprint"):
            prefix = literal(keyword(node.value, "prefix")) or literal(keyword(node.value, "url_prefix")) or ""
            prefixes |= {t.id: prefix for t in node.targets if isinstance(t, ast.Name)}

    def walk(node: ast.AST, parent: str | None, inside: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            scope = inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and inside is None:
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                yield ("symbol", kind, child.name, parent, start, child.end_lineno, source[child.lineno - 1].strip(), not child.name.startswith("_"), ast.get_docstring(child))
                yield from routes(child)
                if kind == "class":
                    yield from walk(child, child.name, None)
                    continue
                for part in child.body:
                    yield ("statement", None, child.name, parent, part.lineno, part.end_lineno, None, None, None)
                scope = child.name
            if isinstance(child, ast.Call) and named(child.func):
                yield ("call", None, named(child.func), inside, child.lineno, child.end_lineno, None, None, None)
                first = literal(child.args[0]) if child.args else None
                if named(child.func) in ("path", "re_path", "url") and first is not None:
                    view = named(child.args[1]) if len(child.args) > 1 else None
                    yield ("endpoint", "django", view, None, child.lineno, child.lineno, "/" + first.lstrip("/").lstrip("^").rstrip("$"), None, None)
            yield from walk(child, parent, scope)

    def routes(function: ast.AST) -> Iterator[tuple]:
        for d in function.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in prefixes and d.args):
                continue
            path, prefix = literal(d.args[0]), prefixes[d.func.value.id]
            if path is None:
                continue
            listed = keyword(d, "methods")
            methods = [literal(e) for e in listed.elts] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
            for method in methods if d.func.attr == "route" else [d.func.attr] if d.func.attr in VERBS else []:
                yield ("endpoint", (method or "").upper(), function.name, prefix, d.lineno, d.lineno, path, keyword(d, "dependencies") is not None, None)

    yield from walk(tree, None, None)


def python_facts(files: DataFrame) -> DataFrame:
    """All facts of Python sources in one parse; a source that does not parse has none."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, text in zip(*batch.columns):
                try:
                    own = list(facts_of_python(text.as_py()))  # before any is handed on: a file has all or none
                except (SyntaxError, ValueError, RecursionError):
                    continue
                yield from ((path.as_py(), *fact) for fact in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fact_batches(found(batches))

    rows = files.where(detect_language(F.col("path")) == "python").select("path", F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInArrow(run, ", ".join(f"`{name}` {type_}" for name, type_ in FACTS.items()))


def symbols(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'symbol'").select("path", "name", "kind", F.col("parent").alias("parent_symbol"), F.col("extra").alias("signature"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("flag").alias("is_exported"), redact_secrets(F.col("doc")).alias("docstring"))


def calls(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'call'").select("path", F.col("name").alias("target_name"), F.col("parent").alias("caller"), F.col("start").alias("line"))


def python_endpoints(facts: DataFrame) -> DataFrame:
    rows = facts.where("fact = 'endpoint'")
    django = F.col("kind") == "django"
    framework = F.when(django, "django").otherwise("fastapi/flask")
    route = F.when(django, F.col("extra")).otherwise(join_route(F.col("parent"), F.col("extra")))
    return rows.select("path", framework.alias("framework"), F.when(~django, F.col("kind")).alias("method"), route.alias("route"), F.col("name").alias("handler"), F.col("start").alias("line"), F.when(F.col("flag"), F.lit("auth")).alias("auth"))


def endpoints(files: DataFrame) -> DataFrame:
    found = python_endpoints(python_facts(files))
    for part in (rails_endpoints, next_endpoints, openapi_endpoints, express_endpoints, nest_endpoints, spring_endpoints):
        found = found.unionByName(part(files))
    return found
