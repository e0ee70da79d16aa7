"""Queries that read facts out of files which Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import code_chunks as cc
from ..operators import extraction as ex
from ..operators import source_facts as sf
from ..sources.files import spread
from .catalogue import Tables, sql_of
from .catalogue import query as registered

#: Parts by the file that they go to: one for each brand and fifty keys, so files grow in number, not in length.
FILES = "(SELECT * REPLACE (concat(p_brand, '/f', p_partkey // 50) AS p_brand) FROM part)"


def query(sql: str):
    return registered(sql.replace("FROM part", f"FROM {FILES}"))


def _parts(t: Tables) -> DataFrame:
    return t.part.withColumn("p_brand", F.concat("p_brand", F.lit("/f"), F.floor(F.col("p_partkey") / 50).cast("string")))


def _joined(rows: DataFrame, key: str, line: Column, order: str) -> DataFrame:
    """One text per key from a line per row, in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key).agg(lines.alias("text"))


@query("""SELECT concat(p_brand, '/requirements', CASE WHEN p_brand LIKE '%5' THEN '-dev' ELSE '' END, '.txt') AS path, 'pypi' AS ecosystem, concat('part-', p_partkey) AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('==', p_size, '.0') END AS version,
CASE WHEN p_brand LIKE '%5' THEN 'dev' ELSE 'runtime' END AS kind FROM part""")
def dependencies_requirements(t: Tables) -> DataFrame:
    spec = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("=="), F.col("p_size").cast("string"), F.lit(".0"))), F.lit("  # "), "p_type")
    files = _joined(_parts(t), "p_brand", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("-r other.txt\n# note\n"), spec)).otherwise(spec), "p_partkey")
    dev = F.when(F.endswith("p_brand", F.lit("5")), "-dev").otherwise("")
    return ex.requirements(files.select(F.concat("p_brand", F.lit("/requirements"), dev, F.lit(".txt")).alias("path"), "text"))


@query("""SELECT concat(p_brand, '/package.json') AS path, 'npm' AS ecosystem, concat('part-', p_partkey) AS name, concat('^', p_size, '.0') AS version, CASE p_partkey % 4 WHEN 0 THEN 'runtime' WHEN 1 THEN 'dev' WHEN 2 THEN 'peer' ELSE 'optional' END AS kind FROM part""")
def dependencies_npm(t: Tables) -> DataFrame:
    sections = list(ex.NPM_SECTIONS)
    item = F.struct(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("^"), F.col("p_size").cast("string"), F.lit(".0")).alias("version"))
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("p_partkey") % 4 == i, item))).alias(s) for i, s in enumerate(sections)]
    return ex.npm_dependencies(_parts(t).groupBy("p_brand").agg(*maps).select(F.concat("p_brand", F.lit("/package.json")).alias("path"), F.to_json(F.struct(*sections)).alias("text")))


@query("""SELECT concat(p_brand, '/go.mod') AS path, 'go' AS ecosystem, concat('example.com/p', p_partkey) AS name, concat('v1.', p_size, '.0') AS version, CASE WHEN p_partkey % 3 = 0 THEN 'optional' ELSE 'runtime' END AS kind FROM part""")
def dependencies_go(t: Tables) -> DataFrame:
    """Every other brand lists its parts in one block, the rest line by line."""
    block = F.substring("p_brand", -1, 1).isin("1", "3", "5")
    spec = F.concat(F.lit("example.com/p"), F.col("p_partkey").cast("string"), F.lit(" v1."), F.col("p_size").cast("string"), F.lit(".0"), F.when(F.col("p_partkey") % 3 == 0, " // indirect").otherwise(""))
    files = _joined(_parts(t), "p_brand", F.when(block, F.concat(F.lit("\t"), spec)).otherwise(F.concat(F.lit("require "), spec)), "p_partkey")
    text = F.when(block, F.concat(F.lit("module x\nrequire (\n"), "text", F.lit("\n)\n"))).otherwise(F.concat(F.lit("module x\n"), "text"))
    return ex.go_dependencies(files.select(F.concat("p_brand", F.lit("/go.mod")).alias("path"), text.alias("text")))


@query("""SELECT concat(p_brand, '/Cargo.toml') AS path, 'cargo' AS ecosystem, concat('part', p_partkey) AS name, CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, '.1') ELSE NULL END AS version, 'runtime' AS kind FROM part
UNION ALL SELECT concat(p_brand, '/pyproject.toml'), 'pypi', concat('part', p_partkey), CONCAT('>=', p_size), 'runtime' FROM part""")
def dependencies_toml(t: Tables) -> DataFrame:
    name, size = F.concat(F.lit("part"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string")
    cargo = _joined(_parts(t), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(name, F.lit(' = "'), size, F.lit('.1"'))).otherwise(F.concat(name, F.lit(' = { path = "x" }'))), "p_partkey")
    cargo = cargo.select(F.concat("p_brand", F.lit("/Cargo.toml")).alias("path"), F.concat(F.lit("[dependencies]\n"), "text").alias("text"))
    project = _joined(_parts(t), "p_brand", F.concat(F.lit('  "'), name, F.lit(" >="), size, F.lit('",')), "p_partkey")
    project = project.select(F.concat("p_brand", F.lit("/pyproject.toml")).alias("path"), F.concat(F.lit("[project]\ndependencies = [\n"), "text", F.lit("\n]\n")).alias("text"))
    return ex.toml_dependencies(cargo.unionByName(project))


@query("""
WITH n AS (SELECT p_partkey AS k, concat('m', p_partkey) AS name, concat(p_brand, '/routes.rb') AS path FROM part),
a AS (SELECT * FROM (VALUES ('GET', '', 'index'), ('GET', '/new', 'new'), ('POST', '', 'create'), ('GET', '/:id', 'show'), ('GET', '/:id/edit', 'edit'), ('PATCH', '/:id', 'update'), ('DELETE', '/:id', 'destroy')) v(m, s, a)),
b AS (SELECT * FROM (VALUES ('GET', '/new', 'new'), ('POST', '', 'create'), ('GET', '', 'show'), ('GET', '/edit', 'edit'), ('PATCH', '', 'update'), ('DELETE', '', 'destroy')) v(m, s, a))
SELECT path, m AS method, concat('/', name, s) AS route, concat(name, '#', a) AS handler FROM n, a WHERE k % 3 = 0
UNION ALL SELECT path, m, concat('/', name, s), concat(name, '#', a) FROM n, b WHERE k % 3 = 1
UNION ALL SELECT path, 'POST', concat('/x/', name), concat(name, '#go') FROM n WHERE k % 3 = 2""")
def rails_routes(t: Tables) -> DataFrame:
    name, kind = F.concat(F.lit("m"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 3
    verb = F.concat(F.lit("  post '/x/"), name, F.lit("', to: '"), name, F.lit("#go'"))
    line = F.when(kind == 0, F.concat(F.lit("  resources :"), name)).when(kind == 1, F.concat(F.lit("  resource :"), name)).otherwise(verb)
    files = _joined(_parts(t), "p_brand", line, "p_partkey").select(F.concat("p_brand", F.lit("/routes.rb")).alias("path"), "text")
    return ex.rails_endpoints(files).select("path", "method", "route", "handler")


@query("""
WITH s AS (SELECT s_suppkey AS k, concat('/s', s_suppkey) AS name FROM supplier)
SELECT concat('web/pages/api', name, '/index.ts') AS path, CAST(NULL AS VARCHAR) AS method, concat('/api', name) AS route, 1 AS line FROM s WHERE k % 3 = 0
UNION ALL SELECT concat('web/app', name, '/route.ts'), unnest(['GET', 'POST']), name, unnest([2, 3]) FROM s WHERE k % 3 = 1 UNION ALL SELECT concat('web/app', name, '/route.js'), NULL, name, 1 FROM s WHERE k % 3 = 2""")
def next_routes(t: Tables) -> DataFrame:
    k, name = F.col("s_suppkey") % 3, F.concat(F.lit("/s"), F.col("s_suppkey").cast("string"))
    path = F.when(k == 0, F.concat(F.lit("web/pages/api"), name, F.lit("/index.ts"))).when(k == 1, F.concat(F.lit("web/app"), name, F.lit("/route.ts"))).otherwise(F.concat(F.lit("web/app"), name, F.lit("/route.js")))
    text = F.when(k == 1, F.lit("import x\nexport async function GET(r) {}\nexport const POST = go\nexport function helper() {}")).otherwise(F.lit("const x = 1"))
    return ex.next_endpoints(t.supplier.select(path.alias("path"), text.alias("text"))).select("path", "method", "route", "line")


@query("""SELECT concat(p_brand, '/openapi.json') AS path, 'GET' AS method, concat('/', p_partkey, '/{id}') AS route, concat('get', p_partkey) AS handler, CASE WHEN p_partkey % 2 = 0 THEN 'auth' END AS auth FROM part""")
def openapi_routes(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    security = F.when(F.col("p_partkey") % 2 == 0, F.array(F.create_map(F.lit("key"), F.array().cast("array<string>"))))
    op = F.struct(F.concat(F.lit("get"), key).alias("operationId"), security.alias("security"))
    item = F.struct(F.concat(F.lit("/"), key, F.lit("/{id}")).alias("route"), F.struct(op.alias("get"), F.lit("text").alias("summary")).alias("item"))
    files = _parts(t).groupBy("p_brand").agg(F.to_json(F.struct(F.lit("3.0.0").alias("openapi"), F.map_from_entries(F.collect_list(item)).alias("paths"))).alias("text"))
    return ex.openapi_endpoints(files.select(F.concat("p_brand", F.lit("/openapi.json")).alias("path"), "text")).select("path", "method", "route", "handler", "auth")


def _python(t: Tables) -> DataFrame:
    """A module per brand: an application, and for each part a route, a class with a method, a call."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("@app.get('/p"), k, F.lit("/{i}')\ndef get_"), k, F.lit("(i):\n    return make_"), k, F.lit("(i)\n\nclass Part"), k, F.lit(":\n    def _size(self):\n        return "), F.col("p_size").cast("string"), F.lit("\n"))
    files = _joined(_parts(t), "p_brand", body, "p_partkey")
    return files.select(F.concat("p_brand", F.lit("/app.py")).alias("path"), F.concat(F.lit("from fastapi import APIRouter\nimport os\napp = APIRouter(prefix='/v1')\n"), "text").alias("text"))


@query("""SELECT concat(p_brand, '/app.py') AS path, concat('get_', p_partkey) AS name, 'function' AS kind, CAST(NULL AS VARCHAR) AS parent_symbol, true AS is_exported FROM part
UNION ALL SELECT concat(p_brand, '/app.py'), concat('Part', p_partkey), 'class', NULL, true FROM part UNION ALL SELECT concat(p_brand, '/app.py'), '_size', 'function', concat('Part', p_partkey), false FROM part""")
def python_symbols(t: Tables) -> DataFrame:
    return ex.symbols(ex.python_facts(_python(t))).select("path", "name", "kind", "parent_symbol", "is_exported")


@query("""SELECT concat(p_brand, '/app.py') AS path, concat('make_', p_partkey) AS target_name, concat('get_', p_partkey) AS caller FROM part UNION ALL SELECT concat(p_brand, '/app.py'), 'get', NULL FROM part
UNION ALL SELECT DISTINCT concat(p_brand, '/app.py'), 'APIRouter', NULL FROM part""")
def python_calls(t: Tables) -> DataFrame:
    return ex.calls(ex.python_facts(_python(t))).select("path", "target_name", F.when(F.col("target_name") != "get", F.col("caller")).alias("caller"))


@query("SELECT concat(p_brand, '/app.py') AS path, 'fastapi/flask' AS framework, 'GET' AS method, concat('/v1/p', p_partkey, '/{i}') AS route, concat('get_', p_partkey) AS handler FROM part")
def python_endpoints(t: Tables) -> DataFrame:
    return ex.python_endpoints(ex.python_facts(_python(t))).select("path", "framework", "method", "route", "handler")


@query("""SELECT concat(p_brand, '/app.py') AS path, 1 AS line, 'fastapi' AS module FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT concat(p_brand, '/app.py'), 2, 'os' FROM (SELECT DISTINCT p_brand FROM part)""")
def import_edges(t: Tables) -> DataFrame:
    return ex.import_edges(_python(t))


@query("""
WITH p AS (SELECT p_partkey AS k, concat(p_brand, '/app.py') AS path, 4 + 8 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS s FROM part)
SELECT path, concat('get_', k) AS symbol_name, 'function' AS symbol_kind, CAST(NULL AS VARCHAR) AS parent_symbol, s AS start_line, s + 2 AS end_line FROM p UNION ALL SELECT path, concat('Part', k), 'class', NULL, s + 4, s + 4 FROM p
UNION ALL SELECT path, '_size', 'function', concat('Part', k), s + 5, s + 6 FROM p UNION ALL SELECT DISTINCT path, NULL, 'module', NULL, 1, 3 FROM p""")
def python_chunks(t: Tables) -> DataFrame:
    files = _python(t)
    return cc.definition_chunks(files, ex.python_facts(files)).select("path", "symbol_name", "symbol_kind", "parent_symbol", "start_line", "end_line")


#: Sources in each language; ``K`` stands for a part's key.  Each language has a plain one and one with what looks like
#: definitions, calls or brackets and is none.
SOURCES = [
    ("ts", "export class CK {\n  // function no() {\n  run(a) {\n    return helpK(a)\n  }\n}\nfunction helpK(a) { return `}` }\n"),
    ("go", "package p\n\ntype TK struct {\n\tn int\n}\n\nfunc (t *TK) RunK() int {\n\treturn helpK(t.n)\n}\n"),
    ("java", "package p;\n@Service\npublic class CK {\n    public int run(String a) {\n        return this.helpK(\"}\");\n    }\n    abstract void later();\n}\n"),
    ("rs", "pub struct SK;\nimpl SK {\n    pub fn run(&self) -> i32 { helpK('{') }\n}\n"),
    ("rb", "class CK\n  def run(a)\n    a.each do |x|\n      helpK(x)\n    end\n  end\nend\n"),
    ("ts", "export function pageK(r): { n: number } {\n  return `<ul>${r.map(x => `<b>${oneK(x)}{</b>`)}`\n}\nconst f = async (a) => { a.replace(/[{\"]/, '') }\n"),
    ("go", "package p\n\ntype (\n\tAK struct {\n\t\tn int\n\t}\n\tbK int\n)\n\ntype SK interface {\n\tArea() float64\n}\n\nfunc fK() { gK(`{`) }\n"),
    ("java", "record PK(int x) {\n  PK(int y, int z) { this(y); }\n}\nenum EK {\n  A;\n  int n() { return cK(1); }\n}\npublic class QK extends PK {\n  QK() { super(\"{\"); }\n}\n"),
    ("rs", "fn aK<F: Fn(i32) -> i32>(f: F) { f(1); /* /* } */ { */ }\nenum SK { Circle(f64) }\nfn mK() { bK(r#\"{\"#) }\n"),
    ("rb", "class CK\n  def sqlK\n    runK(<<~SQL)\n      end\n    SQL\n  end\n\n  def wK\n    splitK(/end {/)\n  end\nend\n"),
]


def _sources(t: Tables) -> DataFrame:
    """A file for each part, in one source after the other."""
    key = F.col("p_partkey").cast("string")
    choice = (F.col("p_partkey") % len(SOURCES)).cast("int")
    ending, text = (F.element_at(F.array(*[F.lit(k[i]) for k in SOURCES]), choice + 1) for i in (0, 1))
    return t.part.select(F.concat(F.lit("src/p"), key, F.lit("."), ending).alias("path"), F.replace(text, F.lit("K"), key).alias("text"))


@registered("""
WITH v AS (SELECT * FROM (VALUES
(0, 'ts', 'CK', 'class', NULL, 1, 6, true), (0, 'ts', 'run', 'method', 'CK', 3, 5, true), (0, 'ts', 'helpK', 'function', NULL, 7, 7, false),
(1, 'go', 'TK', 'type', NULL, 3, 5, true), (1, 'go', 'RunK', 'method', NULL, 7, 9, true),
(2, 'java', 'CK', 'class', NULL, 2, 8, true), (2, 'java', 'run', 'method', 'CK', 4, 6, true), (2, 'java', 'later', 'method', 'CK', 7, 7, false),
(3, 'rs', 'SK', 'struct', NULL, 1, 1, true), (3, 'rs', 'SK', 'impl', NULL, 2, 4, false), (3, 'rs', 'run', 'function', 'SK', 3, 3, true),
(4, 'rb', 'CK', 'class', NULL, 1, 7, true), (4, 'rb', 'run', 'method', 'CK', 2, 6, true),
(5, 'ts', 'pageK', 'function', NULL, 1, 3, true),
(6, 'go', 'AK', 'type', NULL, 4, 6, true), (6, 'go', 'bK', 'type', NULL, 7, 7, false), (6, 'go', 'SK', 'type', NULL, 10, 12, true), (6, 'go', 'fK', 'function', NULL, 14, 14, false),
(7, 'java', 'QK', 'class', NULL, 8, 10, true), (7, 'java', 'QK', 'method', 'QK', 9, 9, false),
(8, 'rs', 'aK', 'function', NULL, 1, 1, false), (8, 'rs', 'SK', 'enum', NULL, 2, 2, false), (8, 'rs', 'mK', 'function', NULL, 3, 3, false),
(9, 'rb', 'CK', 'class', NULL, 1, 11, true), (9, 'rb', 'sqlK', 'method', 'CK', 2, 6, true), (9, 'rb', 'wK', 'method', 'CK', 8, 10, true)) v(l, ending, name, kind, parent, s, e, shown))
SELECT concat('src/p', p_partkey, '.', ending) AS path, replace(name, 'K', p_partkey::VARCHAR) AS name, kind, replace(parent, 'K', p_partkey::VARCHAR) AS parent_symbol,
       s AS start_line, e AS end_line, shown AS is_exported
FROM part JOIN v ON p_partkey % 10 = l""")
def source_symbols(t: Tables) -> DataFrame:
    return ex.symbols(sf.source_facts(_sources(t))).select("path", "name", "kind", "parent_symbol", "start_line", "end_line", "is_exported")


@registered("""
WITH v AS (SELECT * FROM (VALUES (0, 'ts', 'helpK', 'run', 4), (1, 'go', 'helpK', 'RunK', 8), (2, 'java', 'helpK', 'run', 5), (3, 'rs', 'helpK', 'run', 3), (4, 'rb', 'each', 'run', 3), (4, 'rb', 'helpK', 'run', 4),
(5, 'ts', 'map', 'pageK', 2), (5, 'ts', 'oneK', 'pageK', 2), (5, 'ts', 'replace', NULL, 4), (6, 'go', 'gK', 'fK', 14), (7, 'java', 'cK', NULL, 6), (8, 'rs', 'f', 'aK', 1), (8, 'rs', 'bK', 'mK', 3),
(9, 'rb', 'runK', 'sqlK', 3), (9, 'rb', 'splitK', 'wK', 9)) v(l, ending, name, caller, line))
SELECT concat('src/p', p_partkey, '.', ending) AS path, replace(name, 'K', p_partkey::VARCHAR) AS target_name, replace(caller, 'K', p_partkey::VARCHAR) AS caller, line
FROM part JOIN v ON p_partkey % 10 = l""")
def source_calls(t: Tables) -> DataFrame:
    return ex.calls(sf.source_facts(_sources(t)))


@registered("""
WITH v AS (SELECT * FROM (VALUES
(0, 'ts', 'CK', 'class', NULL, 1, 2), (0, 'ts', 'run', 'method', 'CK', 3, 5), (0, 'ts', 'helpK', 'function', NULL, 7, 7),
(1, 'go', NULL, 'module', NULL, 1, 1), (1, 'go', 'TK', 'type', NULL, 3, 5), (1, 'go', 'RunK', 'method', NULL, 7, 9),
(2, 'java', NULL, 'module', NULL, 1, 1), (2, 'java', 'CK', 'class', NULL, 2, 3), (2, 'java', 'run', 'method', 'CK', 4, 6), (2, 'java', 'later', 'method', 'CK', 7, 7),
(3, 'rs', 'SK', 'struct', NULL, 1, 1), (3, 'rs', 'SK', 'impl', NULL, 2, 2), (3, 'rs', 'run', 'function', 'SK', 3, 3),
(4, 'rb', 'CK', 'class', NULL, 1, 1), (4, 'rb', 'run', 'method', 'CK', 2, 6),
(5, 'ts', 'pageK', 'function', NULL, 1, 3), (5, 'ts', NULL, 'module', NULL, 4, 4),
(6, 'go', NULL, 'module', NULL, 1, 3), (6, 'go', 'AK', 'type', NULL, 4, 6), (6, 'go', 'bK', 'type', NULL, 7, 7), (6, 'go', NULL, 'module', NULL, 8, 8), (6, 'go', 'SK', 'type', NULL, 10, 12), (6, 'go', 'fK', 'function', NULL, 14, 14),
(7, 'java', NULL, 'module', NULL, 1, 7), (7, 'java', 'QK', 'class', NULL, 8, 8), (7, 'java', 'QK', 'method', 'QK', 9, 9),
(8, 'rs', 'aK', 'function', NULL, 1, 1), (8, 'rs', 'SK', 'enum', NULL, 2, 2), (8, 'rs', 'mK', 'function', NULL, 3, 3),
(9, 'rb', 'CK', 'class', NULL, 1, 1), (9, 'rb', 'sqlK', 'method', 'CK', 2, 6), (9, 'rb', 'wK', 'method', 'CK', 8, 10)) v(l, ending, name, kind, parent, s, e))
SELECT concat('src/p', p_partkey, '.', ending) AS path, replace(name, 'K', p_partkey::VARCHAR) AS symbol_name, kind AS symbol_kind, replace(parent, 'K', p_partkey::VARCHAR) AS parent_symbol,
       s AS start_line, e AS end_line
FROM part JOIN v ON p_partkey % 10 = l""")
def source_chunks(t: Tables) -> DataFrame:
    files = _sources(t)
    return cc.definition_chunks(files, sf.source_facts(files)).select("path", "symbol_name", "symbol_kind", "parent_symbol", "start_line", "end_line")


def _over(t: Tables, name: str, files: DataFrame, columns: str) -> DataFrame:
    """A table function by name, in SQL, over files."""
    tables.register(t.spark)
    return t.spark.sql(f"SELECT {columns} FROM {name}(TABLE(SELECT * FROM {{files}}))", files=spread(files))


@registered(sql_of("source_symbols"))
def table_symbols(t: Tables) -> DataFrame:
    return _over(t, "symbols", _sources(t), "*")


@registered(sql_of("source_calls"))
def table_calls(t: Tables) -> DataFrame:
    return _over(t, "calls", _sources(t), "*")


@registered("""
SELECT concat('src/P', p_partkey, '.java') AS path, m.method, concat('/p', p_partkey, m.route) AS route, concat(m.handler, p_partkey) AS handler, m.line, m.guarded
FROM part, (VALUES ('GET', '/one/{id}', 'one', 4, false), (NULL, '/raw', 'raw', 6, true), ('POST', '', 'add', 9, false)) m(method, route, handler, line, guarded) WHERE p_partkey % 2 = 0""")
def table_endpoints(t: Tables) -> DataFrame:
    """A controller for each second part, a class that is none for the others."""
    key = F.col("p_partkey").cast("string")
    text = """@KIND("users")
@RequestMapping("/pK/")
class PK {
  @GetMapping("one/{id}") public U oneK(@PathVariable("{") int id) { return f("}"); }
  // @GetMapping("/no")
  @RequestMapping("/raw")
  @PreAuthorize("x")
  List<Map<String, U>> rawK() { return null; }
  @PostMapping void addK() {}
}
"""
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("RestController")).otherwise(F.lit("FeignClient"))
    files = t.part.select(F.concat(F.lit("src/P"), key, F.lit(".java")).alias("path"), F.replace(F.replace(F.lit(text), F.lit("KIND"), kind), F.lit("K"), key).alias("text"))
    return _over(t, "endpoints", files, "*")


@registered("""
WITH d AS (SELECT doc_id, text FROM documents WHERE len(text) > 0), w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((len(text) - 1500) / 1300.0)) AS BIGINT) + 1)) AS k FROM d),
c AS (SELECT doc_id, k, substr(text, k * 1300 + 1, 1500) AS content, substr(text, 1, k * 1300) AS before FROM w)
SELECT CAST(doc_id AS VARCHAR) AS path, k, sha256(content) AS content_hash, 1 + len(before) - len(replace(before, chr(10), '')) AS start_line,
       1 + len(before) - len(replace(before, chr(10), '')) + len(content) - 1 - len(replace(substr(content, 1, len(content) - 1), chr(10), '')) AS end_line FROM c""")
def table_chunks(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), "text")
    return _over(t, "chunks", files, "path, k, sha2(content, 256) AS content_hash, start_line, end_line")
