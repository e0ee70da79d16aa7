"""Definitions and calls of languages that are scanned: brackets, strings, comments, nesting, odd and long texts."""

import time

import pytest

from textquarry.operators.index import Index
from textquarry.operators.source_facts import SCANNED, scanned, source_facts

TYPESCRIPT = """import {a} from './a'
export class UserClient {
  // class Fake {
  constructor(private x: string) {}
  async get({id, n}: Q): Promise<User> {
    if (id) { return this.fetchIt(`u/${id}`) }
    function inner() { helper() }
    return parse(n)
  }
  abstract nothing(): void;
}
interface Shape {
  area(): number
}
export default function main() {
  const c = new UserClient("}")
  c.get({id: 1})
}
"""
GO = """package x
type ID int
type Server struct {
	name string
}
func (s *Server) Run(a int) error {
	fmt.Println("}")
	return s.stop(a)
}
func helper() { make([]int, 3) }
type last string
"""
JAVA = """package a;
@RestController
public class Foo<T> extends Bar {
    private int x = compute(1);
    public Foo(int a) { this.x = a; }
    @GetMapping("/x")
    @Auth
    public List<Map<String, T>> list(String q) throws E {
        return service.find(new Q(q));
    }
    protected abstract void later();
}
class Other {}
"""
RUST = """pub struct Point { x: f64 }
impl<T: Clone> Display for Wrap<T> {
    fn fmt(&self, f: &'a mut Formatter) -> Result { write(f, '{'); Self::go(); self.inner() }
}
impl Point {
    pub fn new(x: f64) -> Self { Point { x } }
}
pub(crate) async fn run() { println!("}"); helper(1) }
"""
RUBY = """module Shop
  class Cart < Base
    def add(item)
      items.push(item) if item
      items.each do |x|
        puts "end #{x}"
      end
    end
    def self.empty; end
    def size = @items.count
    # def no
  end
end
def top
  Cart.new
end
"""
WANT = {
    "typescript": (TYPESCRIPT, [("class", "UserClient", None, 2, 11, True), ("method", "constructor", "UserClient", 4, 4, True), ("method", "get", "UserClient", 5, 9, True), ("interface", "Shape", None, 12, 14, False), ("function", "main", None, 15, 18, True)], [("fetchIt", "get"), ("helper", "get"), ("parse", "get"), ("get", "main")]),
    "go": (GO, [("type", "ID", None, 2, 2, True), ("type", "Server", None, 3, 5, True), ("method", "Run", None, 6, 9, True), ("function", "helper", None, 10, 10, False), ("type", "last", None, 11, 11, False)], [("Println", "Run"), ("stop", "Run"), ("make", "helper")]),
    "java": (JAVA, [("class", "Foo", None, 2, 12, True), ("method", "Foo", "Foo", 5, 5, True), ("method", "list", "Foo", 6, 10, True), ("method", "later", "Foo", 11, 11, False), ("class", "Other", None, 13, 13, False)], [("compute", None), ("find", "list")]),
    "rust": (RUST, [("struct", "Point", None, 1, 1, True), ("impl", "Wrap<T>", None, 2, 4, False), ("function", "fmt", "Wrap<T>", 3, 3, False), ("impl", "Point", None, 5, 7, False), ("function", "new", "Point", 6, 6, True), ("function", "run", None, 8, 8, True)], [("write", "fmt"), ("inner", "fmt"), ("helper", "run")]),
    "ruby": (RUBY, [("module", "Shop", None, 1, 13, True), ("class", "Cart", "Shop", 2, 12, True), ("method", "add", "Cart", 3, 8, True), ("method", "empty", "Cart", 9, 9, True), ("method", "size", "Cart", 10, 10, True), ("method", "top", None, 14, 16, True)], [("push", "add"), ("each", "add"), ("puts", "add"), ("count", "size"), ("new", "top")]),
}


@pytest.mark.parametrize("language", sorted(WANT))
def test_definitions_and_calls(language):
    text, symbols, calls = WANT[language]
    facts = list(scanned(text, language))
    assert [(f[1], f[2], f[3], f[4], f[5], f[7]) for f in facts if f[0] == "symbol"] == symbols
    # ``Cart.new`` calls a method that is named like a word of other languages.
    assert [(f[2], f[3]) for f in facts if f[0] == "call"] == [c for c in calls if c != ("new", "top")]


@pytest.mark.parametrize("language", SCANNED)
def test_odd_and_long_texts_end_soon(language):
    assert list(scanned("", language)) == []
    assert list(scanned("def f\n" if language == "ruby" else "function f() { (\nfunc f() {\n", language)) == []
    started = time.monotonic()
    for part in ['"\\"', "/*", "`", "public ", "function ", "impl<", "{", "(", "x ", "@a ", " ", "\n", "def x ", "if ", "def x\n", "if x\n", "type x ((", "func (", "export\n"]:
        list(scanned(part * 40_000, language))
    assert time.monotonic() - started < 30


def test_files_of_all_languages(spark):
    rows = [("a.go", GO), ("b.py", "def f():\n    return helper()\n"), ("c.rb", None), ("d.txt", GO), ("e.js", "")]
    got = source_facts(spark.createDataFrame(rows, "path string, text string")).where("fact = 'symbol'").select("path", "name").collect()
    assert {tuple(r) for r in got} == {("a.go", n) for n in ("ID", "Server", "Run", "helper", "last")} | {("b.py", "f")}


def test_index_links_definitions_of_any_language(spark):
    texts = {"a.go": GO, "b.rs": RUST, "c.go": "package y\n\nfunc stop(n int) int {\n\treturn n\n}\n"}
    rows = [(p, t, str(hash(t)), t.count("\n")) for p, t in texts.items()]
    index = Index.build(spark.createDataFrame(rows, "path string, text string, content_hash string, loc long"))
    chunks = {r.chunk_id: r for r in index.chunks.collect()}
    # Blocks of one file that share a name keep their first lines each.
    assert {(r.symbol_kind, r.symbol_name, r.start_line, r.end_line) for r in chunks.values() if r.path == "b.rs" and r.symbol_kind in ("struct", "impl")} == {("struct", "Point", 1, 1), ("impl", "Wrap<T>", 2, 2), ("impl", "Point", 5, 5)}
    assert ("Run", "stop", 1) in {(chunks[r.src].symbol_name, chunks[r.dst].symbol_name, r.kind) for r in index.edges.collect()}
    asked = spark.createDataFrame([(1, "Where is `stop` defined?")], "q long, question string")
    assert index.answered(asked).first().text == "`stop` (function) is defined in [c.go:3-5]"
