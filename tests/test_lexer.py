"""What is code and what is not, in all languages; declarations, calls and statements that follow from it."""

import time

import pytest

from textquarry.operators import code_chunks, source_facts
from textquarry.operators.lexer import blanked, brackets, statements
from textquarry.operators.source_facts import SCANNED, scanned
from textquarry.operators.spring import routes


def symbols(text, language):
    return [(f[1], f[2], f[3], f[4], f[5]) for f in scanned(text, language) if f[0] == "symbol"]


def calls(text, language):
    return [f[2] for f in scanned(text, language) if f[0] == "call"]


@pytest.mark.parametrize(
    "language,text,code",
    [
        ("javascript", "a(`x ${b(`y ${c({d: 1})} }`)} {`) // e(", "a(`    b(`    c({d: 1})   `)   `)      "),
        ("javascript", "r = /[/{]\"/g; s = a / b / c; return /{/", "r =         ; s = a / b / c; return    "),
        ("javascript", "f('it\\'s {', \"{\", x) /* { */", "f('       ', \" \", x)        "),
        ("go", "a := `{\n\"`; b := '{'; c(\"\\\"{\")", "a := ` \n `; b := ' '; c(\"   \")"),
        ("java", 'x("""\n{ " }\n"""); y(\'"\', "{");', 'x("  \n     \n  "); y(\' \', " ");'),
        ("rust", "fn f<'a>(x: &'a str) { r#\"{\"\"#; '{'; \"\n{\"; /* /* } */ { */ }", "fn f<'a>(x: &'a str) {        ; ' '; \"\n \";                 }"),
        ("ruby", "x = <<~A + <<-B\n  end { #{q}\n  A\n def\n B\ny(\"#{z(\"}\")} {\") # end", "x =      +     \n            \n   \n    \n  \ny(\"  z(\" \")   \")      "),
        ("ruby", "a / b; split /{/; %w[end ( ] << q; x =~ /[}]/", "a / b; split    ;            << q; x =~     "),
    ],
)
def test_what_is_code(language, text, code):
    assert blanked(text, language).rstrip() == code.rstrip() and len(blanked(text, language)) == len(text)


@pytest.mark.parametrize("language", SCANNED)
def test_lengths_and_lines_stay_and_long_texts_end_soon(language):
    started = time.monotonic()
    for part in ['"\\"', "/*", "`", "`${", "{", "}", "/", "/a", "a/", "<<A\n", "%w[", "#{", '"#{', "'", "r#\"", "\n", "=begin\n", "/[", "b'"]:
        text = part * 20_000
        bare = blanked(text, language)
        assert len(bare) == len(text) and bare.count("\n") == text.count("\n")
    assert time.monotonic() - started < 30


def test_templates_in_templates_keep_their_file():
    text = "export function page(rows) {\n  return `<ul>${rows.map(r => `<li class=\"{\">${item(r)}</li>`).join('')}</ul>`\n}\nfunction after() { return 1 }\n"
    assert symbols(text, "javascript") == [("function", "page", None, 1, 3), ("function", "after", None, 4, 4)]
    assert calls(text, "javascript") == ["map", "item", "join"]


def test_heredocs_do_not_end_methods():
    text = "class A\n  def sql\n    run(<<~SQL, 1)\n      begin\n      end\n    SQL\n  end\n\n  def b\n    %w[end end].each do |x|\n      go(x)\n    end\n  end\nend\n"
    assert symbols(text, "ruby") == [("class", "A", None, 1, 14), ("method", "sql", "A", 2, 7), ("method", "b", "A", 9, 13)]


def test_regular_expressions_and_types_in_braces():
    text = "function f(a: string): { n: number } {\n  return a.replace(/[{\"]/g, '')\n}\nclass B<T extends { x: number }> {\n  m(q: T): Promise<{ y: T }> {\n    return go(q)\n  }\n}\n"
    assert symbols(text, "typescript") == [("function", "f", None, 1, 3), ("class", "B", None, 4, 8), ("method", "m", "B", 5, 7)]
    assert calls(text, "typescript") == ["replace", "go"]


def test_no_calls():
    assert calls("const f = async (a) => { await g(a) }\nconst o = { run(x) { return h(x) } }\nclass A { constructor() { super(1) } }\n", "javascript") == ["g", "h"]
    go = "package p\n\ntype (\n\tA struct {\n\t\tn int\n\t}\n\tb int\n)\n\ntype Shape interface {\n\tArea() float64\n\tName(x int) string\n}\n\nfunc f() { g(1) }\n"
    assert calls(go, "go") == ["g"]
    assert symbols(go, "go") == [("type", "A", None, 4, 6), ("type", "b", None, 7, 7), ("type", "Shape", None, 10, 13), ("function", "f", None, 15, 15)]
    java = "record Point(int x, int y) {\n  Point(int z) { this(z, z); }\n}\nenum E {\n  A, B;\n  int size() throws X { return count(1); }\n}\nclass C extends D {\n  C() { super(2); new Thing() { void run() { go(); } }; }\n}\n"
    assert calls(java, "java") == ["count", "go"]
    rust = "fn apply<F: Fn(i32) -> i32, G>(f: F, g: G) where G: FnMut(u8) { f(1); g(2) }\nenum Shape { Circle(f64), Line }\nfn make() -> Shape { build(Circle(1.0)) }\n"
    assert calls(rust, "rust") == ["f", "g", "build", "Circle"]


def test_statements_of_blocks():
    text = "{ a(1);\n if (b) {\n c()\n } else {\n d()\n }\n let e = {\n f: 1 }\n g\n  .h()\n return 2 }"
    pairs = brackets(text)
    got = [text[a : z + 1] for a, z in statements(text, pairs, 1, pairs[0], True)]
    assert got == ["a(1);", "if (b) {\n c()\n } else {\n d()\n }", "let e = {\n f: 1 }", "g\n  .h()", "return 2"]
    java = "{ int a = 1;\n for (int i = 0; i < 3; i++) { b(); }\n c(); }"
    pairs = brackets(java)
    assert [java[a : z + 1] for a, z in statements(java, pairs, 1, pairs[0], False)] == ["int a = 1;", "for (int i = 0; i < 3; i++) { b(); }", "c();"]


LARGE = {
    "a.js": ("function big(a) {\n", "  step%d(a, {\n    long: 'x'\n  })\n", "}\n"),
    "a.go": ("func big(a int) {\n", "\tif step%d(a) {\n\t\tgo run(a)\n\t}\n", "}\n"),
    "A.java": ("class A {\n  void big(int a) {\n", "    step%d(a,\n      1);\n", "  }\n}\n"),
    "a.rs": ("fn big(a: i32) {\n", "    step%d(\n        a);\n", "}\n"),
    "a.rb": ("def big(a)\n", "  a.each do |x|\n    step%d(x)\n  end\n", "end\n"),
}


@pytest.mark.parametrize("path", sorted(LARGE))
def test_large_functions_are_packed_by_whole_statements(spark, path):
    head, step, tail = LARGE[path]
    n = 4_000 // len(step) + 60
    text = head + "".join(step % i for i in range(n)) + tail
    files = spark.createDataFrame([(path, text)], "path string, text string")
    rows = code_chunks.definition_chunks(files, source_facts.source_facts(files)).where("symbol_name = 'big'").orderBy("start_line").collect()
    assert len(rows) >= 2 and all(len(r.content) <= source_facts.LARGE for r in rows)
    lines, height = text.split("\n"), step.count("\n")
    top = head.count("\n")
    for r in rows[1:]:
        assert (r.start_line - 1 - top) % height == 0 and r.content == "\n".join(lines[r.start_line - 1 : r.end_line])
    for a, b in zip(rows, rows[1:]):
        assert b.start_line == a.end_line - height + 1  # the last statement is said again
    assert rows[0].start_line == top and rows[-1].end_line == top + n * height + 1


def test_spring_by_declarations():
    package_private = '@RestController\n@RequestMapping("/z")\nclass A {\n  @RequestMapping("/y")\n  User post() { return null; }\n  @GetMapping\n  <T> List<Map<String, T>> all(@RequestParam("{") String q) { return x; }\n}\n'
    assert list(routes(package_private)) == [(None, "/z/y", "post", 4, False), ("GET", "/z", "all", 6, False)]
    named = '@RestController("users") @RequestMapping("/api")\nclass B {\n  @GetMapping("u") public U u() {}\n  static class Inner { @GetMapping("/no") void no() {} }\n  private int n = f(1);\n}\n'
    assert list(routes(named)) == [("GET", "/api/u", "u", 3, False)]
    assert list(routes('@FeignClient @RequestMapping("/remote")\nclass C { @GetMapping("/u") U u(); }')) == []
    guarded = 'class Outer {\n  @Controller\n  static class In {\n    @Secured({"A", "B"})\n    @DeleteMapping(value = "/d/{id}", produces = "x")\n    // @GetMapping("/comment")\n    void d() {}\n    In() {}\n  }\n}\n'
    assert list(routes(guarded)) == [("DELETE", "/d/{id}", "d", 5, True)]
    assert list(routes("@RestController class X { @GetMapping void a() { ")) == []
    assert list(routes('@RestController class X { @GetMapping void a() {} @PostMapping("/") void b() {} }')) == [("GET", "/", "a", 1, False), ("POST", "/", "b", 1, False)]
