"""Functions of brace languages and lock files."""

import pytest

from lattica.sources import braces, code

JS = """// a comment with function fake() {
import x from 'y'
class Shop {
  /** doc */
  async buy(item, count = 1) {
    if (count > 1 && item) {
      for (const i of item) { pay(i, "{") }
    }
    return total
  }
}
const add = (a, b) => {
  const c = a + b
  return c
}
function outer({ a, b }, ...rest) {
  function inner() { return }
  switch (a) { case 1: inner(); break }
}
if (ready(x)) { start() }
"""
RUST = """/// Adds.
pub fn add<T: Into<u8>>(a: T, mut b: u8) -> u8 where T: Copy {
    let c = match b { 0 => 1, _ => 2 };
    c + 'x' as u8
}
impl Shop for Corner {
    fn open(&self, keys: Vec<(u8, u8)>) -> Result<(), E> {
        while self.closed() { if keys.is_empty() { return Ok(()); } }
        unlock(keys)
    }
}
"""
GO = """package main
func (s *Server) Run(port int, name string) (int, error) {
\tif port == 0 || name == "" { return 0, nil }
\tx := listen(port)
\treturn x, nil
}
func main() { Run(1) }
"""
JAVA = """public class A extends B {
  int size = 3;
  @Override
  public List<String> names(Map<String, Integer> all, final int n) throws IOException {
    try { load(all); } catch (Exception e) { return null; }
    return n > 0 ? this.names(all, n - 1) : null;
  }
  abstract void none();
}
"""
C = """#include <a.h>
static int sum(const int *v, size_t n) {
  int s = 0;
  for (size_t i = 0; i < n; i++) { s += v[i]; }
  return s;
}
void stop(void) { exit(1); }
"""


def facts(text, language):
    return {f["name"]: f for f in braces.parse("p", text, language)}


def test_javascript():
    f = facts(JS, "javascript")
    assert set(f) == {"buy", "add", "outer", "inner"}
    assert f["buy"]["class_name"] == "Shop" and f["buy"]["params"] == ["item", "count"] and (f["buy"]["line_start"], f["buy"]["line_end"]) == (5, 10)
    assert f["buy"]["complexity"] == 4 and f["buy"]["nesting"] == 2 and f["buy"]["is_async"] and f["buy"]["has_doc"] and f["buy"]["calls"] == ["pay"]
    assert f["add"]["stores"] == ["c"] and f["add"]["returns"] == 1 and not f["add"]["is_async"]
    assert f["inner"]["bare_returns"] == 1 and f["outer"]["bare_returns"] == 0 and f["outer"]["calls"] == ["inner"] and f["outer"]["complexity"] == 2


def test_rust_go_java_c():
    r = facts(RUST, "rust")
    assert set(r) == {"add", "open"} and r["add"]["params"] == ["a", "b"] and r["add"]["has_doc"] and r["open"]["class_name"] == "Corner" and r["open"]["params"] == ["keys"] and r["open"]["nesting"] == 2 and r["open"]["complexity"] == 3
    g = facts(GO, "go")
    assert set(g) == {"Run", "main"} and g["Run"]["class_name"] == "Server" and g["Run"]["params"] == ["port", "name"] and g["Run"]["complexity"] == 3 and "x" in g["Run"]["stores"] and g["main"]["calls"] == ["Run"]
    j = facts(JAVA, "java")
    assert set(j) == {"names"} and j["names"]["class_name"] == "A" and j["names"]["params"] == ["all", "n"] and j["names"]["complexity"] == 3 and j["names"]["returns"] == 2
    c = facts(C, "c")
    assert set(c) == {"sum", "stop"} and c["sum"]["params"] == ["v", "n"] and c["stop"]["params"] == [] and c["sum"]["complexity"] == 2


@pytest.mark.parametrize("text", ["", "{", "function f(", "fn x() {", "}}}}", 'var a = "unclosed', "/* open", "class {", "f(((", "a" * 100_000])
def test_broken_files_give_nothing(text):
    for language in braces.LANGUAGES:
        assert braces.parse("p", text, language) == []


def test_functions_of_all_languages_meet(spark):
    files = spark.createDataFrame([("a.js", "javascript", JS), ("b.rs", "rust", RUST), ("c.go", "go", GO), ("d.py", "python", "def run(x):\n    return main(x)\n"), ("e.yml", "yaml", "a: b")], "path string, language string, content string")
    f = code.functions(files)
    assert {r.path for r in f.collect()} == {"a.js", "b.rs", "c.go", "d.py"}
    assert ("d.py::run", "c.go::main") in {(r.src, r.dst) for r in code.call_edges(f).collect()}


def test_yarn_and_pipfile_locks(spark):
    yarn = '# yarn lockfile v1\n\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.24.0"\n  resolved "https://x"\n\nlodash@^4.17.0:\n  version "4.17.21"\n'
    pipfile = '{"_meta": {"hash": {}}, "default": {"flask": {"version": "==2.0.1"}}, "develop": {"pytest": {"version": "==8.1.0"}, "local": {}}}'
    got = {tuple(r) for r in code.lock_entries(spark.createDataFrame([("web/yarn.lock", yarn), ("Pipfile.lock", pipfile)], "path string, content string")).collect()}
    assert got == {("npm", "@babel/core", "7.24.0"), ("npm", "lodash", "4.17.21"), ("PyPI", "flask", "2.0.1"), ("PyPI", "pytest", "8.1.0")}
