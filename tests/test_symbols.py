"""Symbols with spans of small files in several languages, and of broken ones."""

import pytest

from glyphmill.operators import symbols

JAVA = '''package a; // class No {
/** class No { } */
@Service
public class Outer<T> extends Base {
  private static final String S = "class No { }";
  @Override public List<String> names(int a, char c) throws X {
    for (int i = 0; i < a; i++) { if (c == '}') { call(i); } }
    return other(a);
  }
  enum Kind { A, B }
  class Inner { void go() { names(1); } }
  abstract void later(int a);
}
interface Shape { double area(); }
'''
JS = '''import x from 'y';
function top(a) {
  const inner = (b) => { return run(b); };
  return inner(`}${a}`);
}
class Box extends Base {
  constructor(a) { super(a); }
  static async load(path) {
    if (path) { fetchIt(path); }
  }
}
const short = x => x + 1;
'''
PY = '''"""
def ghost():
"""
class A:
    x = 1

    def one(self,
            b):
        return two(b)  # def no():

    class B:
        def deep(self): return three()

async def last():
    pass
'''
GO = '''package p

type S struct {
	a int
}

func (s *S) Do() error {
	return func() error { return s.run() }()
}

func main() {
	Do()
}
'''
C = '''struct point { int x; };
static int add(int a,
               int b) {
  return sum(a, b);
}
int declared(int a);
'''
RUST = '''mod m {
  pub fn f<'a>(x: &'a str) -> i32 { g(x) }
  impl Draw for Shape { fn draw(&self) { f("}"); } }
}
'''


@pytest.fixture(scope="module")
def found(spark):
    files = [("A.java", "java", JAVA), ("a.js", "javascript", JS), ("a.py", "python", PY), ("a.go", "go", GO), ("a.c", "c", C), ("a.rs", "rust", RUST), ("open.java", "java", "class Open {\n  void a() {\n"), ("none.java", "java", None), ("x.txt", "text", "class A {}"), (None, "java", "class N {}"), ("shut.java", "java", "} } class Shut { }")]
    own, calls = symbols.symbols(spark.createDataFrame(files, "path string, language string, content string"), ("java", "javascript", "python", "go", "c", "rust"))
    by = {}
    for r in own.collect():
        by.setdefault(r["path"], set()).add((r["kind"], r["name"], r["start_line"], r["end_line"], r["parent"], r["parent_line"]))
    used = {}
    for r in calls.collect():
        used.setdefault(r["path"], set()).add((r["name"], r["line"], r["owner"]))
    return by, used


def test_java(found):
    assert found[0]["A.java"] == {
        ("class", "Outer", 4, 13, None, None), ("method", "names", 6, 9, "Outer", 4), ("enum", "Kind", 10, 10, "Outer", 4), ("class", "Inner", 11, 11, "Outer", 4), ("method", "go", 11, 11, "Inner", 11),
        ("method", "later", 12, 12, "Outer", 4), ("interface", "Shape", 14, 14, None, None), ("method", "area", 14, 14, "Shape", 14),
    }
    assert found[1]["A.java"] == {("call", 7, "names"), ("other", 8, "names"), ("names", 11, "go")}


def test_javascript(found):
    assert found[0]["a.js"] == {
        ("function", "top", 2, 5, None, None), ("function", "inner", 3, 3, "top", 2), ("class", "Box", 6, 11, None, None), ("method", "constructor", 7, 7, "Box", 6), ("method", "load", 8, 10, "Box", 6), ("function", "short", 12, 12, None, None),
    }
    assert found[1]["a.js"] == {("run", 3, "inner"), ("inner", 4, "top"), ("fetchIt", 9, "load")}


def test_python(found):
    assert found[0]["a.py"] == {("class", "A", 4, 12, None, None), ("function", "one", 7, 9, "A", 4), ("class", "B", 11, 12, "A", 4), ("function", "deep", 12, 12, "B", 11), ("function", "last", 14, 15, None, None)}
    assert found[1]["a.py"] == {("two", 9, "one"), ("three", 12, "deep")}


def test_go_c_and_rust(found):
    assert found[0]["a.go"] == {("struct", "S", 3, 5, None, None), ("method", "Do", 7, 9, None, None), ("function", "main", 11, 13, None, None)}
    assert found[1]["a.go"] == {("run", 8, "Do"), ("Do", 12, "main")}
    assert found[0]["a.c"] == {("struct", "point", 1, 1, None, None), ("function", "add", 3, 5, None, None)} and ("sum", 4, "add") in found[1]["a.c"]
    assert found[0]["a.rs"] == {("module", "m", 1, 4, None, None), ("function", "f", 2, 2, "m", 1), ("impl", "Shape", 3, 3, "m", 1), ("function", "draw", 3, 3, "Shape", 3)}


def test_broken_files(found):
    assert {s[:4] for s in found[0]["open.java"]} == {("class", "Open", 1, 1), ("method", "a", 2, 2)}
    assert found[0]["shut.java"] == {("class", "Shut", 1, 1, None, None)}
    assert not {"none.java", "x.txt", None} & set(found[0])


def test_nothing_of_a_file_is_shuffled(spark):
    files = spark.createDataFrame([("a.java", "java", JAVA), ("b.py", "python", PY)], "path string, language string, content string")
    for rows in symbols.symbols(files, ("java", "python")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_places_are_counted_in_characters(spark):
    text = "class \0A {\n  /* é😀 */ void é() { go(1); }\n  void b() { é😀; run(2); }\n}\n"
    own, calls = symbols.symbols(spark.createDataFrame([("a.java", "java", text)], "path string, language string, content string"), ("java",))
    assert {tuple(r) for r in own.collect()} >= {("a.java", "method", "b", 3, 3, None, None, 0)}
    assert {tuple(r) for r in calls.select("name", "line", "owner").collect()} >= {("run", 3, "b")}
