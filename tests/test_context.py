"""Query fields, hybrid ranking, snapshots and the engine's front on a small graph."""

import pytest
from pyspark.sql import functions as F

from glyphmill.engine import Engine
from glyphmill.operators import subgraph
from glyphmill.plans import context
from glyphmill.sources import extract


def test_field_query():
    q = context.field_query('kind:function KIND:bogus lang:go path:"a b/c" name:Auth TODO: foo:bar plain')
    assert (q.kinds, q.languages, q.paths, q.names) == (["function"], ["go"], ["a b/c"], ["Auth"])
    assert q.text == "KIND:bogus TODO: foo:bar plain"
    assert context.field_query("").text == ""


def test_term_groups():
    assert context.term_groups(["index", "indexed", "shard", "shard"]) == [["indexed", "index"], ["shard"]]


NODES = [
    ("f1", "function", "parse_header", "src/http/parse.go"), ("f2", "function", "header", "src/http/head.go"), ("f3", "function", "parse_header_twice", "src/http/parse_test.go"), ("c1", "class", "ParserHeader", "src/http/c.java"),
    ("f4", "function", "unrelated", "src/db/x.go"),
]
EDGES = [("f1", "f2", "calls"), ("f2", "f4", "calls"), ("f3", "f1", "calls"), ("c1", "f1", "contains"), ("f1", "f2", "calls"), ("f4", "f4", "calls")]


@pytest.fixture(scope="module")
def engine(spark):
    n = spark.createDataFrame(NODES, "id string, kind string, name string, file_path string").withColumns({"qualified_name": F.col("name"), "language": F.lit("go"), "signature": F.lit(None).cast("string"), "docstring": F.lit(""), "start_line": F.lit(1)})
    e = spark.createDataFrame(EDGES, "source string, target string, kind string").withColumn("line", F.lit(1))
    m = spark.createDataFrame([("m1", "file", "r1", "agent", [1.0, 0.0]), ("m2", "file", "r1", "auto", [0.0, 1.0]), ("m3", "flow", "r2", "auto", [1.0, 0.1])], "key string, mem_type string, repo string, source string, embedding array<float>")
    return Engine(n, e, m)


def test_hybrid(engine):
    rows = {r["id"]: r for r in engine.search("parse header").collect()}
    assert rows["f1"]["hits"] == 2 and rows["f1"]["confident"] and not rows["f2"]["confident"] and "f4" not in rows
    assert rows["f3"]["score"] < rows["f1"]["score"]  # a test
    assert {r["id"] for r in engine.search("kind:class").collect()} == {"c1"}


def test_snapshot(engine, spark):
    seeds = spark.createDataFrame([("f1",)], "id string")
    nodes = subgraph.snapshot(engine.edges, seeds, auxiliary=(("contains", "method", True),))
    found = {(r["id"], r["role"], r["depth"]) for r in nodes.collect()}
    assert found == {("f1", "seed", 0), ("f2", "callee", 1), ("f4", "callee", 2), ("f3", "caller", -1), ("c1", "method", 1)}
    assert subgraph.snapshot(engine.edges, seeds, auxiliary=(), frontier=1, most=2).count() == 2
    placed = engine.nodes.join(nodes, "id")
    kept = subgraph.plan_filtered(placed, engine.edges, F.contains("name", F.lit("header")), F.contains("file_path", F.lit("_test")))
    assert {r["id"] for r in kept.collect()} == {"f1", "f2", "c1"}  # f4 is two steps away
    assert subgraph.recovered_edges(engine.edges, nodes, engine.edges.where("source = 'f1'")).count() == 4
    assert {tuple(r)[:2] for r in subgraph.collapsed_to_files(placed).collect()} >= {("src/http/parse.go", "seed")}


def test_empty_graph(engine, spark):
    seeds = spark.createDataFrame([("none",)], "id string")
    assert [tuple(r) for r in subgraph.snapshot(engine.edges.limit(0), seeds).collect()] == [("none", "seed", 0)]


def test_front(engine):
    assert {r["id"] for r in engine.callers("parse_header").collect()} == {"f3"}
    assert {r["id"] for r in engine.callees("f1", depth=2).collect()} == {"f2", "f4"}
    assert {r["key"] for r in engine.recall([1.0, 0.0]).collect()} == {"m1", "m3"}
    assert engine.node("header", file="head.go", line=3).count() == 1 and engine.files("src/http").count() == 4
    assert {(r["of"], r["name"]): r["n"] for r in engine.status().collect()}[("edge", "calls")] == 5
    out = engine.dev_context("why does parse header crash", [1.0, 0.0], seeds=1)
    best = out["symbols"].orderBy(F.desc("score"), "id").first()["id"]
    assert out["intent"] == "debug" and [r["id"] for r in out["graph"].where("role = 'seed'").collect()] == [best] and out["memories"].count() == 2
    files = {r["file_path"]: r["symbols"] for r in engine.explore("parse header").collect()}
    assert files == {"src/http/c.java": 1, "src/http/parse.go": 1, "src/http/head.go": 1, "src/http/parse_test.go": 1}


def test_prefixed_routes(spark):
    files = spark.createDataFrame([("a", "@Get('free') f()\n@Controller('x/')\n@Get() g()\n@Post('/y') h()\n@Controller()\n@Put('z') p()"), ("b", None)], "path string, content string")
    assert sorted(tuple(r) for r in extract.prefixed_routes(files, "path", "content", *extract.NEST).collect()) == [("a", "/free"), ("a", "/x"), ("a", "/x/y"), ("a", "/z")]


def test_patterns(spark):
    text = {
        "play": "GET   /a/:id   c.A.show\n", "drupal": "x:\n  path: '/d/e'\n", "razor": '@page "/p"\n', "liquid": "{% include 'snip' %}", "mybatis": '<mapper namespace="a.B"><select id="one">', "dfm": "object Form1: TForm1\n", "swiftui": "struct Home: View {",
        "react": "export const Card = (props) => <b/>\n", "expo": 'Function("go")', "fabric": '@ReactProp(name = "tint")', "react-native": "RCT_EXPORT_METHOD(play:(id)x)", "actix": 'web::resource("/w")', "nestjs": "@MessagePattern('m')",
    }
    files = spark.createDataFrame([*text.items()], "path string, content string")
    found = {(r["path"], r["name"]) for r in extract.extracted(files, "path", "content").where("path = framework").collect()}
    want = {("play", "/a/:id"), ("drupal", "/d/e"), ("razor", "/p"), ("liquid", "snip"), ("mybatis", "a.B"), ("mybatis", "one"), ("dfm", "Form1"), ("swiftui", "Home"), ("react", "Card"), ("expo", "go"), ("fabric", "tint"), ("react-native", "play"), ("actix", "/w"), ("nestjs", "m")}
    assert found == want
