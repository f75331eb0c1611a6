"""Answers put together from several operators, against their SQL and small cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphmill.plans import composed, explore
from glyphmill.streaming import events

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
NAMES = [
    "scan_repo_registry", "search_across_repos", "search_linked_routes", "topk_explored_slot", "join_decision_overlaps", "graph_node_surroundings", "graph_blast_sections",
    "filter_plan_fields", "topk_section_lists", "vector_memory_sections", "stream_repeats",
    "search_explore_ranked", "filter_graph_links", "fn_format_entries", "vector_embed_hashed", "graph_named_flow",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [*TABLES, "benchmark"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert found and found == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_some_slot_is_explored(spark):
    served = composed.explored_slot(spark, SF)
    assert served.where("explored").count() and served.groupBy("repo", "intent", "pattern").count().where("count > 1").isEmpty()


def test_surroundings(spark):
    e = spark.createDataFrame([
        ("f", "c", "contains"), ("c", "m", "contains"), ("m", "x", "contains"), ("m", "t", "returns"), ("m", "t", "type_of"), ("f", "i", "imports"), ("u", "m", "calls"), ("m", "gone", "calls"), ("m", "v", "calls"),
    ], "source string, target string, kind string")
    n = spark.createDataFrame([(i, "file" if i == "f" else "class") for i in "fcmxtiuv"], "id string, kind string")
    found = {tuple(r) for r in composed.node_surroundings(e, n, "m").collect()}
    assert found == {
        ("ancestor", "contains", "c"), ("ancestor", "contains", "f"), ("child", "contains", "x"), ("in", "calls", "u"), ("out", "calls", "v"), ("out", "returns", "t"), ("out", "type_of", "t"),
        ("type", "returns", "t"), ("type", "type_of", "t"), ("import", "imports", "i"),
    }


def test_terms(spark):
    terms = F.array(*[F.lit(x) for x in (" (Parser) ", "parser", "a", "b/c", "d e", "x" * 41, "Second", "third", None)])
    row = spark.range(1).select(composed.clean_terms(terms, "must"), composed.clean_terms(terms, "phrases")).first()
    assert list(row) == [["parser", "second"], ["(parser)", "parser", "b/c"]]


def test_topics_of_a_stream_are_those_of_the_batch(spark):
    batch = events.topic_clusters(spark, SF).select("label", "vec_id", "topic").collect()
    assert sorted(map(tuple, events.topics_stream(spark, SF).select("label", "vec_id", "topic").collect())) == sorted(map(tuple, batch))


def test_explored_gates(spark):
    """A test file goes where two others stay, a file of few points too; a named symbol's file comes first, then ranks count."""
    n = spark.createDataFrame([("a", "red", "x/a.py"), ("b", "blue", "x/b.py"), ("c", "red", "x/test_c.py"), ("d", "far", "x/d.py"), ("e", "red widget", "x/e.py")], "id string, name string, file_path string")
    e = spark.createDataFrame([("a", "b"), ("e", "b"), ("b", "d"), ("a", "c")], "source string, target string")
    entries = spark.createDataFrame([("a", False), ("e", True)], "id string, named boolean")
    rows = explore.explored(n, e, entries, ("red", "widget")).orderBy("place").select("file_path", "points", "hits").collect()
    # ranks by hand: a 0.286, b 0.321, c 0.107, d 0.080, e 0.205
    assert [tuple(r) for r in rows] == [("x/e.py", 50, 2), ("x/b.py", 3, 0), ("x/a.py", 10, 1)]


def test_links_of_a_plan(spark):
    links = spark.createDataFrame([("s", "t", "a.py", "x", "b.py"), ("u", "v", "brand.py", "x", "b.py"), ("u", "w", "a.py", "x", "b.py"), ("s", "m", "a.py", "mockery", "b.py")], "source string, target string, from_path string, name string, path string")
    seeds = spark.createDataFrame([("s",)], "id string")
    kept = lambda must, exclude: sorted(r["target"] for r in explore.kept_links(links, seeds, must, exclude).collect())
    assert kept(("brand",), ("mock",)) == ["t", "v"] and kept((), ()) == ["m", "t", "v", "w"]


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "node graph node"), (2, ""), (3, None), (4, "Graph, NODE node")], "k int, text string")
    found = {}
    for r in explore.hashed_vectors(rows, "k", "text").collect():
        found.setdefault(r["k"], {})[r["dim"]] = r["x"]
    assert set(found) == {1, 4} and found[1] == found[4] and abs(sum(x * x for x in found[1].values()) - 1) < 1e-5
