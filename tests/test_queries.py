"""A choice of registered queries against their SQL in DuckDB, and expressions against known values."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphmill.functions import score, text, vector
from glyphmill.operators import graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "search_idf_name", "search_bm25_nodes", "search_by_path_tiers", "join_feedback_asof", "join_repeat_detection", "join_set_containment", "join_dead_code", "join_path_overlap",
    "agg_node_metrics", "agg_pattern_stats", "agg_auto_anchor", "window_top_per_name", "reward_stats", "reward_three_strikes", "reward_history_hourly", "vector_knn_per_type",
    "resolve_import_mappings", "resolve_import_paths", "resolve_chain_calls", "context_field_query", "scan_strip_comments", "scan_prefixed_routes", "scan_embedded_blocks",
    "filter_test_files", "filter_low_value_files", "filter_siblings", "join_tag_repo_score", "topk_link_order", "set_append_distinct", "fn_intent_class", "fn_effective_query", "fn_model_hint", "fn_query_words",
    "vector_mean_pool", "reward_profile_deltas", "reward_profile_shrink", "resolve_overrides", "resolve_event_channels", "vector_populate_guard", "graph_affected_tests", "search_bm25_documents", "graph_components", "graph_pagerank",
    "filter_unresolvable_refs", "resolve_package_names", "resolve_qualified_names", "resolve_method_calls", "resolve_name_tiers", "resolve_case_free", "resolve_cascade", "resolve_second_pass", "scan_payload_documents", "stream_feedback",
    "graph_call_chain_build", "join_cross_wire", "vector_primary_context",
    "graph_bfs", "graph_shortest_path", "graph_cycles", "resolve_best_match", "fn_path_proximity", "eval_recall_mrr",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    assert found, "a query without rows tests nothing"
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_manifest_top_file(spark):
    """The smallest tables have no manifest of three entries; the next ones do."""
    larger = SF.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{larger}/{t}.parquet')")
    rows = con.sql(__spark_entry__.oracle_sql()["agg_manifest_top_file"]).fetchall()
    found = __spark_entry__.queries()["agg_manifest_top_file"](spark, larger).select("host", "file", "n", "entries").collect()
    assert rows and sorted(map(tuple, found)) == sorted(rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rewards(spark):
    raw = score.raw_reward(F.lit(2), F.lit(5000), F.lit(1), F.lit(0))
    assert one(spark, F.round(raw, 6))[0] == 0.55
    assert list(one(spark, *[score.implicit_reward(F.lit(x)) for x in (0.96, 0.95, 0.70)])) == [0.0, 0.4, None]
    assert list(one(spark, *[F.round(score.fp_penalty(F.lit(x), F.lit(n)), 6) for x, n in ((0.69, 9), (0.8, 3), (0.8, 1))])) == [0.0, 0.16, 0.053333]


def test_text(spark):
    row = one(spark, text.split_symbol(F.lit("parseHTTPHeader_v2.next")), text.light_stem(F.lit("callings")), text.topic_label(F.lit("The fast parser of the fast nodes here")), text.normal_path(F.lit(" /Src/A.go:12 ")), text.intent(F.lit("why does it crash in this call")), text.safe_key(F.lit("a: /b")))
    assert list(row) == [["parse", "http", "header", "v2", "next"], "cal", "fast-parser-nodes", "src/a.go", "debug", "a___b"]
    assert one(spark, text.language_of(F.lit("x/y.tsx")), text.base_name(F.lit("x/y.tsx")), text.dir_name(F.lit("x/y.tsx")))[:] == ("tsx", "y.tsx", "x")


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(e)) for e in x])
    assert list(one(spark, vector.cosine(v(1, 0), v(2, 0)), vector.cosine(v(0, 0), v(1, 0)), vector.cosine(v(1), v(1, 0)))) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("path, test, low", [
    ("src/FooTest.java", True, True), ("src/latest.kt", False, True), ("src/manifest.go", False, False), ("a/test_x.py", True, True), ("a/x.spec.ts", True, True), ("a/x_spec.rb", True, True),
    ("commonTest/a.kt", True, False), ("contest/a.kt", False, False), ("specs/a.rb", True, False), ("a/testing/b.go", True, False), ("a/testlib/b.go", True, False), ("demo/a.ts", True, False),
    ("a/benchmarks/b.c", True, False), ("a/QuxTestCase.java", True, False), ("a/rpc.pb.go", False, True), ("mock_a.go", False, True), ("a/mock_a.go", False, False), ("a/b_mocks.go", False, True),
    ("a/AGrpc.java", False, True), ("vendor/a.go", False, False), ("dist/a.min.js", False, False),
])
def test_paths(spark, path, test, low):
    assert list(one(spark, score.is_test_path(F.lit(path)), score.is_low_value(F.lit(path)))) == [test, low]


def test_profiles(spark):
    knob = lambda k, i, m: score.shrunk_knob(k, score.profile_knob(k, F.lit(i)), F.lit(m))
    assert list(one(spark, knob("max_snippets", "debug", 0), knob("max_snippets", "general", 1), knob("max_snippets", "general", 3), knob("max_trace", "trace", 2), knob("caller_hops", "trace", 2), knob("max_siblings", "explore", 0), knob("max_symbols", "explore", 3))) == [7, 2, 1, 3, 1, 25, 3]
    assert list(one(spark, score.kind_bonus(F.lit("enum")), score.kind_bonus(F.lit("other")))) == [5, 0]
    assert list(one(spark, *[text.intent(F.lit(q)) for q in ("nil pointer in parse", "How does it flow", "who calls it", "what is a node", "hello")])) == ["debug", "trace", "refactor", "explore", "general"]


def test_long_paths_and_cycles(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 60:02d}") for i in range(60)]
    bridge = [("r05", "s1"), ("s1", "s2"), ("s2", "s1"), ("p000", "r00"), ("s2", "t"), ("u", "u")]
    e = spark.createDataFrame(path[:8] + ring + bridge, "source string, target string")
    assert {r[0] for r in graph.cycle_members(e).collect()} == {s for s, _ in ring} | {"s1", "s2"}
    alone = spark.createDataFrame(path, "source string, target string")
    assert {tuple(r) for r in graph.components_of(alone).collect()} == {(f"p{i:03d}", "p000") for i in range(201)}


def test_graph_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert {(r[0], r[1]) for r in graph.reach(e, seed, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r[0] for r in graph.cycle_members(e).collect()} == {"a", "b", "c"}
    assert {(r[0], r[1]) for r in graph.components_of(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    ranks = {r[0]: r[1] for r in graph.personalised_pagerank(e, seed).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["a"] > ranks["d"] and ranks["x"] == 0
    assert graph.shortest_paths(e, F.lit("a"), 5).where("id = 'd'").first()["path"] == ["a", "b", "c", "d"]
