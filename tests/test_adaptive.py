"""Plan filters, budgets, expiry and merged links against their SQL, and the filter conventions against known values."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphmill.plans import adaptive
from tests.test_queries import SF, duck, plain  # noqa: F401

NAMES = [
    "filter_memory_plan", "filter_memory_scope", "filter_call_chain", "agg_dashboard_summary", "agg_file_feedback", "sample_with_gold", "reward_pick_profile", "reward_topic_eviction",
    "reward_fp_expiry", "fn_widen_breadth", "fn_graph_proximity", "fn_explore_budget", "vector_staleness", "vector_false_positives", "resolve_field_channels", "resolve_merge_links",
]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):  # noqa: F811
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(__spark_entry__.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    want = sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert want and found == want


def test_exclude_conventions(spark):
    rows = [("a", "x/_test.go"), ("a", "x/y_test.go"), ("TestA", "x"), ("a", "tests/x"), ("mockA", "x"), ("a", "x/mocks/y"), ("a", "x/testdata/y"), ("a", "x/fixtures/y"), (None, None)]
    df = spark.createDataFrame(rows, "name string, path string").coalesce(1)
    columns = {"name": F.col("name"), "path": F.col("path")}
    hit = lambda *e, **k: [r[0] for r in df.select(adaptive.by_convention(columns | k, e)).collect()]
    assert hit(" Test ") == [True, True, True, True, False, False, False, False, False]
    assert hit("mock") == [False, False, False, False, True, True, False, False, False]
    assert hit("fixture") == [False] * 7 + [True, False]
    assert hit("fixture", **{"target path": F.col("path")}) == [False] * 6 + [True, True, False]
    assert hit("other") == [False] * 9
