"""Places and rolling results over ranges against plain windows, one key with nearly all rows among them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.operators import graph, ordered


@pytest.mark.parametrize("n", [3, 50])
def test_one_hot_key_over_ranges(spark, n):
    """200,000 rows of one key, and a few of others, over eight ranges."""
    rows = spark.range(200_400).select(F.when(F.col("id") % 501 == 0, F.col("id") % 7).otherwise(3).alias("key"), F.xxhash64("id").alias("at"), (F.col("id") % 1000).alias("v"))
    total = {"s": lambda w: F.sum("v").over(w), "c": lambda w: F.count("v").over(w)}
    found = ordered.over_previous(rows, ["key"], ["at"], n, ranges=8, **total)
    w = Window.partitionBy("key").orderBy("at").rowsBetween(-n, -1)
    want = rows.withColumns({k: f(w) for k, f in total.items()})
    assert found.columns == ["key", "at", "v", "s", "c"] and found.count() == 200_400 and found.exceptAll(want).isEmpty()
    places = ordered.numbered(rows.select("key", "at"), ["key", "at"], "place", ranges=8)
    assert places.exceptAll(rows.select("key", "at", F.row_number().over(Window.orderBy("key", "at")).cast("long").alias("place"))).isEmpty()


def test_short_ranges_nulls_and_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i if i % 5 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, at long, v long").withColumn("at", F.coalesce("at", F.lit(-1) - F.col("v")))
    listed = lambda w: F.collect_list("v").over(w)
    for ranges in (1, 13, 40):  # ranges shorter than the n rows that are looked back for
        found = ordered.over_previous(df, ["key"], ["at"], 6, ranges=ranges, before=listed)
        want = df.withColumn("before", listed(Window.partitionBy("key").orderBy("at").rowsBetween(-6, -1)))
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    none = df.limit(0)
    assert ordered.numbered(none, ["at"], "place").count() == 0 == ordered.over_previous(none, ["key"], ["at"], 3, before=listed).count()


def test_longest_flow(spark):
    e = spark.createDataFrame([("a", "x"), ("x", "b"), ("b", "y"), ("y", "z"), ("z", "c"), ("a", "b"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("q", "q"), (None, "a")], "source string, target string")
    named = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    chain = lambda *ids: [r["id"] for r in graph.longest_flow(e, named(*ids)).orderBy("place").collect()]
    assert chain("a", "b", "c") == [] and chain("q", "a") == []  # two unnamed before c; two symbols are no chain
    assert chain("a", "e") == ["e", "f", "a"] and chain("a", "b", "e") == ["b", "d", "e", "f", "a"]
    assert chain("a", "b", "d", "e", "f", None) == ["a", "b", "d", "e", "f"]
    assert chain("y", "c", "b") == ["b", "y", "z", "c"]
