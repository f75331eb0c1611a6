"""Candidates aren't copied for each block of queries, and a tile may have none that is near enough."""

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import blockjoin


def test_no_copy_for_each_block(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * i + i).cast("float") for i in range(1, 5)]).alias("embedding"))
    few, many = (blockjoin.nearest(df, F.col("id") % 3 == 0, k=4, query_rows=n, stripe_rows=100) for n in (1000, 10))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join Cross" in plan
    assert "CartesianProduct" in many._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, many.collect()))
    assert len(found) == 400 and found == sorted(map(tuple, few.collect()))


def test_tile_without_any_nearer():
    """Its bound lets the pair through, its product is below the floor by less than the bound's error."""
    best = blockjoin.Nearest(np.array([[0.3, 0.7]]), np.array([0]), 1)
    one = lambda x, row: best.meet(np.array([x]), np.array([row]), np.array([row]), np.array([True]))
    one([0.3, 0.7], 1)
    one([0.3, 0.6999999], 2)
    assert best.heaps[0][0][3] == -1
