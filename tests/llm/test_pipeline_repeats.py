"""Rows ingested twice, null ids and rows that share an id, in the near stage."""

import random

import corpus_pipeline as p
from pyspark.sql import functions as F


def test_one_of_each_group_of_copies_stays(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, d, e, f = (words(40) for _ in range(6))
    rows = [
        (5, a), (5, a), (5, a), (7, a), (None, a), (None, a.upper()),  # repeats beside a copy and null ids: one of id 5
        (None, b), (None, b), (None, b + " end"),  # null ids only
        (8, c), (8, d), (8, d), (9, d),  # different texts of one id
        (3, e + " end"), (2, e), (None, e + " more"),  # near copies: the smallest id
        (4, f), (None, None), (None, None), (10, ""), (10, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(4)
    found = [(r["doc_id"], r["text"]) for r in p.near_stage(spark, docs, "").collect()]
    rest = [x for x in found if x[0] is not None or x[1] not in (b, b + " end")]
    assert len(found) == len(rest) + 1
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(rest, key=key) == sorted([(5, a), (8, c), (8, d), (2, e), (4, f), (10, ""), (None, "")], key=key)
    assert p.near_stage(spark, docs.limit(0), "").count() == 0
