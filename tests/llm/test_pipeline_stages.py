"""The quality, mix and pack stages on nulls, empty texts, repeated rows, columns named like their own, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import quality

SF = "/root/testdata/sf0.01"
NAMES = "id string, size int, taken string, times int, nth string, row string, score string, held_out int, predicted string"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = spark.createDataFrame([(None, "a null id of a few words", "en", "s", 1), (7001, None, "en", None, 0), (7002, "", "en", "s", 0), (7003, " \n\t ", None, "s", 4), (7004, "word " * 30_000, "en", "s", 150_000)], own.schema)
    df = own.unionByName(more).unionByName(own.where("doc_id = 5")).unionByName(own.where("doc_id = 5"))
    return df.withColumns({n: F.lit("7").cast(kind) for n, kind in (c.split() for c in NAMES.split(", "))}).repartition(3)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_quality_stage(spark, docs):
    out = corpus_pipeline.quality_stage(spark, docs, SF)
    assert out.columns == docs.columns
    judged = quality.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert rows(out, "doc_id", "text") == rows(judged, "doc_id", "text") and {r["size"] for r in out.collect()} == {7}
    assert rows(out, "doc_id").count((5,)) in (0, 3)
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), SF).count() == 0


def test_mix_stage(spark, docs):
    out = corpus_pipeline.mix_stage(spark, docs, SF)
    assert out.columns == docs.columns and {r["taken"] for r in out.collect()} <= {"7"}
    known = {(r["doc_id"], r["text"]): r["n"] for r in docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in out.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).collect():
        assert (r["text"] or "").split() and r["n"] <= 3 * known[r["doc_id"], r["text"]]
    assert corpus_pipeline.mix_stage(spark, docs.limit(0), SF).count() == 0


def test_pack_stage(spark, docs):
    out = corpus_pipeline.pack_stage(spark, docs, SF).collect()
    whole = {}
    for r in out:
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert {k[0] for k in whole} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(k[1] == 1 and v == [(0, 1)] for k, v in whole.items() if k[0] in (7001, 7002))  # the end token alone
    assert sum(r["length"] for r in out if r["doc_id"] == 5) == 3 * next(k[1] for k in whole if k[0] == 5)
    places = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048
    # padding: sequences of a power of two have none, the others up to the next; in all under a twentieth of what is packed
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in places.values())
    assert padding < sum(places.values()) / 20
    assert corpus_pipeline.pack_stage(spark, docs.limit(0), SF).count() == 0
