"""A corpus from raw documents: quality, line dedup, near-dedup, mix and packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import linededup, minhash, mixing, packing, quality
from glyphmill.llm.common import table, written

#: The rows depend on hashes, on a trained model and on a tokenizer; tests hold them against brute force instead.
ORACLE_SQL = None

#: A repeated line of so many words is a passage.
PASSAGE_WORDS = 50


def _carried(docs: DataFrame) -> DataFrame:
    """What the operators read, and beside it the other columns in one: whatever they are called, they come back as they were."""
    return docs.select("doc_id", "text", *[c for c in docs.columns if c == "source"], F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _restored(rows: DataFrame, columns: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    new = {"text": F.col("text")} | (new or {})
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels beside them, rejects go.

    A null or empty text, a null id and each repeated row has a score like any other; very long texts are read whole. A score of just
    0.7 stays. Columns stay as they are, whatever their names. An empty table gives none; without labels every score is 0.5, so that all go.
    """
    judged = quality.classify(_carried(docs), table(spark, sf_dir, "labels"))
    return _restored(judged.where("predicted = 1"), docs.columns)


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    return _restored(rows, columns, {"n_chars": F.length("text").cast("long")})


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents stay at their first place only.

    A null text becomes an empty one. The first place is the smallest id (null before all), then the least hash of the text, then position. Exact
    repeats of a row count as one document and keep the same lines. n_chars is counted anew, other columns stay as they are,
    whatever their names. Very long texts are cut like others. An empty table gives none.
    """
    return _with_text(linededup.dedup_lines(_carried(docs), min_docs=10, keep_first=True), docs.columns)


def passages(docs: DataFrame) -> DataFrame:
    """Lines of 50 or more words stay at their first place only, from the second document on."""
    bitmaps = written(linededup.keep_bitmaps(docs, min_docs=2, min_words=PASSAGE_WORDS, keep_first=True), "passages")
    return _with_text(linededup.with_kept_lines(_carried(docs), bitmaps), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five-word shingles, similarity of 0.8 or more.

    Rows with a null id and rows that share an id are judged like others, and of exact repeats of a row one stays. Ties for an id go to
    the least hash of the text. A null or empty text is near nothing. Very long texts are compared whole. Passages that the documents left still
    share go after that: taken out before, copies would leave fragments that no longer match. n_chars is counted anew, other
    columns stay as they are, whatever their names. An empty table gives none.
    """
    own = _carried(docs).withColumn("hash", minhash.text_hash(F.col("text"))).withColumn("key", F.xxhash64("doc_id", "hash"))
    near = minhash.near_duplicates(own, id_col="key").groupBy(F.col("doc_id").alias("key"), "component_id")
    rows = written(near.agg(F.count(F.lit(1)).alias("times")), "near-rows")
    members = rows.join(rows.where("component_id <> key").select("component_id").distinct(), "component_id", "left_semi").select("key", "component_id")
    named = own.select("key", "doc_id", "hash").join(members, "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "key")).alias("first"))
    gone = written(members.join(first.select("first.key"), "key", "left_anti").select("key"), "near-gone")
    left = own.join(gone, "key", "left_anti")
    repeated = written(rows.where("times > 1").select("key"), "near-repeated")
    once = left.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    kept = left.join(repeated, "key", "left_anti").unionByName(once)
    return passages(written(_restored(kept, docs.columns), "near-kept"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it, up to three times.

    Documents without words, null texts among them, aren't taken. Null ids and sources take part; exact repeats of a row are taken
    alike. Very long texts are taken whole or not at all. Columns stay as they are, whatever their names. An empty table gives none.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    mixed = mixing.mix(_carried(docs)).withColumn("times", times).where("times > 0")
    return _restored(mixed.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, see packing.pack: every token of every row lies in one piece.

    A null or empty text is its end token alone; null ids and repeated rows are packed like others, very long texts over several
    sequences. Other columns aren't read. An empty table gives none.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
