"""The registered queries of this package. Each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import blockjoin, digest, linededup, minhash, mixing, packing, quality, resampling, sharding, topk, trie, url_terms, urls, warc
from glyphmill.llm.common import table

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.impact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = urls.vocabulary(url_terms.table(spark))
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, terms=terms).select("page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_next(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_hash")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_blockjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockjoin.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def _rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of c - c % 5 in place of its own first h, h = crc32(c) % 9. turns: numbered."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = turns.where(F.col("pos") > h).select("conv_id", F.col("pos").alias("turn"), "digest", "n_bytes")
    near = F.explode(F.array(*[F.try_add(F.col("conv_id"), F.lit(i).cast("long")) for i in range(-4, 5)]))
    heads = turns.where("conv_id % 5 = 0 AND pos <= 8").select(F.col("conv_id").alias("base"), near.alias("conv_id"), F.col("pos").alias("turn"), "digest", "n_bytes")
    heads = heads.where(F.col("conv_id") - F.col("conv_id") % 5 == F.col("base")).where(F.col("turn") <= h).drop("base")
    return own.unionByName(heads.join(turns.select("conv_id").distinct(), "conv_id", "left_semi"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(trie.digested(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(_rebuilt(turns), turns.select("conv_id"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_topk, op2_line_dedup, op3_url_filter, op4_quality, op5_fingerprint, op6_mix, op7_minhash, op8_warc, op9_sharding, op10_packing, op11_blockjoin, op12_prefix_trie, op13_resampling)}
