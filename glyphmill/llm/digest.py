"""Document fingerprints: a quartile bucket digest of hashed byte triplets, compared by a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, rows_of, small_batches, written

BUCKETS = 256
#: Offsets of the three bytes of a triplet in a window: wide, so that buckets follow the document more than its
#: language. Windows run on from the end of a text to its start, so that each byte begins one, whatever the length.
OFFSETS = (0, 5, 11)
#: Length classes grow by this factor; a difference of LENGTH_SPAN classes is as far as lengths can be apart.
LENGTH_STEP, LENGTH_SPAN, LENGTH_SHARE = 1.25, 24, 0.1


def digest(text: str | None) -> str:
    """Hex: two digits for the length class, two for each four bucket codes. Equal texts have equal digests."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    n = len(raw)
    if n:
        a, b, c = OFFSETS
        ring = np.resize(raw, n + c)
        h = (ring[a : a + n] * np.uint32(0x9E3779B1)) ^ (ring[b : b + n] * np.uint32(0x85EBCA77)) ^ (ring[c : c + n] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], dtype=np.uint8)
    length = 0 if not len(raw) else 1 + min(254, int(np.log(len(raw)) / np.log(LENGTH_STEP)))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return int(raw[0]), ((raw[1:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).reshape(-1).astype(np.int64)


def difference(a: str, b: str) -> float:
    """0 for equal digests, at most 1: the distance of bucket codes against that of unrelated texts with as many of
    each code, and the distance of the length classes."""
    if a == b:
        return 0.0
    (la, ca), (lb, cb) = _codes(a), _codes(b)
    pa, pb = np.bincount(ca, minlength=4) / len(ca), np.bincount(cb, minlength=4) / len(cb)
    expected = len(ca) * float(pa @ np.abs(np.subtract.outer(np.arange(4), np.arange(4))) @ pb)
    codes = min(1.0, float(np.abs(ca - cb).sum()) / expected) if expected else 0.0
    return (1 - LENGTH_SHARE) * codes + LENGTH_SHARE * min(1.0, abs(la - lb) / LENGTH_SPAN)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b)


def edited(text: str, following: str) -> str:
    """The last half of text replaced by the first as many code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ENDS = "part int, end int, end_id long, end_text string, end_mark string"


def _compared(doc_id, text: str, own: str, following: str, its: str) -> tuple:
    changed = edited(text, following)
    mark = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own, mark, likeness(own, mark), likeness(own, its)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row, in one pass without a shuffle. A null text counts as empty."""

    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(digest)

    return docs.select(F.col(id_col), F.pandas_udf(marked, "string")(F.coalesce(F.col(text_col), F.lit(""))).alias("fingerprint"))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, by descending id.

    The last document's next is the first; a single document is its own next. A null text is empty; very long texts are read
    whole. Rows of one id are ordered by a hash of the text, null ids come last; exact repeats are rows of their own, in the order
    of the input. Other columns are ignored, whatever their names, and an empty table gives no rows. Texts are shuffled once, into ranges of (id,
    hash, place in the input), so that one id can fill several; each range streams its rows, and only its first and
    last document, at most two for each partition, meet those of the neighbouring ranges.
    """
    small_batches(docs.sparkSession)
    order = [F.desc_nulls_last("doc_id"), F.desc("mark"), F.desc("place")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    ranged = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))

    walk_schema, out_schema = arrow_schema(f"{_OUT}, {_ENDS}"), arrow_schema(_OUT)
    no_out, no_end = (None,) * len(out_schema), (None,) * (len(walk_schema) - len(out_schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for batch in batches:
            out = []
            for doc_id, text, part in rows_of(batch):
                own = digest(text)
                out.append((*_compared(*last, text, own), *no_end) if last else (*no_out, part, 0, doc_id, text, own))
                last = (doc_id, text, own)
            yield batch_of(out, walk_schema)
        if last:
            yield batch_of([(*no_out, part, 1, *last)], walk_schema)

    walked = written(ranges.mapInArrow(walk, f"{_OUT}, {_ENDS}"), "digest-ranges")
    ends = walked.where("end is not null").select("part", "end", "end_id", "end_text", "end_mark")
    # two rows for each range at most: ranks of the ranges that have rows link the last of one to the first of the next
    ranks = ends.where("end = 0").select("part", F.row_number().over(Window.orderBy("part")).alias("rank"))
    n = F.broadcast(ranks.agg(F.max("rank").alias("n")))
    ranked = ends.join(F.broadcast(ranks), "part").crossJoin(n)
    firsts = ranked.where("end = 0").select(F.col("rank").alias("link"), F.col("end_text").alias("next_text"), F.col("end_mark").alias("next_mark"))
    lasts = ranked.where("end = 1").withColumn("link", F.col("rank") % F.col("n") + 1)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([_compared(*row) for row in rows_of(batch)], out_schema)

    seams = lasts.join(firsts, "link").select("end_id", "end_text", "end_mark", "next_text", "next_mark").mapInArrow(joined, _OUT)
    return walked.where("end is null").select(*out_schema.names).unionByName(seams)
