"""Importance resampling towards a target distribution, drawn without replacement by noisy scores.

Documents and target texts are counted into hashed buckets of word runs; an array of gains, one for each bucket, scores a document
by adding up. The k best scores are found by a distributed quickselect: random pivot keys, exact counts of what lies before,
at and after each, until a pivot is the k-th composite key. Only the winners are sorted, over ranges, and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, rows_of, running_sums, small_batches, written

#: Letters and digits of ASCII, after lower-casing, and all else beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Pivots of a round.
PIVOTS = 16
#: Words and runs whose buckets a worker remembers.
MEMORY = 200_000


class _Buckets(dict):
    """Buckets of features; the memory of a worker stays bounded."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.n
        return b


def features(text: str | None, buckets: _Buckets, longest: int) -> tuple[int, np.ndarray]:
    """(words, the bucket of each run of 1 to `longest` consecutive words)."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # on bytes, only A-Z change
    out = [buckets[w] for w in words]
    for n in range(2, longest + 1):
        out += [buckets[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(out, dtype=np.int64)


def bucket_counts(texts: DataFrame, text_col: str, n_buckets: int, longest: int) -> np.ndarray:
    """Features of each bucket over all texts; one array of n_buckets reaches the driver."""
    kind = "bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = _Buckets(n_buckets), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for (text,) in rows_of(batch):
                total += np.bincount(features(text, buckets, longest)[1], minlength=n_buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], schema=arrow_schema(kind))

    out = np.zeros(n_buckets, dtype=np.int64)
    for b, n in texts.select(text_col).mapInArrow(count, kind).groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) / (T + n)) / ((s + 1) / (S + n)))) of each bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], dtype=np.int64)


_SCORED = "row long, doc_id long, n_features long, n_words long, weight long"


def weighed(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, longest: int) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(len(gain))
        for batch in batches:
            out = []
            for row, doc, text in rows_of(batch):
                n_words, own = features(text, buckets, longest)
                out.append((row, doc, len(own), n_words, int(gain[own].sum())))
            yield batch_of(out, arrow_schema(_SCORED))

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weigh, _SCORED)


def noise(seed: int, doc_id: Column) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256("<seed>:<doc_id>"); a null id as an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: The composite key: the highest score first, then the smallest id, a null one last; rows alike in both by their features and their place.
KEY = (("score", -1), ("nameless", 1), ("doc_id", 1), ("n_features", 1), ("row", 1))


def _before(key: tuple) -> Column:
    """Rows whose composite key lies before the given one."""
    out = F.lit(False)
    for (name, sign), value in reversed([*zip(KEY, key, strict=True)]):
        column = F.col(name)
        less = column > value if sign < 0 else column < value
        out = less | ((column == value) & out)
    return out


def _at(key: tuple) -> Column:
    out = F.lit(True)
    for (name, _), value in zip(KEY, key, strict=True):
        out = out & (F.col(name) == value)
    return out


def kth_key(keys: DataFrame, k: int, seed: int) -> tuple | None:
    """The k-th composite key, from 1. keys: a written table of the columns of KEY without nulls. Each round reads what is left of it between two pivots."""
    names = [n for n, _ in KEY]
    order = lambda key: tuple(v * sign for v, (_, sign) in zip(key, KEY, strict=True))
    left, skipped, turn = keys, 0, 0
    while k > 0:
        drawn = left.select(names).orderBy(F.xxhash64(F.lit(seed), F.lit(turn), "row"), "row").limit(PIVOTS).collect()
        if not drawn:
            return None
        pivots = sorted({tuple(r) for r in drawn}, key=order)
        counts = left.agg(*[c for p in pivots for c in (F.count_if(_before(p)), F.count_if(_at(p)))]).first()
        low, high = None, None
        for p, before, same in zip(pivots, counts[::2], counts[1::2], strict=True):
            if skipped + before >= k:
                high = p
                break
            if skipped + before + same >= k:
                return p
            low, below = p, before + same
        bounds = F.lit(True) if high is None else _before(high)
        if low is not None:
            bounds = bounds & ~_before(low) & ~_at(low)
            skipped += below
        elif high is None:
            return None
        left, turn = left.where(bounds), turn + 1
    return None


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    n_buckets: int = 10_000,
    longest: int = 1,
    seed: int = 2024,
    percent: int = 10,
    min_words: int = 20,
) -> DataFrame:
    """For each row: doc_id, n_features, weight, score, rank, n_words, all long; rank 1, 2, 3 ... of those drawn, null for others.

    Of the N rows with at least min_words words, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller id, a null id last, then to fewer
    features; rows alike in all these are drawn in any order, so that the rows returned agree from run to run. A null text has no words and weight 0; a null id's noise is that of
    an empty id. Very long texts are read whole. Without target texts, gains come from the documents alone. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, n_buckets, longest), bucket_counts(target, target_text_col, n_buckets, longest))
    scored = weighed(docs, id_col, text_col, gain, longest).withColumn("score", (F.col("weight") + noise(seed, F.col("doc_id"))).cast("long"))
    rows = written(scored, "resampling-scores").withColumn("nameless", F.col("doc_id").isNull().cast("int"))
    can = F.col("n_words") >= min_words
    k = percent * rows.where(can).count() // 100
    keys = rows.where(can).select(*[n for n, _ in KEY]).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    last = kth_key(keys, k, seed)
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*out)
    plain = rows.withColumns({"id": F.col("doc_id"), "doc_id": F.coalesce("doc_id", F.lit(0))})
    won = can & (_before(last) | _at(last))
    order = [F.desc("score"), F.col("nameless"), F.col("doc_id"), F.col("n_features"), F.col("row")]
    ranked = running_sums(plain.where(won).withColumn("rank", F.lit(1).cast("long")), [], order, ["rank"], "resampling-winners")
    every = ranked.unionByName(plain.where(~won).withColumn("rank", F.lit(None).cast("long")))
    return every.withColumn("doc_id", F.col("id")).select(*out)
