"""Exact top-k inner-product search over an impact-ordered index, processed score at a time.

Vectors are dealt into blocks of bounded size, and queries into blocks of their own; each pair of blocks is
one group. In a group, every dimension is cut into posting segments by quantised impact. A query visits the segments of
all dimensions in descending order of the gain that they can add and stops once it is proved that few rows
can still be among the k best; those rows are rescored exactly. The k best of each block then meet per query.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import written

LEVELS = 8
#: A proof is looked for after so many segments, and then each time that a quarter more have been read.
FIRST_CHECK = 32
#: Rows whose squared length, scaled, is below this have scores that fit a long; others are scored in Python integers.
SHORT = float(2**62)


class ImpactIndex:
    """Posting segments of one block: for each dimension, rows grouped by quantised component."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        dims, lows, highs, self.rows = [], [], [], []
        for j in range(vectors.shape[1]):
            column = vectors[:, j]
            order = np.argsort(column, kind="stable")
            for part in np.array_split(order, min(levels, len(order))):
                dims.append(j)
                lows.append(column[part[0]])
                highs.append(column[part[-1]])
                self.rows.append(part)
        self.dims, self.lows, self.highs = np.array(dims, dtype=np.int64), np.array(lows, dtype=np.int64), np.array(highs, dtype=np.int64)

    def possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best of this block; every other row is proved to score less than k others."""
        n, width = self.vectors.shape
        if n <= 4 * k or not width:
            return np.arange(n)
        weight = query[self.dims]
        bound = np.where(weight >= 0, weight * self.highs, weight * self.lows)
        per_dim = bound.reshape(width, -1)
        floor = per_dim.min(axis=1)
        gain = bound - floor[self.dims]
        order = np.argsort(-gain, kind="stable")
        total = np.full(n, floor.sum(), dtype=np.int64)
        left = gain.reshape(width, -1).copy()
        flat = left.reshape(-1)
        enough, due = max(4 * k, n // 32), FIRST_CHECK
        for i, s in enumerate(order, 1):
            total[self.rows[s]] += gain[s]
            flat[s] = 0
            if i == due:
                due += max(FIRST_CHECK, i // 4)
                best = np.argpartition(-total, k)[: 4 * k]
                least = np.partition(self.vectors[best] @ query, len(best) - k)[len(best) - k]
                can = np.flatnonzero(total + left.max(axis=1).sum() >= least)
                if len(can) <= enough:
                    return can
        best = np.argpartition(-total, k)[: 4 * k]
        least = np.partition(self.vectors[best] @ query, len(best) - k)[len(best) - k]
        return np.flatnonzero(total >= least)

    def search(self, query: np.ndarray, ids: np.ndarray, named: np.ndarray, rows: np.ndarray, own: int, k: int) -> list[tuple[int, bool, int]]:
        """(id, whether there is one, score) of the k best, without the query's own row."""
        can = self.possible(query, k + 1)  # the query's own row may take a place
        scores = self.vectors[can] @ query
        order = np.lexsort((ids[can], ~named[can], -scores))
        return [(int(ids[can[i]]), bool(named[can[i]]), int(scores[i])) for i in order[: k + 1] if rows[can[i]] != own][:k]


def _matrix(values: pd.Series, width: int, scale: int) -> np.ndarray:
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = np.floor(np.asarray(v, dtype=np.float64) * scale)
    return out


def _exact(vector: np.ndarray, scale: int) -> list[int]:
    """Components of any size as Python integers."""
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in map(float, vector)]


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, x array<double>, short boolean): rows that take part; row tells them apart."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    good = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    short = F.aggregate("x", F.lit(0.0), lambda a, e: a + (F.abs(e) * scale + 1) * (F.abs(e) * scale + 1)) < SHORT
    found = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return found.where("x is not null").where(good).withColumn("short", short)


def impact_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    block_rows: int = 8192,
    query_rows: int = 4096,
) -> DataFrame:
    """The k highest integer inner products of each query with all other rows, ties to the smaller id.

    is_query: a condition over the column `id`. Vectors that are null or hold a null or non-finite component take no part. A null id
    is a candidate like others, given back as null; ties put it last. Rows that repeat an id are rows of their own, as queries and as candidates: each query row has its own ranks, and only the row
    itself isn't among its candidates. Missing trailing components of a shorter vector count as 0; an empty vector scores 0. Very long
    vectors are scored in exact integers; an answer that doesn't fit a long raises an error. Other columns are ignored,
    whatever their names. An empty table gives no rows. Memory of a task: one block of each kind.
    Returns query_id long, rank int, vec_id long, score long.
    """
    taking = usable(vectors, id_col, vec_col, scale).withColumns({"asks": F.coalesce(is_query, F.lit(False)), "named": F.col("id").isNotNull()})
    rows = written(taking.withColumn("id", F.coalesce("id", F.lit(0))), "topk-vectors")
    queries = rows.where("asks")
    n, n_queries = rows.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))

    def deal(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.select(
            *[F.col(c).alias(c) for c in ("row", "id", "x", "short", "named")], F.pmod(F.xxhash64("row"), F.lit(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other),
        )

    left = deal(queries, "qb", query_blocks, "cb", blocks)
    right = deal(rows, "cb", blocks, "qb", query_blocks)

    def search(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(found):
            width = max(found["x"].map(len).max(), asked["x"].map(len).max())
            near, far = found[found["short"]], found[~found["short"]]
            index = ImpactIndex(_matrix(near["x"], width, scale)) if len(near) else None
            far_ints = [_exact(v, scale) for v in far["x"]]
            near_ints = [_exact(v, scale) for v in near["x"]] if not asked["short"].all() else []
            for row, own, x, short in zip(asked["row"], asked["id"], asked["x"], asked["short"], strict=True):
                hits = index.search(_matrix(pd.Series([x]), width, scale)[0], near["id"].to_numpy(), near["named"].to_numpy(dtype=bool), near["row"].to_numpy(), row, k) if short and index else []
                if far_ints or not short:
                    q = _exact(x, scale)
                    for rest, ints in ((far, far_ints), (near, [] if short else near_ints)):
                        hits += [(i, named, sum(map(operator.mul, q, v))) for r, i, named, v in zip(rest["row"], rest["id"], rest["named"], ints, strict=False) if r != row]
                    hits = sorted(hits, key=lambda h: (-h[2], not h[1], h[0]))[:k]
                if any(abs(score) >= 2**63 for _, _, score in hits):
                    raise ValueError(f"a score of vector {own} doesn't fit a long")
                out += [(row, own, *hit) for hit in hits]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "named", "score"]).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "named": "bool", "score": "int64"})

    hits = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(search, "row long, query_id long, vec_id long, named boolean, score long").withColumn("vec_id", F.when(F.col("named"), F.col("vec_id")))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
