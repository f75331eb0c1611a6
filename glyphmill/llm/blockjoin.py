"""Nearest neighbours by largest inner product, as a block matrix join.

Queries are dealt into blocks and candidates into stripes; each block meets each stripe in one task. Both are packed, so that a row is a block or a
piece of a stripe, and tasks read their stripe where it lies: no copy of the candidates is shuffled for a block. There, candidates
stream by in tiles: products of int8 codes give every inner product up to a proven error, pairs that can still be among
the k best are computed again in double precision, and a heap for each query keeps the best. The heaps of all
stripes are merged per query, again by heaps. Nothing is left to chance: what isn't computed again is proved to be further away.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, rows_of, written

#: Products of int8 codes over so many dimensions are exact in single precision: 127 * 127 * 1024 < 2^24.
EXACT_DIMS = 1024
#: Candidates of a tile, and queries that meet it at once.
TILE, QUERIES_AT_ONCE = 2048, 256
#: Bytes of a piece of a stripe; its vectors go to Python together with a block's. Bytes of a block's vectors in doubles.
PIECE_BYTES, BLOCK_BYTES = 1 << 22, 1 << 28


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles; missing trailing components are 0."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row; scaled first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, initial=0)
    unit = np.where(top > 0, top, 1)
    return top * np.sqrt(((x / unit[:, None]) ** 2).sum(axis=1))


class Codes:
    """Vectors as int8 codes times a scale of each row; `rest` is the length of what the codes leave out."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1, initial=0) / 127
        unit = np.where(self.scale > 0, self.scale, 1)
        self.codes = np.clip(np.rint(x / unit[:, None]), -127, 127).astype(np.int8)
        self.length, self.rest = lengths(x), lengths(x - self.scale[:, None] * self.codes)

    def part(self, at: slice) -> Codes:
        out = object.__new__(Codes)
        out.scale, out.codes, out.length, out.rest = self.scale[at], self.codes[at], self.length[at], self.rest[at]
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of codes."""
    cuts = range(0, a.shape[1], EXACT_DIMS)
    return sum(((a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T).astype(np.float64) for i in cuts), np.zeros((len(a), len(b))))


def bounds(a: Codes, b: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error): the inner product in double precision lies within error of the estimate.

    |xy - x'y'| <= |x||y - y'| + |x - x'||y'|, and |y'| <= |y| + |y - y'|; what rounding adds on both sides is below the last term.
    """
    slack = (a.codes.shape[1] + 16) * 2.0**-50
    near = products(a.codes, b.codes) * a.scale[:, None] * b.scale
    return near, a.length[:, None] * (b.rest + slack * b.length) + a.rest[:, None] * (b.length + b.rest) + 1e-300


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last; what isn't a number counts as minus infinity."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return np.where(np.isnan(out), -np.inf, out)


class Nearest:
    """The k best of each query of a block so far: heaps of (score, has an id, -id, -row), the worst on top."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, k: int):
        self.x, self.rows, self.k, self.codes = x, rows, k, Codes(x)
        self.heaps: list[list[tuple]] = [[] for _ in rows]
        self.floor = np.full(len(rows), -np.inf)

    def meet(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        """One tile of candidates. named: whether there is an id."""
        codes = Codes(x)
        for i in range(0, len(self.rows), QUERIES_AT_ONCE):
            at = slice(i, i + QUERIES_AT_ONCE)
            near, error = bounds(self.codes.part(at), codes)
            floor = self.floor[at]
            if len(x) > self.k and np.isinf(floor).any():  # the query's own row may be among the k + 1
                low = np.nan_to_num(near - error, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                floor = np.maximum(floor, np.partition(low, len(x) - self.k - 1, axis=1)[:, len(x) - self.k - 1])
            q, c = np.nonzero(~(near + error < floor[:, None]))
            q += i
            for a in range(0, len(q), 1 << 18):
                self._exact(q[a : a + (1 << 18)], c[a : a + (1 << 18)], x, rows, ids, named)

    def _exact(self, q: np.ndarray, c: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        score = inner(self.x[q], x[c])
        good = (self.rows[q] != rows[c]) & (score >= self.floor[q])
        q, c, score = q[good], c[good], score[good]
        order = np.lexsort((rows[c], ids[c], ~named[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        if not len(q):  # all were further away than their bounds told
            return
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(q)], strict=True):
            heap = self.heaps[q[a]]
            for j in range(a, min(b, a + self.k)):
                entry = (float(score[j]), bool(named[c[j]]), -int(ids[c[j]]), -int(rows[c[j]]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break
            if len(heap) == self.k:
                self.floor[q[a]] = heap[0][0]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, x): rows that take part; row tells them apart."""
    found = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    return found.where("x is not null").where(~F.exists("x", bad)).where(F.exists("x", lambda e: e != 0))


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema) as to:
        for b in batches:
            to.write_batch(b)
    return out.getvalue().to_pybytes()


def _unpacked(value: pa.BinaryScalar) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(value.as_buffer()))


_HITS = "row long, query_id long, vec_id long, score double, found long"


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    query_rows: int = 8192,
    stripe_rows: int = 1 << 22,
) -> DataFrame:
    """The k candidates with the largest inner product with each query, ties to the smaller vec_id, a null one last. The result is exact.

    is_query: a condition over the column `id`. All rows but the query's own are candidates. Vectors that are null, empty or zero, or hold a null or
    non-finite component, take no part. A null id is a candidate like others, given back as null. Rows that repeat an id are rows of their
    own: each query row has its own ranks, and only the row itself isn't among its candidates. Missing trailing components of a shorter vector
    count as 0. A product that overflows a double is infinite, and one that isn't a number counts as minus infinity. Other columns are
    ignored, whatever their names. An empty table gives no rows. Memory of a task: a block of queries, a batch of candidates and k entries for each query.
    Returns query_id long, rank int, vec_id long, score double.
    """
    rows = written(usable(vectors, id_col, vec_col), "blockjoin-vectors")
    asks = F.coalesce(is_query, F.lit(False))
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if(asks), F.max(F.size("x"))).first()
    blocks = max(1, math.ceil(n_queries / query_rows), math.ceil(n_queries * 8 * (width or 0) / BLOCK_BYTES))
    # a task's memory doesn't follow its stripe: few stripes give few heaps to merge, as long as there is work for every core
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, math.ceil(n / stripe_rows), min(math.ceil(cores / blocks), math.ceil(n / TILE)))
    dealt = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    shape = rows.select("row", "id", "x").schema

    def of(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(batches)
        ids, xs = t.column("id"), [matrix(c, width) for c in t.column("x").chunks]
        return np.concatenate(xs), t.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()

    def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[bytes]:
        """Rows as Arrow streams of about `most` bytes."""
        held, size = [], 0
        for batch in batches:
            step = max(1, most * batch.num_rows // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                held.append(batch.slice(i, step))
                size += held[-1].nbytes
                if size >= most:
                    yield _stream(held)
                    held, size = [], 0
        if held:
            yield _stream(held)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], {}
        for batch in batches:
            for b in batch.column("block").unique().to_pylist():
                held.setdefault(b, []).append(batch.filter(pc.equal(batch.column("block"), b)).select(shape.names))
        for b in held:
            own.append((b, _stream(held[b])))
        yield batch_of(own, arrow_schema("block int, queries binary"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in packed((b.select(shape.names) for b in batches), PIECE_BYTES):
            yield batch_of([(p,)], arrow_schema("offered binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_HITS)
        blocks_here: dict[int, tuple[Nearest, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("block")[i].as_py()
                if own not in blocks_here:
                    x, row, ids, named = of(_unpacked(batch.column("queries")[i]))
                    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                        blocks_here[own] = Nearest(x, row, k), ids, named
                for piece in _unpacked(batch.column("offered")[i]):
                    for a in range(0, piece.num_rows, TILE):
                        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                            blocks_here[own][0].meet(*of([piece.slice(a, TILE)]))
        for best, ids, named in blocks_here.values():
            for i in range(0, len(ids), 512):
                yield batch_of([(int(best.rows[j]), int(ids[j]) if named[j] else None, -h[2] if h[1] else None, h[0], -h[3]) for j in range(i, min(i + 512, len(ids))) for h in best.heaps[j]], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = arrow_schema("query_id long, rank int, vec_id long, score double")
        row, own, heap, out = None, None, [], []

        def told() -> list[tuple]:
            return [(own, i, -h[2] if h[1] else None, h[0]) for i, h in enumerate(sorted(heap, reverse=True), 1)]

        for batch in batches:
            for r, query, vec, score, found in rows_of(batch):
                if r != row:
                    out += told()
                    row, own, heap = r, query, []
                entry = (score, vec is not None, -(vec or 0), -found)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(out) > 10_000:
                yield batch_of(out, ranked)
                out = []
        yield batch_of(out + told(), ranked)

    # a block is one partition, which a task holds; of the stripe that meets it, a piece at a time
    asked = rows.where(asks).withColumn("block", dealt(blocks)).repartitionById(blocks, F.col("block")).mapInArrow(blocked, "block int, queries binary")
    asked = written(asked, "blockjoin-queries").repartitionById(blocks, F.col("block"))
    offered = written(rows.repartition(stripes, "row").mapInArrow(pieces, "offered binary"), "blockjoin-pieces").repartition(stripes)
    met = offered.hint("shuffle_replicate_nl").crossJoin(asked)
    hits = met.mapInArrow(search, _HITS)
    return hits.repartition("row").sortWithinPartitions("row").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
