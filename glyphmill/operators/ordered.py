"""Work in an order, without a task for a key or for a whole table: rows lie in ranges, and what one range needs of those before it is carried over.

Only counts and the last few rows of each range reach the driver, so that what it holds follows the number of ranges alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.storage import materialised

_PART, _CONTEXT = "_range", "_context"


def _ranged(rows: DataFrame, by: Sequence[str], ranges: int | None) -> DataFrame:
    """Rows with the number of the range that they lie in; ranges ascend with the columns `by`."""
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return materialised(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with their place, from 1, in ascending order of columns (nulls first). Rows alike in all of them have their places in any order."""
    ranged = _ranged(rows, order, ranges)
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy(_PART).count().collect()):
        starts.append((part, before))
        before += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{_PART} int, _start long"))
    place = F.row_number().over(Window.partitionBy(_PART).orderBy(*order)) + F.col("_start")
    return ranged.join(start, _PART).withColumn(name, place).drop(_PART, "_start")


def over_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, ranges: int | None = None, **results) -> DataFrame:
    """rows with results over the n rows before each, of the same keys and in ascending order of columns: name=function of a window that gives a column.

    A range begins with copies of the last n rows before it of its first key, which may come from several ranges. Rows with equal keys and order lie in any order among
    themselves. Keys may hold nulls; these are one key.
    """
    ranged = _ranged(rows, [*keys, *order], ranges)
    spark, own = rows.sparkSession, ranged.schema
    of_key = F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])
    edges = ranged.groupBy(_PART).agg(F.min(of_key).alias("first"), F.max(of_key).alias("last"))
    at = {r[_PART]: (tuple(r["first"]), tuple(r["last"])) for r in edges.collect()}
    tail = Window.partitionBy(_PART).orderBy(*[F.desc_nulls_last(c) for c in [*keys, *order]])
    last = ranged.withColumn("_nth", F.row_number().over(tail)).where(F.col("_nth") <= n).drop("_nth")
    tails: dict[int, list] = {}
    for r in last.collect():
        tails.setdefault(r[_PART], []).append(r)
    nulls_first = lambda r: [(r[c] is not None, r[c]) for c in order]
    context, before = [], []
    for part in sorted(at):
        first, final = at[part]
        before = [r for r in before if tuple([0, *(r[k] for k in keys)]) == first]
        context += [tuple([*(r[c] for c in own.names if c != _PART), part]) for r in before]
        mine = sorted((r for r in tails[part] if tuple([0, *(r[k] for k in keys)]) == final), key=nulls_first)
        before = [*(before if first == final else []), *mine][-n:]
    marked = ranged.withColumn(_CONTEXT, F.lit(False))
    if context:
        marked = marked.unionByName(spark.createDataFrame(context, own).withColumn(_CONTEXT, F.lit(True)))
    window = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(-n, -1)
    told: dict[str, Column] = {name: f(window) for name, f in results.items()}
    return marked.withColumns(told).where(~F.col(_CONTEXT)).drop(_CONTEXT, _PART)
