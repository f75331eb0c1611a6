"""What the operators share: where intermediate tables go, and how they are read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-glyphmill-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder once and read back, so that a lost executor costs a reread only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python TEXT_ROWS at a time, where it isn't set to fewer: a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def unused(taken: Iterable[str], names: Iterable[str]) -> list[str]:
    """The names, with underscores before them where a column is called so already."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """Python values; unlike pandas, Arrow keeps a long beside a null exact."""
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batch_of(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


FIRST, LAST = 1, 2


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str], name: str) -> DataFrame:
    """The long columns `sums` become running sums, the row's own value included, over the rows of equal keys in the given order.

    keys: columns without nulls; without any, all rows are one run. Rows are sorted over ranges of keys and order, so that one key may fill many ranges. Each range
    sums on its own; with what its first key begins is carried from the ranges before it, for which two rows of each
    range reach the driver. The result is a written table.
    """
    part, edge = unused(rows.columns, ["part", "edge"])
    schema = StructType([*rows.schema.fields, StructField(part, IntegerType()), StructField(edge, IntegerType())])
    head = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, edges, before, total = TaskContext.get().partitionId(), None, None, None, np.zeros((len(sums), 1), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                column = batch.column(head.index(k))
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(head.index(k))[0] for k in keys)
            new[0] = first != before
            so_far = np.cumsum(np.stack([batch.column(head.index(s)).to_numpy(zero_copy_only=False) for s in sums]), axis=1, dtype=np.int64)
            starts = np.flatnonzero(new)
            base = np.concatenate([-total, np.where(starts > 0, so_far[:, starts - 1], 0)], axis=1)
            so_far -= base[:, np.cumsum(new)]
            before, total = tuple(batch.column(head.index(k))[n - 1] for k in keys), so_far[:, -1:].copy()
            arrays = [pa.array(so_far[sums.index(c)]) if c in sums else batch.column(i) for i, c in enumerate(head)]
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(edges), own, dtype=np.int32)), pa.array(edges)], names=[*head, part, edge])
            edges = np.zeros(n, dtype=np.int32)
            edges[0] += FIRST * (held is None)
            held = arrays
        if held is not None:
            edges[-1] += LAST
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(len(edges), own, dtype=np.int32)), pa.array(edges)], names=[*head, part, edge])

    by = [*map(F.col, keys), *order]
    found = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), name)
    ends: dict[int, dict[int, tuple]] = {}
    for r in found.where(F.col(edge) > 0).select(part, edge, *keys, *sums).collect():
        for side in (FIRST, LAST):
            if r[1] & side:
                ends.setdefault(r[0], {})[side] = (tuple(r[2 : 2 + len(keys)]), r[2 + len(keys) :])
    carried, before, total = [], None, [0] * len(sums)
    for p in sorted(ends):
        (first, _), (last, own) = ends[p][FIRST], ends[p][LAST]
        add = total if first == before else [0] * len(sums)
        if any(add):
            carried.append((p, *first, *add))
        before, total = last, [x + y * (last == first) for x, y in zip(own, add, strict=True)]
    if carried:
        there, extra = unused(found.columns, [f"k{i}" for i in range(len(keys))]), unused(found.columns, [f"s{i}" for i in range(len(sums))])
        at = "in_part"
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        shape = StructType([StructField(at, IntegerType()), *[StructField(t, kinds[k]) for t, k in zip(there, keys, strict=True)], *[StructField(e, LongType()) for e in extra]])
        carry = F.broadcast(rows.sparkSession.createDataFrame(carried, shape).withColumnRenamed(at, f"{part}_at"))
        on = F.col(part) == F.col(f"{part}_at")
        for t, k in zip(there, keys, strict=True):
            on = on & (F.col(t) == F.col(k))
        found = found.join(carry, on, "left").withColumns({s: F.col(s) + F.coalesce(F.col(e), F.lit(0)) for s, e in zip(sums, extra, strict=True)})
    return found.select(*head)


#: A key with 1/HEAVY_PARTS of all rows is heavy, so that there are at most so many; below LEAST_HEAVY rows none is.
HEAVY_PARTS, LEAST_HEAVY = 1024, 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """rows join facts, of which there is one for a key. sizes: (key, n), the rows of each key. Heavy keys' facts are broadcast, the others meet by a shuffle."""
    limit = max(LEAST_HEAVY, (sizes.agg(F.sum("n")).first()[0] or 0) / HEAVY_PARTS)
    heavy = [r[0] for r in sizes.where(F.col("n") > limit).select(key).collect()]
    if not heavy:
        return rows.join(facts, key, how)
    kind = rows.schema[key]
    hot = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in heavy], StructType([kind])))
    light = rows.join(hot, key, "left_anti").join(facts, key, how)
    return light.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how))
