"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector, and for lengths that differ."""
    scale = norm(a) * norm(b)
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0) | (scale == 0)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / scale)


def normalised(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(_d(a), lambda x: x / n)
