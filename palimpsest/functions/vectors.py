"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the lengths differ, so such rows can be dropped instead of sorting first as NaN."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")
