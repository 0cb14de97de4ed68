"""Vectors as arrays of numbers (V1-V5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero or missing."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def dimension_status(vector: Column, dimension: int) -> Column:
    """``missing, empty, invalid_shape, ok`` (V4, V5)."""
    return F.when(vector.isNull(), "missing").when(F.size(vector) == 0, "empty").when(F.size(vector) != dimension, "invalid_shape").otherwise("ok")
