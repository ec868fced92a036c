"""Vectors as arrays and maps: dot products and cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two unit maps: the sum over their common keys."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(keys, F.lit(0.0), lambda s, k: s + a[k] * b[k])
