"""Vectors held as arrays, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the shorter vector's missing places count nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / product)


def unit(a: Column) -> Column:
    """The vector with length 1; a vector of no length stays."""
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def is_usable(a: Column, dimensions: int) -> Column:
    """`dimensions` finite numbers, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dimensions) & finite & F.exists(a, lambda x: x != 0), F.lit(False))
