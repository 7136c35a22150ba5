"""Vector arithmetic on ``array<float>`` columns in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has zero length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def unit(a: Column) -> Column:
    """Vector scaled to length one (null for the zero vector)."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length).cast("float")))
