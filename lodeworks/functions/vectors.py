"""Vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """A zero vector stays as it is."""
    length = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return let(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column, guard: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(guard))


def l2_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
