"""Vector functions on arrays of floats, accumulated as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Over the common prefix."""
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)


def cosine(x: Column, y: Column) -> Column:
    n = F.least(F.size(x), F.size(y))
    a, b = F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cosine_distance(x: Column, y: Column) -> Column:
    return 1 - cosine(x, y)


def checked(x: Column, dim: int) -> Column:
    """x; fails unless it has `dim` finite numbers."""
    ok = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(ok, x).otherwise(F.raise_error(F.lit(f"a vector of {dim} finite numbers is needed")).cast("array<float>"))


def parse(literal: Column) -> Column:
    """`[a,b,c]` as an array; null for null."""
    return F.from_json(literal, "array<float>")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
