"""Vectors in columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(v.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def score(cos: Column, metric: str) -> Column:
    """A cosine as the score of a metric."""
    if metric == "cosine":
        return cos
    if metric == "l2":
        return 1 / (1 + F.greatest(F.lit(0.0), 2 - 2 * cos))
    if metric == "inner_product":
        return F.greatest(F.lit(0.0), (cos + 1) / 2)
    raise ValueError(f"unknown metric {metric!r}")


def sign_hash(v: Column) -> Column:
    """64 signs of a vector as the bits of a long."""
    bits = F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean_absolute_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
