"""Vector columns: cosine as a JVM expression, and the rounding the scores are stored with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|), and 0 when either vector is all zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def round_score(score: Column, digits: int = 4) -> Column:
    """Scale, round half to even, unscale: float64 rounding as numpy does it."""
    scale = F.lit(float(10 ** digits))
    return F.rint(score * scale) / scale
