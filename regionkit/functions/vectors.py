"""Vector arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """v over its length, which counts as at least 1e-12; a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 if either side has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def project(v: Column | str, matrix: Sequence[Sequence[float]]) -> Column:
    """Products of v with the rows of a small matrix, which goes into the plan as literals."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in matrix])
