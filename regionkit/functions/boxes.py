"""Axis-aligned boxes: corners, soft intersections, volumes in log space.

Corners are arrays lo and hi. Widths of an intersection are soft: BETA * softplus(width / BETA), always above 0.
Corners and widths are rounded to float, as they are stored, and computed on as double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import total

#: Softness, floor of a width before its logarithm; and those of the trainable boxes.
BETA, FLOOR = 0.01, 1e-30
SOFT_BETA, SOFT_EPS, MIN_HALF = 0.1, 1e-6, 1e-3


def as_float(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float").cast("double"))


def lower(center: Column, half: Column) -> Column:
    return as_float(F.transform(center, lambda x: x - half))


def upper(center: Column, half: Column) -> Column:
    return as_float(F.transform(center, lambda x: x + half))


def middle(lo: Column, hi: Column) -> Column:
    return F.zip_with(lo, hi, lambda x, y: (x + y) / 2)


def half_width(lo: Column, hi: Column) -> Column:
    return F.zip_with(lo, hi, lambda x, y: (y - x) / 2)


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without loss for small values: x itself above 30, and never below its value at -50."""
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(F.greatest(x, F.lit(-50.0)))))


def overlap_lo(lo_a: Column, lo_b: Column) -> Column:
    return F.zip_with(lo_a, lo_b, lambda x, y: F.greatest(x, y))


def overlap_hi(hi_a: Column, hi_b: Column) -> Column:
    return F.zip_with(hi_a, hi_b, lambda x, y: F.least(x, y))


def soft_sides(lo: Column, hi: Column, beta: float = BETA) -> Column:
    """Expected widths of the box from lo to hi, which may be empty (lo above hi)."""
    if beta <= 0:
        raise ValueError(f"beta must be positive, not {beta}")
    return as_float(F.zip_with(lo, hi, lambda x, y: beta * softplus((y - x) / beta)))


def log_volume_of_sides(sides: Column, floor: float = FLOOR) -> Column:
    return total(F.transform(sides, lambda s: F.log(F.greatest(s, F.lit(floor)))))


def pair_log_volume(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, beta: float = BETA) -> Column:
    return log_volume_of_sides(soft_sides(overlap_lo(lo_a, lo_b), overlap_hi(hi_a, hi_b), beta))


def around(lo: Column, hi: Column, sides: Column) -> tuple[Column, Column]:
    """Corners of the box with these sides around the middle of lo and hi."""
    both = F.zip_with(middle(lo, hi), sides, lambda m, s: F.struct((m - s / 2).alias("a"), (m + s / 2).alias("b")))
    return as_float(F.transform(both, lambda x: x["a"])), as_float(F.transform(both, lambda x: x["b"]))


def box_log_volume(lo: Column, hi: Column) -> Column:
    """Sum of the logs of the sides; minus infinity if a side isn't positive."""
    sides = F.zip_with(lo, hi, lambda x, y: y - x)
    return F.when(F.exists(sides, lambda s: s <= 0), F.lit(float("-inf"))).otherwise(total(F.transform(sides, lambda s: F.log(s))))


def box_volume(lo: Column, hi: Column) -> Column:
    return F.exp(box_log_volume(lo, hi))


def contains(lo: Column, hi: Column, point: Column) -> Column:
    """Whether the point lies in the box, borders included."""
    at = F.zip_with(F.zip_with(lo, point, lambda x, p: x <= p), F.zip_with(hi, point, lambda y, p: p <= y), lambda x, y: x & y)
    return F.forall(at, lambda x: x)


def overlap_share(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Volume of the hard intersection over that of the union."""
    both = box_volume(overlap_lo(lo_a, lo_b), overlap_hi(hi_a, hi_b))
    return both / (box_volume(lo_a, hi_a) + box_volume(lo_b, hi_b) - both)


def half_extent(log_half: Column) -> Column:
    """Positive half width of a trainable box from an unconstrained parameter."""
    return softplus(log_half) + F.lit(MIN_HALF)


def soft_log_volume(lo: Column, hi: Column, beta: float = SOFT_BETA) -> Column:
    return total(F.zip_with(lo, hi, lambda x, y: F.log(beta * softplus((y - x) / beta) + F.lit(SOFT_EPS))))


def intersection_embedding(lo: Column, hi: Column, beta: float = SOFT_BETA) -> Column:
    """Middle of the intersection followed by its soft sides."""
    return F.concat(middle(lo, hi), F.zip_with(lo, hi, lambda x, y: beta * softplus((y - x) / beta)))
