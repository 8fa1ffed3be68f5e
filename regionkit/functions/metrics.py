"""Retrieval metrics on arrays: a ranked list of titles or ids against the gold ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _if_gold(gold: Column, value: Column) -> Column:
    """value, or NaN where there is no gold."""
    return F.when(F.size(gold) > 0, value).otherwise(F.lit(NAN))


def pair_recall_at_k(ranked: Column, gold: Column, k: int) -> Column:
    """1 if all gold is among the first k, else 0."""
    return _if_gold(gold, (F.size(F.array_except(gold, F.slice(ranked, 1, k))) == 0).cast("double"))


def any_gold_at_k(ranked: Column, gold: Column, k: int) -> Column:
    return _if_gold(gold, F.arrays_overlap(gold, F.slice(ranked, 1, k)).cast("double"))


def first_completion_rr(ranked: Column, gold: Column, k: int = 25) -> Column:
    """1 over the length of the shortest prefix with all gold; 0 if none up to k has it."""
    places = F.transform(F.array_distinct(gold), lambda g: F.array_position(F.slice(ranked, 1, k), g))
    return _if_gold(gold, F.when(F.exists(places, lambda p: p == 0), F.lit(0.0)).otherwise(1.0 / F.array_max(places)))


def covered(parent_pairs: Column, gold: Column) -> Column:
    """Whether some pair of parents (array of arrays) consists of gold only; false without gold."""
    return F.when(F.size(gold) > 0, F.exists(parent_pairs, lambda p: F.size(F.array_except(p, gold)) == 0)).otherwise(F.lit(False))


def covered_titles(parent_pairs: Column, gold: Column) -> Column:
    return _if_gold(gold, covered(parent_pairs, gold).cast("double"))
