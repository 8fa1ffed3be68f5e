"""Region store (experimental): append-only regions, promotion of intersections, walks along lineage, upkeep.

A region is a row region_id, lo, hi, parent_a, parent_b, depth, citations, score. Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..session import cut_lineage

SCHEMA = "region_id string, lo array<double>, hi array<double>, parent_a string, parent_b string, depth int, citations array<string>, score double"


def _place(digits: int) -> F.Column:
    return F.sha2(F.concat_ws(",", F.transform("lo", lambda x: F.round(x, digits).cast("string")), F.transform("hi", lambda x: F.round(x, digits).cast("string"))), 256)


def write(store: DataFrame, new: DataFrame, digits: int = 6) -> DataFrame:
    """store with the regions of new whose corners, rounded to digits, aren't in it."""
    fresh = new.withColumn("__p", _place(digits)).dropDuplicates(["__p"]).join(store.select(_place(digits).alias("__p")).distinct(), "__p", "left_anti").drop("__p")
    return store.unionByName(fresh)


def intersect(store: DataFrame, pairs: DataFrame, tau: float | None = None) -> DataFrame:
    """Intersections of pairs (a, b), as regions with two parents: depth one above the deeper, citing both."""
    a, b = (store.select(F.col("region_id").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("depth").alias(f"depth_{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").where("a <> b")
    both = both.withColumn("lo", B.overlap_lo(F.col("lo_a"), F.col("lo_b"))).withColumn("hi", B.overlap_hi(F.col("hi_a"), F.col("hi_b")))
    both = both.withColumn("sides", B.soft_sides(F.col("lo"), F.col("hi"))).withColumn("score", B.log_volume_of_sides(F.col("sides")))
    if tau is not None:
        both = both.where(F.col("score") >= tau)
    lo, hi = B.around(F.col("lo"), F.col("hi"), F.col("sides"))
    return both.select(F.sha2(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")), 256).alias("region_id"), lo.alias("lo"), hi.alias("hi"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), (F.greatest("depth_a", "depth_b") + 1).alias("depth"), F.array("a", "b").alias("citations"), "score")


def promote(store: DataFrame, lenses: DataFrame, digits: int = 6) -> DataFrame:
    """store with the lenses written and each of them cited by both of its parents."""
    cites = lenses.select("region_id", F.explode(F.array("parent_a", "parent_b")).alias("parent")).groupBy("parent").agg(F.collect_set("region_id").alias("more"))
    cited = store.join(cites, store["region_id"] == cites["parent"], "left").withColumn("citations", F.when(F.col("more").isNull(), F.col("citations")).otherwise(F.array_union(F.coalesce("citations", F.array().cast("array<string>")), "more"))).drop("parent", "more")
    return write(cited, lenses, digits)


def walk(store: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """region_id and steps: regions reached from start along parents and citations in at most depth steps."""
    edges = store.select(F.col("region_id").alias("x"), F.explode(F.array_union(F.array_compact(F.array("parent_a", "parent_b")), F.coalesce("citations", F.array().cast("array<string>")))).alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    seen = start.select("region_id").distinct().withColumn("steps", F.lit(0))
    front = seen
    for i in range(1, depth + 1):
        front = front.join(edges, front["region_id"] == edges["x"]).select(F.col("y").alias("region_id")).distinct().join(seen, "region_id", "left_anti").withColumn("steps", F.lit(i))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def decay(store: DataFrame, rate: float, floor: float) -> DataFrame:
    """Scores times rate; regions that fall under floor are dropped unless another region cites them."""
    cited = store.select(F.col("region_id").alias("by"), F.explode("citations").alias("region_id")).where("by <> region_id").select("region_id").distinct().withColumn("held", F.lit(True))
    return store.withColumn("score", F.col("score") * rate).join(cited, "region_id", "left").where((F.col("score") >= floor) | F.col("held")).drop("held")


def vote(scores: DataFrame) -> DataFrame:
    """council, member, weight: softmax of each council's scores (columns council, member, score)."""
    top = scores.groupBy("council").agg(F.max("score").alias("top"))
    e = scores.join(top, "council").withColumn("e", F.exp(F.col("score") - F.col("top")))
    return e.join(e.groupBy("council").agg(F.sum("e").alias("all")), "council").select("council", "member", (F.col("e") / F.col("all")).alias("weight"))
