"""Calibration of the two scalar parameters: box scale alpha and log-volume threshold tau."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B

#: The grid of the index build, and the share of overlap aimed at.
ALPHA_GRID = (0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 22.0, 30.0, 40.0, 50.0)
TARGET_RATIO = 0.05


def draw_pairs(ids: DataFrame, n_pairs: int, seed: int = 1337) -> DataFrame:
    """n_pairs drawn pairs (a, b) of distinct rows, the same for every value of the grid.

    ids has idx (0 to n - 1) and chunk_id. Draws come from md5 of the pair number, side and seed; draws of a row with
    itself are dropped, as in drawing with replacement.
    """
    n = ids.count()
    draw = lambda side: F.expr(f"cast(conv(substr(md5(concat(i, ':{side}:', '{seed}')), 1, 8), 16, 10) as bigint) % {max(n, 1)}")
    d = ids.sparkSession.range(n_pairs).select(F.col("id").cast("string").alias("i")).select("i", draw("a").alias("ia"), draw("b").alias("ib")).where("ia <> ib")
    a, b = (ids.select(F.col("idx").alias(f"i{s}"), F.col("chunk_id").alias(s)) for s in "ab")
    return d.join(a, "ia").join(b, "ib").select("i", "a", "b")


def alpha_ratios(corpus: DataFrame, knn: DataFrame, pairs: DataFrame, grid: Sequence[float] = ALPHA_GRID, beta: float = B.BETA) -> DataFrame:
    """alpha, median_log_box, median_log_pair, ratio: medians in log space, their ratio e^(difference), 0 if not finite."""
    values = F.array(*[F.lit(float(a)) for a in grid])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    rows = corpus.join(knn.where("knn is not null"), "chunk_id")
    boxed = lambda df: df.withColumn("alpha", F.explode(values)).withColumn("h", F.col("alpha") * F.col("knn")).withColumn("lo", B.lower(F.col("v"), F.col("h"))).withColumn("hi", B.upper(F.col("v"), F.col("h")))
    own = boxed(rows).select("alpha", finite(B.box_log_volume(F.col("lo"), F.col("hi"))).alias("lv")).groupBy("alpha").agg(F.percentile("lv", 0.5).alias("median_log_box"))
    # only the rows of the drawn pairs are boxed for them, after the join
    drawn = rows.join(pairs.select(F.explode(F.array("a", "b")).alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    x, y = (drawn.select(F.col("chunk_id").alias(s), F.col("v").alias(f"v_{s}"), F.col("knn").alias(f"knn_{s}")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("alpha", F.explode(values))
    h = {s: F.col("alpha") * F.col(f"knn_{s}") for s in "ab"}
    both = both.select("alpha", B.pair_log_volume(B.lower(F.col("v_a"), h["a"]), B.upper(F.col("v_a"), h["a"]), B.lower(F.col("v_b"), h["b"]), B.upper(F.col("v_b"), h["b"]), beta).alias("lv"))
    both = both.groupBy("alpha").agg(F.percentile("lv", 0.5).alias("median_log_pair"))
    ratio = F.coalesce(F.exp(F.col("median_log_pair") - F.col("median_log_box")), F.lit(0.0))
    return own.join(both, "alpha", "left").withColumn("ratio", ratio)


def choose_alpha(ratios: DataFrame, target: float = TARGET_RATIO) -> DataFrame:
    """One row: the alpha whose ratio is nearest to target by the difference of logs; of equals the smallest alpha."""
    apart = F.abs(F.log(F.greatest("ratio", F.lit(1e-30))) - F.lit(math.log(max(target, 1e-12))))
    return ratios.agg(F.min_by(F.struct("alpha", "ratio"), F.struct(apart.alias("d"), F.col("alpha"))).alias("best")).select("best.alpha", "best.ratio")


def tau_of(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """One row with tau, the given percentile of the finite log-volumes, and their number and spread."""
    lv = F.col("log_volume")
    return pairs.where(~F.isnan(lv) & (F.abs(lv) < float("inf"))).agg(
        F.percentile("log_volume", F.lit(share)).alias("tau"), F.count("*").alias("n_pairs"), F.min("log_volume").alias("min"), F.percentile("log_volume", F.lit(0.1)).alias("p10"), F.percentile("log_volume", F.lit(0.9)).alias("p90"), F.max("log_volume").alias("max")
    )
