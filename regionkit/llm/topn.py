"""The N best items of every group, safe against groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, subgroups: int = 32) -> DataFrame:
    """Columns group, item, score and rank (from 1) of the n best items of each group.

    Rows with a null group, a null item, or a null or NaN score don't count. An item scored more than once
    counts once, with its highest score (-0.0 counts as 0.0); equal scores are ordered by the smaller item.
    Other columns of df are ignored. An empty table or n < 1 gives no rows.

    Plan: highest score per (group, item) with a partial aggregation; the items of a group are hashed into
    subgroups, of which each keeps its n best (Spark limits them before the shuffle, too); then at most
    n * subgroups survivors of a group are ranked.
    """
    src = df.select(df[group].alias("g"), df[item].alias("i"), (df[score].cast("double") + F.lit(0.0)).alias("s"))
    src = src.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    best = src.groupBy("g", "i").agg(F.max("s").alias("s"))
    best = best.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(subgroups)))
    order = [F.col("s").desc(), F.col("i").asc()]
    some = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))).where(F.col("r") <= n)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
