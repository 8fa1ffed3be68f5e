"""Candidate sets of differing quality for each question: dense, oracle, gold removed, random."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense(points: DataFrame, budget: int = 25) -> DataFrame:
    return points.where(F.col("rank") <= budget).select("query_id", "chunk_id", "rank")


def oracle(points: DataFrame, gold: DataFrame, budget: int = 25) -> DataFrame:
    """Gold first in its own order (columns query_id, chunk_id, pos), then dense rows not yet taken, up to budget."""
    both = gold.select("query_id", "chunk_id", F.lit(0).alias("part"), F.col("pos").alias("at")).unionByName(points.select("query_id", "chunk_id", F.lit(1).alias("part"), F.col("rank").alias("at")))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "at")).alias("o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).where(F.col("rank") <= budget).select("query_id", "chunk_id", "rank")


def gold_removed(points: DataFrame, titles: DataFrame, gold_titles: DataFrame, budget: int = 25) -> DataFrame:
    """Dense rows whose title (chunk_id, title) isn't a gold one (query_id, title); rows without a title stay."""
    named = points.join(titles.select("chunk_id", "title"), "chunk_id", "left")
    kept = named.join(gold_titles.select("query_id", "title").distinct(), ["query_id", "title"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= budget).select("query_id", "chunk_id", "rank")


def random_chunks(queries: DataFrame, chunks: DataFrame, budget: int = 25, seed: int = 1337) -> DataFrame:
    """budget chunks for each query without repetition, drawn by hash.

    chunks are ordered once by md5 of id and seed; each query takes a run of that order from a place of its own.
    """
    order = Window.partitionBy("bucket").orderBy("h", "chunk_id")
    hashed = chunks.select("chunk_id", F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(f":{seed}"))).alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 256 rows
    placed = hashed.withColumn("i", F.row_number().over(order)).join(F.broadcast(before.select("bucket", "before")), "bucket").select("chunk_id", (F.col("before") + F.col("i") - 1).alias("at"))
    n = chunks.count()
    start = F.expr(f"cast(conv(substr(md5(concat(query_id, ':{seed}')), 1, 8), 16, 10) as bigint) % {max(n, 1)}")
    want = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(min(budget, n) - 1))).alias("k")).withColumn("at", (start + F.col("k")) % n)
    return want.join(placed, "at").select("query_id", "chunk_id", (F.col("k") + 1).alias("rank"))


def summary(scores: DataFrame) -> DataFrame:
    """condition, n, f1, em, pair_rate, mean_chunks, and drop: F1 of the oracle less F1 without gold, on every row."""
    per = scores.groupBy("condition").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("em").alias("em"), F.avg(F.col("pair_in_context").cast("double")).alias("pair_rate"), F.avg("n_chunks").alias("mean_chunks"))
    every = Window.partitionBy(F.lit(0))  # a row for each condition
    best = lambda c: F.max(F.when(F.col("condition") == c, F.col("f1"))).over(every)
    return per.withColumn("drop", best("oracle") - best("gold_removed"))
