"""Index build: normalized vectors, boxes and their scale, written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import calibrate, retrieval
from ..session import cut_lineage
from ..sources.writers import write_built


def build_dense(vectors: DataFrame, folder: str) -> None:
    write_built(vectors.select("chunk_id", V.unit("v").alias("v")), folder, "vectors")


def numbered(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunk_id and idx, 0 to n - 1 in the order of key: numbered within hash buckets, then shifted by the buckets before."""
    b = df.select(key, F.substring(F.md5(F.col(key).cast("string")), 1, 2).alias("b"))
    sizes = b.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # at most 256 rows
    return b.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(key))).join(F.broadcast(before), "b").select(key, (F.col("before") + F.col("r") - 1).alias("idx"))


def build_boxes(vectors: DataFrame, folder: str, alpha: float | None = None, n_sample: int = 10_000, n_pairs: int = 1000) -> float:
    """Neighbour distances, alpha by the grid (on a sample of n_sample rows) unless given, and the boxes; returns alpha."""
    corpus = vectors.select("chunk_id", V.unit("v").alias("v"))
    knn = cut_lineage(retrieval.self_knn_mean(corpus))
    if alpha is None:
        sample = cut_lineage(numbered(corpus.join(corpus.select("chunk_id").orderBy(F.md5(F.col("chunk_id").cast("string"))).limit(n_sample), "chunk_id")))
        ratios = calibrate.alpha_ratios(corpus.join(sample.select("chunk_id"), "chunk_id"), knn, calibrate.draw_pairs(sample, n_pairs))
        write_built(ratios, folder, "alpha_grid")
        alpha = calibrate.choose_alpha(ratios).first().alpha
    write_built(retrieval.build_boxes(corpus, knn, alpha), folder, "boxes")
    return alpha
