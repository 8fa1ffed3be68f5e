"""Writers: result logs, shards, built tables with integrity checks, parameters, reports."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import todo
from ..session import exists


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_shard(df: DataFrame, path: str, key: str = "chunk_id") -> int:
    """Append the rows whose key isn't there yet; the number appended."""
    spark = df.sparkSession
    if exists(spark, path):
        df = todo(df, spark.read.parquet(path), [key])
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def write_built(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def projection_matrix(d_in: int, d_out: int, seed: int = 1337) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d_out, d_in)) / np.sqrt(d_out)


def write_projection(spark: SparkSession, folder: str, d_in: int, d_out: int, seed: int = 1337) -> None:
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(projection_matrix(d_in, d_out, seed))]
    write_built(spark.createDataFrame(rows, "row int, weights array<double>").withColumn("seed", F.lit(seed)), folder, "projection")


def read_projection(spark: SparkSession, folder: str) -> np.ndarray:
    """The stored matrix; raises if it isn't the one its seed gives."""
    rows = sorted(spark.read.parquet(f"{folder}/projection").collect(), key=lambda r: r.row)
    stored = np.array([r.weights for r in rows])
    if not np.array_equal(stored, projection_matrix(stored.shape[1], stored.shape[0], rows[0].seed)):
        raise ValueError(f"the projection in {folder} isn't the one of its seed")
    return stored


def write_parameter(df: DataFrame, path: str) -> None:
    """A one-row frame as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def scores_json(df: DataFrame) -> str:
    """A small frame of scores as JSON text."""
    return json.dumps([json.loads(x) for x in df.toJSON().collect()], sort_keys=True)


def markdown_table(df: DataFrame, title: str) -> str:
    """A small frame as a Markdown table under a heading."""
    rows = df.collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"
