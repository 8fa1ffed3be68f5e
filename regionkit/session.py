"""Session helpers: table access, checkpoint folder, partition numbers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; a file system that fails raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="regionkit-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there (reliable, survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_and_free(df: DataFrame, placed: bool = False) -> DataFrame:
    """cut_lineage(df) whose shuffle files are deleted as soon as it is written, not when the driver happens to collect its garbage.

    placed: later plans know how its rows are partitioned, and don't shuffle them for that again; adaptive plans forget it.
    """
    conf = df.sparkSession.conf
    set_to = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.adaptive.enabled": "false"} if placed else {})
    before = {key: conf.get(key) for key in set_to}
    try:
        for key, value in set_to.items():
            conf.set(key, value)
        return cut_lineage(df.select("*"))  # a plan keeps the settings it was made under
    finally:
        for key, value in before.items():
            conf.set(key, value)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors through Spark's own file server, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="regionkit-")) / "regionkit_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def parallelism(spark: SparkSession, df: DataFrame | None = None, per: int = 64 << 20) -> int:
    """A partition number that keeps all cores busy in stages whose work is far larger than their bytes, and that grows with df:
    a partition for each `per` bytes that Spark estimates for it."""
    least = max(2 * spark.sparkContext.defaultParallelism, 8)
    if df is None:
        return least
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 55:  # rows that come from no file have no estimate
        return least
    return max(least, min(size // per, 100_000))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores if its files give fewer partitions than there are cores; else df as it is.

    For scans and narrow steps on them only: of other plans, asking for the partitions would run their shuffles.
    """
    return df.repartition(parallelism(df.sparkSession, df)) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df
