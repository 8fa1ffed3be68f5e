"""Readers of the question formats, corpora, vector shards, built tables and result logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..operators.runs import latest
from ..session import exists
from . import schemas


def read_hotpot(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with supporting_facts; supporting_titles are sorted and distinct."""
    df = spark.read.schema(schemas.QUESTION_A).json(path)
    return df.withColumn("supporting_titles", F.sort_array(F.array_distinct(F.transform("supporting_facts", lambda x: x["title"]))))


def _multihop(df: DataFrame, dataset: str, titles) -> DataFrame:
    gold = F.array_distinct(F.transform(titles, normalize_title))
    return df.select("id", F.lit(dataset).alias("dataset"), "question", F.coalesce("answer", F.lit("")).alias("answer"), gold.alias("gold_titles"), F.size(gold).alias("n_hops"))


def read_hotpot_multihop(spark: SparkSession, path: str) -> DataFrame:
    """The same format as multi-hop questions: titles in order of first occurrence."""
    df = spark.read.schema(schemas.QUESTION_A).json(path)
    return _multihop(df, "hotpotqa", F.transform("supporting_facts", lambda x: x["title"]))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of questions whose facts are [title, sentence] pairs; the id is _id or else id."""
    df = spark.read.schema(schemas.QUESTION_PAIRS).option("multiLine", True).json(path)
    return _multihop(df.withColumn("id", F.coalesce("_id", "id")), "2wiki", F.transform("supporting_facts", lambda x: x[0]))


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with paragraphs, of which those that support count."""
    df = spark.read.schema(schemas.QUESTION_NESTED).json(path)
    return _multihop(df, "musique", F.transform(F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False))), lambda p: p["title"]))


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"hotpotqa": read_hotpot_multihop, "2wiki": read_pairs, "musique": read_nested}


def load_questions(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown data set {name!r}; known are {sorted(LOADERS)}")
    return LOADERS[name](spark, path)


def normalize_facts(titles: str = "title", sentences: str = "sent_id") -> F.Column:
    """An array of structs from two parallel arrays."""
    return F.transform(F.arrays_zip(F.col(titles).alias("t"), F.col(sentences).alias("s")), lambda x: F.struct(x["t"].alias("title"), x["s"].cast("int").alias("sent_id")))


def read_corpus(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Passages; raises if columns are missing, or if the number of rows isn't the stated one."""
    df = spark.read.parquet(path)
    missing = {"chunk_id", "title", "text"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shards of a folder as chunk_id and v; order doesn't matter, ids are carried."""
    return spark.read.parquet(path).select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))


def read_built(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the index; raises with the step that builds it if it isn't there."""
    if not exists(spark, f"{folder}/{name}"):
        raise FileNotFoundError(f"{folder}/{name} isn't built; run plans.index.build_dense and build_boxes first")
    return spark.read.parquet(f"{folder}/{name}")


def read_parameter(spark: SparkSession, path: str) -> dict | None:
    """A one-row JSON file as a dictionary, or None if there is none."""
    if not exists(spark, path):
        return None
    rows = spark.read.json(path).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def read_log(spark: SparkSession, path: str, ddl: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """Result records of a JSON lines log; blank and torn lines are left out. marks: columns of the files, kept as __at0, __at1 and so on."""
    df = spark.read.schema(ddl + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    first = df.columns[0]
    df = df.select("*", *[F.col(m).alias(f"__at{i}") for i, m in enumerate(marks)])
    return df.where(F.col("_corrupt").isNull() & F.col(first).isNotNull()).drop("_corrupt")


def done_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return read_log(spark, path, ", ".join(f"`{k}` string" for k in keys)).select(*keys).distinct()


def read_latest(spark: SparkSession, path: str, ddl: str, key: str = "id") -> DataFrame:
    """The last line of each key: of the file written last, and of those of one time the one with the greatest name; in a file the line
    that stands last, as parts of a file are read in order of their places."""
    lines = read_log(spark, path, ddl, ("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"))
    marks = [c for c in lines.columns if c.startswith("__at")]
    return latest(lines.withColumn("__line", F.monotonically_increasing_id()), key, [*marks, "__line"]).drop("__line", *marks)


def read_seeded(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON files whose names end in seed<number>, with that number as `seed`."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("seed", F.regexp_extract(F.input_file_name(), r"seed(\d+)", 1).cast("int"))
