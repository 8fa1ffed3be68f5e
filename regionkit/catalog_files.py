"""Queries that write tables through the sinks and read them back through the sources, and the SQL that checks them.

They write into a new folder under the shared checkpoint folder.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _corpus, query
from .plans import index
from .session import ensure_checkpoint_dir, table
from .sources import readers, writers


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid4()}"


@query("SELECT id, CAST(max(CASE WHEN condition = 'oracle' THEN 2 ELSE 1 END) AS INTEGER) AS phase FROM generations WHERE id IS NOT NULL GROUP BY id")
def log_latest(spark, d) -> DataFrame:
    """The last record of each question, of a log that two runs appended to."""
    g = table(spark, d, "generations").where("id is not null").select("id", F.when(F.col("condition") == "oracle", 2).otherwise(1).alias("phase")).distinct()
    path = folder(spark)
    for phase in (1, 2):
        writers.append_log(g.where(F.col("phase") == phase), path)
    return readers.read_latest(spark, path, "id string, phase int").select("id", "phase")


@query("SELECT DISTINCT id, condition FROM generations WHERE id IS NOT NULL AND condition IS NOT NULL")
def log_done_keys(spark, d) -> DataFrame:
    """Keys of the finished records of a log, of which the last line is torn."""
    path = folder(spark)
    writers.append_log(table(spark, d, "generations").where("id is not null and condition is not null").select("id", "condition", "answer"), path)
    spark.createDataFrame([('{"id": "torn", "condi',)], "value string").write.mode("append").text(path)
    return readers.done_keys(spark, path, ["id", "condition"])


@query("SELECT vec_id::VARCHAR AS chunk_id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def shards_appended(spark, d) -> DataFrame:
    """Vectors of shards, of which the second holds the rows of the first once more."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    path = folder(spark)
    writers.append_shard(v.where("cast(chunk_id as int) % 2 = 0"), path)
    writers.append_shard(v, path)
    return readers.read_shards(spark, path).select("chunk_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(supporting_facts, lambda f: f.title), lambda t: t IS NOT NULL))), '|') AS titles FROM hotpot_questions WHERE supporting_facts IS NOT NULL AND id IS NOT NULL")
def questions_read(spark, d) -> DataFrame:
    """Questions of JSON lines with their supporting titles, sorted and distinct."""
    path = folder(spark)
    table(spark, d, "hotpot_questions").where("supporting_facts is not null and id is not null").select("id", "question", "answer", "type", "level", "supporting_facts", "context_titles").write.json(path)
    return readers.read_hotpot(spark, path).select("id", F.array_join("supporting_titles", "|").alias("titles")).distinct()


@query("SELECT DISTINCT id, dataset, coalesce(answer, '') AS answer, len(gold_titles)::INTEGER AS n_given FROM multihop_questions WHERE gold_titles IS NOT NULL AND id IS NOT NULL AND len(list_filter(gold_titles, lambda t: t IS NULL)) = 0 AND len(list_distinct(gold_titles)) = len(gold_titles) AND dataset = 'musique'")
def questions_nested(spark, d) -> DataFrame:
    """Questions with paragraphs, of which the supporting ones give the titles."""
    q = table(spark, d, "multihop_questions").where("gold_titles is not null and id is not null and dataset = 'musique' and forall(gold_titles, t -> t is not null) and size(array_distinct(gold_titles)) = size(gold_titles)")
    one = lambda t, i, ok: F.struct(i.cast("int").alias("idx"), t.alias("title"), F.lit("").alias("paragraph_text"), F.lit(ok).alias("is_supporting"))
    held = F.concat(F.transform("gold_titles", lambda t, i: one(F.concat(i.cast("string"), F.lit("_"), t), i, True)), F.array(one(F.lit("another"), F.lit(99), False)))
    path = folder(spark)
    q.select("id", "question", "answer", held.alias("paragraphs")).write.json(path)
    return readers.load_questions(spark, "musique", path).select("id", "dataset", "answer", F.col("n_hops").alias("n_given")).distinct()


@query("SELECT vec_id AS chunk_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS length FROM embeddings")
def dense_index_built(spark, d) -> DataFrame:
    """Vectors of unit length as the index holds them."""
    path = folder(spark)
    index.build_dense(_corpus(spark, d), path)
    return readers.read_built(spark, path, "vectors").select("chunk_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


@query("SELECT round(quantile_cont(value::DOUBLE, 0.5), 6) AS tau, count(value) AS n FROM events")
def parameter_stored(spark, d) -> DataFrame:
    """A calibrated number, stored and read again; an absent one is none."""
    path = folder(spark)
    if readers.read_parameter(spark, path) is not None:
        raise ValueError(f"{path} is new")
    writers.write_parameter(table(spark, d, "events").agg(F.round(F.percentile("value", 0.5), 6).alias("tau"), F.count("value").alias("n")), path)
    kept = readers.read_parameter(spark, path)
    return spark.createDataFrame([(float(kept["tau"]), int(kept["n"]))], "tau double, n bigint")


@query("SELECT chunk_id, title, length(text) AS n FROM passages")
def corpus_read(spark, d) -> DataFrame:
    """Passages, after a check of their columns."""
    return readers.read_corpus(spark, f"{d}/passages.parquet").select("chunk_id", "title", F.length("text").cast("bigint").alias("n"))


@query()
def projection_stored(spark, d) -> DataFrame:
    """The stored projection, compared with the one its seed gives when it is read."""
    path = folder(spark)
    writers.write_projection(spark, path, 64, 8)
    m = writers.read_projection(spark, path)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "row int, weights array<double>")
