"""Queries of the training-data operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, bpe, lookalike, mix, overlap, pairs, split, titles, topn


def _typed_titles(spark: SparkSession, d: str) -> DataFrame:
    multihop = lookalike.elements(table(spark, d, "multihop_questions"), "multihop", F.col("id"), "gold_titles")
    passages = lookalike.elements(table(spark, d, "passages"), "passages", F.col("chunk_id"), F.array("title"))
    return multihop.unionByName(passages)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "wiki_titles")
    typed = _typed_titles(spark, d)
    open_ = typed.join(known.select("title"), typed["value"] == known["title"], "left_anti")
    return titles.map_to_list(open_, known, "title_id", "title").select("tab", "rec_id", "pos", "title_id").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the values that stand for no entry, with how often they occur."""
    return titles.map_to_list(_typed_titles(spark, d), table(spark, d, "wiki_titles"), "title_id", "title").where("title_id = -1").groupBy("tab", "value").agg(F.count("*").alias("n"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    multihop = lookalike.elements(table(spark, d, "multihop_questions"), "multihop", F.col("id"), "gold_titles")
    hotpot = lookalike.elements(table(spark, d, "hotpot_questions"), "hotpot", F.col("rec_no"), "supporting_titles")
    return multihop.unionByName(hotpot)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_lookalikes(_elements(spark, d), table(spark, d, "wiki_titles"), "title").select("tab", "rec_id", "pos")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every element."""
    return lookalike.one_form(_elements(spark, d).distinct(), "value", table(spark, d, "wiki_titles"), "title")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(table(spark, d, "generations"), "gen_id", "prompt", "answer")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, d, "hotpot_questions"), "rec_no", "split", "id", "question", table(spark, d, "wiki_titles"), "title")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Records with a partner in the train split, and pairs, by split and source."""
    return overlap.overlap_report(p5_counts(spark, d), table(spark, d, "hotpot_questions"), "rec_no", "split", "source")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the dev and test splits, with its class and its number of links to the train split."""
    return overlap.overlap_counts(table(spark, d, "hotpot_questions"), "rec_no", "split", "id", "question", table(spark, d, "wiki_titles"), "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "scored_chunks"), "query_id", "chunk_id", "score", 5).select("query_id", "chunk_id")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "scored_chunks"), "query_id", "chunk_id", "score", 5)


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = ann.most_similar(table(spark, d, "passage_vectors"), "chunk_id", "embedding", 64, ann.COSINE, 0.90).withColumn("space", F.lit("embedding"))
    c = ann.most_similar(table(spark, d, "boxes"), "chunk_id", "center", 16, ann.EUCLID, -0.10).withColumn("space", F.lit("center"))
    return e.unionByName(c)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("space", F.least("chunk_id", "other").alias("chunk_a"), F.greatest("chunk_id", "other").alias("chunk_b")).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mix.sized_documents(table(spark, d, "documents"), "doc_id", "source", "text")
    return mix.mix_sources(sized, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "documents"), "doc_id", "text", only_oversized=True, texts=False).where("piece = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "documents"), "doc_id", "text", only_oversized=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_ranked, p3_found, p3_forms, p4_found, p5_found, p5_counts, p5_report, p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_pieces)}

_BEST = """best AS (SELECT query_id, chunk_id, max(score + 0.0::DOUBLE) AS score FROM scored_chunks
WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM best)"""

SQL = {
    "p2_found": f"WITH {_BEST} SELECT query_id, chunk_id FROM ranked WHERE rank <= 5",
    "p2_ranked": f"WITH {_BEST} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 5",
}
