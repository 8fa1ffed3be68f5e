"""Corpus audits: which supporting titles have a passage, by question and by data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def title_counts(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """title, n (how often it supports), n_passages: one row for each distinct supporting title that isn't null."""
    have = corpus.where("title is not null").groupBy("title").agg(F.count("*").alias("n_passages"))
    return facts.where("title is not null").groupBy("title").agg(F.count("*").alias("n")).join(have, "title", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))


def corpus_audit(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of totals: facts, distinct titles, titles missing from the corpus, titles met more than once."""
    t = title_counts(facts, corpus)
    zero = F.col("n_passages") == 0
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.count("*").alias("n_titles"), F.count_if(zero).alias("n_missing_titles"), F.coalesce(F.sum(F.when(zero, F.col("n"))), F.lit(0)).alias("n_missing_facts"), F.count_if(F.col("n_passages") > 1).alias("n_ambiguous_titles"))


def top_missing(facts: DataFrame, corpus: DataFrame, n: int = 20) -> DataFrame:
    """The n missing titles that support most often; ties by title."""
    return title_counts(facts, corpus).where("n_passages = 0").select("title", "n").orderBy(F.col("n").desc(), "title").limit(n)


def corpus_coverage(questions: DataFrame, corpus: DataFrame, group: str, id_col: str, titles_col: str) -> DataFrame:
    """group, n, rates of questions with all and with any gold title in the corpus (0 for an empty group).

    Questions without a gold title have all of nothing and any of nothing: they count as all and not as any.
    """
    have = corpus.where("title is not null").select("title").distinct().withColumn("hit", F.lit(1))
    rows = questions.select(group, id_col, F.explode_outer(titles_col).alias("title")).join(have, "title", "left")
    per = rows.groupBy(group, id_col).agg(F.count("title").alias("gold"), F.count("hit").alias("hits"))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return per.groupBy(group).agg(F.count("*").alias("n"), rate(F.col("hits") == F.col("gold")).alias("all_rate"), rate(F.col("hits") > 0).alias("any_rate"))


def hop_distribution(questions: DataFrame, group: str = "dataset", hops: str = "n_hops") -> DataFrame:
    return questions.groupBy(group, hops).agg(F.count("*").alias("n"))
