"""Resumable runs: what is left to do, pluggable encoders and generators, alignment of two runs."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt


def todo(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Questions without a row of the same keys in done; null keys are never done."""
    return questions.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the given order; null keys are one key."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in cols])


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids in both runs and in only one of them."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    both = x.join(y, key, "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


def fetch_chunks(retrieved: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, chunks: array of (title, text) in the order of rank; missing passages are left out, null titles and texts are empty."""
    named = retrieved.join(passages.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")), "chunk_id")
    items = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "title", "text")))
    return named.groupBy("query_id").agg(F.transform(items, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text"))).alias("chunks"))


def with_prompt(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (query_id, question) with the prompt built from their chunks; none gives an empty list."""
    none = F.array().cast("array<struct<title:string,text:string>>")
    return questions.join(chunks, "query_id", "left").withColumn("prompt", prompt(F.coalesce("chunks", none), F.coalesce("question", F.lit("")))).drop("chunks")


def echo(text: str) -> str:
    """Stand-in generator: the first words behind the last passage number."""
    return " ".join(text.split()[:5])


def generate(df: DataFrame, answer: Callable[[str], str] = echo, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """df with prediction and error: answer(prompt), tried up to `tries` times with doubling waits; failures give "" and the error."""

    def one(text: str) -> tuple[str, str | None]:
        pause, why = wait, ""
        for i in range(tries):
            try:
                return answer(text), None
            except Exception as e:  # noqa: BLE001 - any failure of a user's generator is recorded
                why = f"{type(e).__name__}: {e}"
                if i + 1 < tries:
                    time.sleep(pause)
                    pause *= 2
        return "", why

    def run(batches):
        for pdf in batches:
            got = [one(t) for t in pdf.prompt]
            yield pdf.assign(prediction=[g[0] for g in got], error=pd.Series([g[1] for g in got], dtype=object, index=pdf.index))

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in ("prediction", "error"))
    return df.drop("prediction", "error").mapInPandas(run, fields + ", prediction string, error string")


def encode(df: DataFrame, text_col: str, encoder: Callable[[list[str]], list[list[float]]], out: str = "v") -> DataFrame:
    """df with out: one vector for each text, made in Arrow batches by the given encoder; null texts are encoded as empty."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: list(encoder([t or "" for t in pdf[text_col]]))})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out) + f", `{out}` array<double>")


def sample_ids(df: DataFrame, key: str, n: int, seed: int = 1337) -> DataFrame:
    """n rows without replacement, those with the smallest md5 of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def id_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: first 16 hex digits of sha256 over the sorted ids, a line each. For samples, whose ids fit one row."""
    ids = F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "\n")
    return df.agg(F.substring(F.sha2(ids, 256), 1, 16).alias("digest"), F.count("*").alias("n"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 1337) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def ranked_lists(rows: DataFrame, value: str = "chunk_id") -> DataFrame:
    """query_id, ranked: values in the order of rank."""
    items = F.sort_array(F.collect_list(F.struct("rank", value)))
    return rows.groupBy("query_id").agg(F.transform(items, lambda x: x[value]).alias("ranked"))


def first_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("__r") <= k).drop("__r")
