"""Mix of sources to target weights of the total size, by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import count_tokens

BUCKETS = 1024
#: Targets up to which they, and their buckets' sums (BUCKETS rows each), are broadcast; beyond, joins are shuffled.
MAX_BROADCAST = 200


def text_quality(text: str, length: str = "n") -> F.Column:
    """A weight from 0.1 to 1: share of letters and blanks among the characters."""
    kept = F.length(F.regexp_replace(F.col(text), r"[^\p{L} ]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(kept / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def sized_documents(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality: F.Column | None = None, seed: int = 17, vocabulary_path: str | None = None) -> DataFrame:
    """doc, source, n_tokens and u of each document, written once to the checkpoint folder.

    u in (0, 1) falls as the Efraimidis-Spirakis key -ln(h) / quality rises, so that the best key has the
    largest u; h comes from a hash of the id and the seed.
    """
    q = text_quality(text_col) if quality is None else quality
    h = (F.pmod(F.xxhash64(docs[id_col].cast("string"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    src = docs.select(docs[id_col].alias("doc"), docs[source_col].alias("source"), docs[text_col].alias("text"), F.pow(h, 1 / q).alias("u"))
    src = src.where(F.col("source").isNotNull() & (F.length("text") > 0))
    return cut_lineage(count_tokens(src, "text", ["doc", "source", "u"], vocabulary_path).where("n_tokens > 0"))


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: doc_id, source, n_tokens, times; shares: one row for each row of targets.

    sized is what sized_documents returns; targets has source, weight, max_repeats. The total is the largest at
    which every source that has documents reaches its share of it (weights are scaled to the sources present)
    without using a document more than max_repeats times, or total_tokens if that is less. A source's documents
    are used in whole epochs first; the rest of its budget takes documents in the order of their keys (ties: the
    smaller id) as long as their prefix sum stays within the budget. Documents without a source, of a source
    not listed, or without tokens are left out; a listed source without documents is reported with share 0;
    null or non-positive weights and repeats count as 0. A source listed twice counts with its first row by weight.

    No source is ordered in one task: tokens are summed by (source, key bucket), a running sum over these few
    sums finds the bucket in which the budget ends, and only that bucket's documents are ordered.
    """
    t = targets.groupBy("source").agg(F.min_by(F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r")), F.struct("weight", "max_repeats")).alias("x"))
    t = t.where("source is not null").select("source", F.greatest("x.w", F.lit(0.0)).alias("weight"), F.greatest("x.r", F.lit(0)).alias("max_repeats"))
    sums = sized.withColumn("b", F.least(F.floor((1 - F.col("u")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).groupBy("source", "b").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    few = targets.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    small = F.broadcast if few else lambda df: df
    sums = sums.join(small(t), "source")
    have = sums.groupBy("source").agg(F.sum("t").alias("held"), F.sum("n").alias("n_docs"))
    plan = t.join(have, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    live = (F.col("held") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    whole = plan.where(live).agg(F.sum("weight").alias("all_w"), F.min(F.col("held") * F.col("max_repeats") / F.col("weight")).alias("per")).first()
    all_w, total = whole.all_w or 1.0, (whole.per or 0.0) * (whole.all_w or 0.0)
    total = F.lit(float(total if total_tokens is None else min(total, total_tokens)))
    plan = plan.withColumn("budget", F.when(live, F.floor(F.least(total * F.col("weight") / F.lit(all_w), F.col("held") * F.col("max_repeats")) + F.lit(1e-6))).otherwise(F.lit(0)).cast("bigint"))
    plan = plan.withColumn("epochs", F.when(F.col("held") > 0, F.floor(F.col("budget") / F.col("held"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("held"))
    plan = cut_lineage(plan.select("source", "weight", "max_repeats", "held", "n_docs", "budget", "epochs", "rest"))  # a row for each target

    by_bucket = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.select("source", "b", "t", F.coalesce(F.sum("t").over(by_bucket), F.lit(0)).alias("before"))
    edge = runs.join(small(plan.select("source", "rest", "epochs")), "source")
    edge = edge.select("source", "b", "before", "rest", "epochs", F.when(F.col("before") + F.col("t") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(-1).alias("part"))
    docs = sized.withColumn("b", F.least(F.floor((1 - F.col("u")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).join(small(edge), ["source", "b"])
    sure = docs.where("part >= 0").select("doc", "source", "n_tokens", (F.col("epochs") + F.col("part")).alias("times"))
    order = Window.partitionBy("source", "b").orderBy(F.col("u").desc(), "doc").rowsBetween(Window.unboundedPreceding, 0)
    fit = (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int")
    open_ = docs.where("part = -1").withColumn("times", F.col("epochs") + fit).select("doc", "source", "n_tokens", "times")
    mix = sure.unionByName(open_).where("times > 0").select(F.col("doc").alias("doc_id"), "source", "n_tokens", F.col("times").cast("int").alias("times"))

    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used"), F.max("times").alias("most"), F.count("*").alias("docs_used"))
    all_used = F.sum("used").over(Window.partitionBy(F.lit(0)))  # a row for each target
    shares = plan.join(used, "source", "left").withColumn("all_used", all_used).select(
        "source",
        F.col("weight").alias("target_share"),
        F.coalesce("n_docs", F.lit(0)).alias("documents"),
        F.col("held").alias("tokens_held"),
        F.col("budget").alias("tokens_budget"),
        F.coalesce("used", F.lit(0)).alias("tokens_used"),
        F.coalesce("docs_used", F.lit(0)).alias("documents_used"),
        F.coalesce("most", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("used") / F.col("all_used"), F.lit(0.0)).alias("actual_share"),
    )
    return mix, shares
