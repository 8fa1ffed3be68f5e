"""Dense retrieval, self nearest neighbours, and retrieval by intersections of boxes ("lenses")."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import vectors as V
from .blocks import BLOCK, block_join

#: Places to which scores are rounded before they are ranked, so that ties don't hang on the order of summation.
PLACES = 9


@dataclass(frozen=True)
class LensParams:
    k_points: int = 5
    k_descent: int = 20
    m_lenses: int = 5
    cap: int = 10
    total: int = 25
    beta: float = B.BETA


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank of the k corpus rows with the highest cosine, ties by the smaller chunk_id.

    queries has query_id and v, corpus chunk_id and v, both array<double>; zero vectors score 0. Exact: block products,
    the k best of each block, then the k best of these.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        x, y = _stack(q.v), _stack(c.v)
        x, y = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12) for a in (x, y))
        s = np.round(x @ y.T, PLACES)
        ids = c.chunk_id.to_numpy()
        if exclude_self:
            s[q.query_id.to_numpy()[:, None] == ids[None]] = -np.inf
        # every score that is at least the k-th best of its row, so that ties at the edge are told apart by their ids later
        edge = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
        i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
        out = pd.DataFrame({"query_id": q.query_id.to_numpy()[i], "chunk_id": ids[j], "score": s[i, j]})
        order = np.lexsort((out.chunk_id.to_numpy(), -out.score.to_numpy(), i))
        out, i = out.iloc[order], i[order]
        return out[np.arange(len(i)) - np.searchsorted(i, i) < k]

    kind = dict(corpus.dtypes)["chunk_id"]
    near = block_join(queries.select("query_id", "v"), corpus.select("chunk_id", "v"), "query_id", "chunk_id", run, f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {kind}, score double", block)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def self_knn_mean(corpus: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """chunk_id, knn: mean distance to the k nearest other rows; a row alone has none (null)."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"chunk_id": [], "other": [], "d": []})
        x, y = _stack(a.v), _stack(b.v)
        ids, others = a.chunk_id.to_numpy(), b.chunk_id.to_numpy()
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
        d[ids[:, None] == others[None]] = np.inf
        top = min(k, d.shape[1])
        at = np.argpartition(d, top - 1, axis=1)[:, :top]
        exact = np.sqrt(((x[:, None, :] - y[at]) ** 2).sum(2))
        ok = np.isfinite(np.take_along_axis(d, at, 1)).ravel()
        return pd.DataFrame({"chunk_id": np.repeat(ids, top)[ok], "other": others[at].ravel()[ok], "d": exact.ravel()[ok]})

    kind = dict(corpus.dtypes)["chunk_id"]
    src = corpus.select("chunk_id", "v")
    near = block_join(src, src, "chunk_id", "chunk_id", run, f"chunk_id {kind}, other {kind}, d double", block)
    order = Window.partitionBy("chunk_id").orderBy(F.round("d", PLACES), "other")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return src.select("chunk_id").distinct().join(best.groupBy("chunk_id").agg(F.avg("d").alias("knn")), "chunk_id", "left")


def build_boxes(corpus: DataFrame, knn: DataFrame, alpha: float) -> DataFrame:
    """chunk_id, c, h, lo, hi: boxes around the rows, alpha times their mean neighbour distance to either side."""
    rows = corpus.join(knn.where("knn is not null"), "chunk_id").withColumn("h", F.lit(alpha) * F.col("knn"))
    return rows.select("chunk_id", F.col("v").alias("c"), "h", B.lower(F.col("v"), F.col("h")).alias("lo"), B.upper(F.col("v"), F.col("h")).alias("hi"))


def lens_pairs(points: DataFrame, boxes: DataFrame, beta: float = B.BETA) -> DataFrame:
    """Unordered pairs of each query's points with the corners of their overlap, soft sides and log-volume.

    Points without a box are left out.
    """
    have = points.join(boxes.select("chunk_id", "lo", "hi"), "chunk_id")
    a = have.select("query_id", F.col("rank").alias("ra"), F.col("chunk_id").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = have.select("query_id", F.col("rank").alias("rb"), F.col("chunk_id").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = a.join(b, "query_id").where("ra < rb")
    pairs = pairs.select("query_id", "ra", "rb", "a", "b", B.overlap_lo(F.col("lo_a"), F.col("lo_b")).alias("lo"), B.overlap_hi(F.col("hi_a"), F.col("hi_b")).alias("hi"))
    pairs = pairs.withColumn("sides", B.soft_sides(F.col("lo"), F.col("hi"), beta))
    return pairs.withColumn("log_volume", B.log_volume_of_sides(F.col("sides")))


def lens_candidates(pairs: DataFrame, queries: DataFrame, m: int, tau: DataFrame | float | None = None) -> DataFrame:
    """The m best lenses of each query: log-volume plus ln(cosine of query and middle, plus 1), ties by point ranks.

    tau, a number or a one-row frame with the column tau, drops pairs with a smaller log-volume; equality stays.
    """
    if isinstance(tau, DataFrame):
        row = tau.first()
        tau = row.tau if row else None
    if tau is not None:
        pairs = pairs.where(F.col("log_volume") >= tau)
    min_, max_ = B.around(F.col("lo"), F.col("hi"), F.col("sides"))
    boxed = pairs.withColumn("min", min_).withColumn("max", max_).withColumn("mid", B.middle(F.col("min"), F.col("max")))
    cos = V.cosine("qv", "mid")
    scored = boxed.join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
    scored = scored.withColumn("log_score", F.col("log_volume") + F.log(F.greatest(cos + 1, F.lit(1e-12))))
    order = Window.partitionBy("query_id").orderBy(F.round("log_score", PLACES).desc(), "ra", "rb")
    out = scored.withColumn("lens", F.row_number().over(order)).where(F.col("lens") <= m)
    return out.select("query_id", "lens", "ra", "rb", "a", "b", "min", "max", "mid", "log_volume", "log_score")


def lens_members(lenses: DataFrame, boxes: DataFrame, cap: int, block: int = BLOCK) -> DataFrame:
    """query_id, lens, chunk_id, pos, n_inside: rows whose centers lie in the lens, at most cap.

    Up to cap rows come in order of chunk_id; of more, the cap nearest to the middle of the lens in order of distance.
    """

    def run(l: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        names = ["query_id", "lens", "chunk_id", "d", "n"]
        if l.empty or c.empty:
            return pd.DataFrame(columns=names)
        x, ids, out = _stack(c.c), c.chunk_id.to_numpy(), []
        for r in l.itertuples():
            inside = np.flatnonzero(((x >= np.asarray(r.min)) & (x <= np.asarray(r.max))).all(axis=1))
            if inside.size:
                d = np.sqrt(((x[inside] - np.asarray(r.mid)) ** 2).sum(1))
                at = np.lexsort((ids[inside], np.round(d, PLACES)))[:cap]
                out.append(pd.DataFrame({"query_id": r.query_id, "lens": r.lens, "chunk_id": ids[inside][at], "d": d[at], "n": inside.size}))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    kind = dict(boxes.dtypes)["chunk_id"]
    keyed = lenses.select("query_id", "lens", "min", "max", "mid", F.xxhash64("query_id", "lens").alias("key"))
    got = block_join(keyed, boxes.select("chunk_id", "c"), "key", "chunk_id", run, f"query_id {dict(lenses.dtypes)['query_id']}, lens int, chunk_id {kind}, d double, n bigint", block)
    # each of the min(n, cap) rows that a block sends for a lens carries an equal share of the n rows it found
    w = Window.partitionBy("query_id", "lens")
    firsts = got.withColumn("share", 1.0 / F.least(F.col("n"), F.lit(cap)) * F.col("n"))
    sized = firsts.withColumn("n_inside", F.round(F.sum("share").over(w)).cast("bigint")).drop("share", "n")
    by = F.row_number().over(w.orderBy(F.when(F.col("n_inside") > cap, F.round("d", PLACES)), "chunk_id"))
    return sized.withColumn("pos", by).where(F.col("pos") <= cap).select("query_id", "lens", "chunk_id", "pos", "n_inside")


def lens_lists(lenses: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """query_id, lens, chunk_id, pos: members with missing parents put in front (b before a), cut to cap again."""
    inside = members.select("query_id", "lens", "chunk_id", F.col("pos").cast("int").alias("pos"))
    parents = lenses.select("query_id", "lens", F.explode(F.array(F.struct(F.col("a").alias("chunk_id"), F.lit(0).alias("pos")), F.struct(F.col("b").alias("chunk_id"), F.lit(-1).alias("pos")))).alias("p")).select("query_id", "lens", "p.*")
    missing = parents.join(inside, ["query_id", "lens", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id", "lens").orderBy("pos")
    return inside.unionByName(missing).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap)


def ordered_union(points: DataFrame, lists: DataFrame, k_points: int, total: int) -> DataFrame:
    """query_id, chunk_id, rank: first points by rank, then lens lists by lens and position; first occurrences, at most total."""
    p = points.where(F.col("rank") <= k_points).select("query_id", "chunk_id", F.lit(0).alias("lens"), F.col("rank").alias("pos"))
    order = F.struct("lens", "pos")
    first = p.unionByName(lists.select("query_id", "chunk_id", "lens", "pos")).groupBy("query_id", "chunk_id").agg(F.min(order).alias("at"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    return out.where(F.col("rank") <= total).select("query_id", "chunk_id", "rank")


def lens_retrieve(queries: DataFrame, corpus: DataFrame, boxes: DataFrame, params: LensParams = LensParams(), tau: DataFrame | float | None = None) -> dict[str, DataFrame]:
    """points, pairs, lenses, members, lists, union of the whole retrieval, for all queries at once."""
    points = dense_topk(queries, corpus, params.k_descent)
    pairs = lens_pairs(points, boxes, params.beta)
    lenses = lens_candidates(pairs, queries, params.m_lenses, tau)
    members = lens_members(lenses, boxes, params.cap)
    lists = lens_lists(lenses, members, params.cap)
    return {"points": points, "pairs": pairs, "lenses": lenses, "members": members, "lists": lists, "union": ordered_union(points, lists, params.k_points, params.total)}
