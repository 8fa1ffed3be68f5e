"""Queries of the core operators by name, and the SQL that checks them.

Queries take every row whose id is divisible by 20 against all rows; everything else runs over whole tables.
Scores are rounded to 9 places before ranking and to 6 in results, in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import boxes as B
from .functions import metrics as M
from .functions import text as T
from .functions import vectors as V
from .operators import audit, calibrate, retrieval, runs, stats, sweep, world
from .session import cut_lineage, table

ALPHA = 0.35
#: The grid of the index build, and two smaller values, between which the ratio of these vectors passes the target.
GRID = (0.3, 0.35, *calibrate.ALPHA_GRID)

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- vectors -------------------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


_U = "list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))"
_BASE = f"""unit AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_U} AS u FROM embeddings),
q AS (SELECT vec_id AS query_id, label, v AS qv, u AS qu FROM unit WHERE vec_id % 20 = 0),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(qu, u), 9) AS score FROM q, unit))"""
_KNN = """knn AS (SELECT a AS chunk_id, avg(d) AS knn FROM (SELECT a.vec_id AS a, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))), 9), b.vec_id) AS r
  FROM unit a, unit b WHERE a.vec_id <> b.vec_id) WHERE r <= 10 GROUP BY a)"""
_BOXES = f"""bx AS (SELECT vec_id AS chunk_id, v AS c, {ALPHA}::DOUBLE * knn AS h,
  list_transform(v, lambda x: (x - {ALPHA}::DOUBLE * knn)::FLOAT::DOUBLE) AS lo, list_transform(v, lambda x: (x + {ALPHA}::DOUBLE * knn)::FLOAT::DOUBLE) AS hi FROM unit JOIN knn ON vec_id = chunk_id)"""


def _softplus(x: str) -> str:
    y = f"exp(greatest({x}, -50))"
    return f"CASE WHEN {x} > 30 THEN {x} WHEN 1 + {y} = 1 THEN {y} ELSE ln(1 + {y}) * {y} / ((1 + {y}) - 1) END"


_PAIRS = f"""p0 AS (SELECT x.query_id, x.rank AS ra, y.rank AS rb, x.chunk_id AS a, y.chunk_id AS b,
  list_transform(range(1, 65), lambda i: greatest(k.lo[i], l.lo[i])) AS lo, list_transform(range(1, 65), lambda i: least(k.hi[i], l.hi[i])) AS hi
  FROM dense x JOIN dense y ON x.query_id = y.query_id AND x.rank < y.rank AND y.rank <= 20 JOIN bx k ON k.chunk_id = x.chunk_id JOIN bx l ON l.chunk_id = y.chunk_id),
p1 AS (SELECT *, list_transform(range(1, 65), lambda i: (hi[i] - lo[i]) / 0.01::DOUBLE) AS w FROM p0),
p2 AS (SELECT *, list_transform(w, lambda x: (0.01::DOUBLE * ({_softplus('x')}))::FLOAT::DOUBLE) AS sides FROM p1),
pairs AS (SELECT query_id, ra, rb, a, b, lo, hi, sides, list_sum(list_transform(sides, lambda s: ln(greatest(s, 1e-30::DOUBLE)))) AS log_volume FROM p2)"""
_TAU = "tau AS (SELECT quantile_cont(log_volume, 0.5) AS tau FROM pairs)"
_LENS = """l0 AS (SELECT query_id, ra, rb, a, b, log_volume, list_transform(range(1, 65), lambda i: ((lo[i] + hi[i]) / 2 - sides[i] / 2)::FLOAT::DOUBLE) AS mn, list_transform(range(1, 65), lambda i: ((lo[i] + hi[i]) / 2 + sides[i] / 2)::FLOAT::DOUBLE) AS mx
  FROM pairs, tau WHERE log_volume >= tau),
l1 AS (SELECT *, list_transform(range(1, 65), lambda i: (mn[i] + mx[i]) / 2) AS mid FROM l0),
l2 AS (SELECT l1.*, log_volume + ln(greatest(1 + CASE WHEN list_dot_product(qv, qv) > 0 AND list_dot_product(mid, mid) > 0 THEN list_dot_product(qv, mid) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(mid, mid))) ELSE 0 END, 1e-12)) AS log_score FROM l1 JOIN q USING (query_id)),
lenses AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(log_score, 9) DESC, ra, rb) AS INTEGER) AS lens FROM l2) WHERE lens <= 5)"""
_MEMBERS = """m0 AS (SELECT query_id, lens, vec_id AS chunk_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - mid[i]) * (v[i] - mid[i])))), 9) AS d, count(*) OVER (PARTITION BY query_id, lens) AS n_inside
  FROM lenses, unit WHERE len(list_filter(range(1, 65), lambda i: v[i] < mn[i] OR v[i] > mx[i])) = 0),
members AS (SELECT query_id, lens, chunk_id, pos, n_inside FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, lens ORDER BY CASE WHEN n_inside > 10 THEN d END, chunk_id) AS INTEGER) AS pos FROM m0) WHERE pos <= 10)"""
_UNION = """front AS (SELECT query_id, lens, a AS chunk_id, 0 AS pos FROM lenses UNION ALL SELECT query_id, lens, b, -1 FROM lenses),
listed AS (SELECT query_id, lens, chunk_id, row_number() OVER (PARTITION BY query_id, lens ORDER BY pos) AS pos FROM (
  SELECT query_id, lens, chunk_id, pos FROM members UNION ALL SELECT * FROM front ANTI JOIN members USING (query_id, lens, chunk_id))),
ordered AS (SELECT query_id, chunk_id, min(k) AS k FROM (SELECT query_id, chunk_id, rank AS k FROM dense WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, lens * 1000 + pos FROM listed WHERE pos <= 10) GROUP BY ALL),
un AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS rank FROM ordered) WHERE rank <= 25)"""


@query(f"WITH {_BASE} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dense WHERE rank <= 25")
def dense_topk(spark, d):
    return retrieval.dense_topk(_queries(spark, d), _corpus(spark, d), 25).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BASE} SELECT query_id, chunk_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM dense WHERE chunk_id <> query_id) WHERE r <= 10")
def dense_topk_excl_self(spark, d):
    return retrieval.dense_topk(_queries(spark, d), _corpus(spark, d), 10, exclude_self=True).select("query_id", "chunk_id", "rank")


@query("SELECT vec_id AS chunk_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, " + f"round(list_sum({_U}), 6) AS unit_sum FROM embeddings")
def unit_vectors(spark, d):
    return _corpus(spark, d).select("chunk_id", F.round(V.norm("v"), 6).alias("length"), F.round(V.total(V.unit("v")), 6).alias("unit_sum"))


def _matrix(d_in: int = 64, d_out: int = 8) -> list[list[float]]:
    from .sources.writers import projection_matrix

    return [[round(float(x), 6) for x in r] for r in projection_matrix(d_in, d_out)]


def _projected_sql() -> str:
    rows = ", ".join(f"round(list_dot_product(embedding::DOUBLE[], {r}::DOUBLE[]), 6) AS p{i}" for i, r in enumerate(_matrix()))
    return f"SELECT vec_id AS chunk_id, {rows} FROM embeddings"


@query(_projected_sql())
def projected_vectors(spark, d):
    p = V.project("v", _matrix())
    return _corpus(spark, d).select("chunk_id", p.alias("p")).select("chunk_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(8)])


@query(f"WITH {_BASE}, {_KNN} SELECT chunk_id, round(knn, 6) AS knn FROM knn")
def self_knn_mean(spark, d):
    return retrieval.self_knn_mean(_corpus(spark, d)).select("chunk_id", F.round("knn", 6).alias("knn"))


def _boxes(spark, d, alpha: float = ALPHA) -> DataFrame:
    corpus = _corpus(spark, d)
    return cut_lineage(retrieval.build_boxes(corpus, retrieval.self_knn_mean(corpus), alpha))


# ---- boxes ---------------------------------------------------------------------------------------------------------

_STORED = """b AS (SELECT chunk_id, row_idx, center::DOUBLE[] AS c, half_width AS h, list_transform(center::DOUBLE[], lambda x: (x - half_width)::FLOAT::DOUBLE) AS lo, list_transform(center::DOUBLE[], lambda x: (x + half_width)::FLOAT::DOUBLE) AS hi
FROM (SELECT DISTINCT chunk_id, row_idx, center, half_width FROM boxes WHERE len(center) = 16 AND half_width IS NOT NULL AND len(list_filter(center, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0))"""


def _stored(spark, d) -> DataFrame:
    b = table(spark, d, "boxes").where((F.size("center") == 16) & F.col("half_width").isNotNull() & F.forall("center", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).distinct()
    c = F.col("center").cast("array<double>")
    return b.select("chunk_id", "row_idx", c.alias("c"), F.col("half_width").alias("h"), B.lower(c, F.col("half_width")).alias("lo"), B.upper(c, F.col("half_width")).alias("hi"))


@query(f"WITH {_STORED} SELECT chunk_id, row_idx, round(lo[1], 6) AS lo_0, round(hi[16], 6) AS hi_15, round((lo[3] + hi[3]) / 2, 6) AS mid_2, round((hi[5] - lo[5]) / 2, 6) AS half_4 FROM b")
def box_corners(spark, d):
    mid, half = B.middle(F.col("lo"), F.col("hi")), B.half_width(F.col("lo"), F.col("hi"))
    return _stored(spark, d).select("chunk_id", "row_idx", F.round(F.col("lo")[0], 6).alias("lo_0"), F.round(F.col("hi")[15], 6).alias("hi_15"), F.round(mid[2], 6).alias("mid_2"), F.round(half[4], 6).alias("half_4"))


@query(f"WITH {_STORED} SELECT chunk_id, row_idx, round(CASE WHEN list_min(list_transform(range(1, 17), lambda i: hi[i] - lo[i])) <= 0 THEN NULL ELSE list_sum(list_transform(range(1, 17), lambda i: ln(greatest(hi[i] - lo[i], 1e-300)))) END, 6) AS log_volume FROM b")
def box_log_volume(spark, d):
    lv = B.box_log_volume(F.col("lo"), F.col("hi"))
    return _stored(spark, d).select("chunk_id", "row_idx", F.round(F.when(lv > float("-inf"), lv), 6).alias("log_volume"))


@query(f"""WITH {_STORED}, n AS (SELECT *, lead(lo) OVER (ORDER BY row_idx, chunk_id, h, c) AS lo_b, lead(hi) OVER (ORDER BY row_idx, chunk_id, h, c) AS hi_b FROM b),
w AS (SELECT chunk_id, row_idx, list_transform(range(1, 17), lambda i: (least(hi[i], hi_b[i]) - greatest(lo[i], lo_b[i])) / 0.1::DOUBLE) AS w FROM n WHERE lo_b IS NOT NULL)
SELECT chunk_id, row_idx, round(list_sum(list_transform(w, lambda x: ln(0.1::DOUBLE * ({_softplus('x')}) + 1e-6::DOUBLE))), 5) AS soft_log_volume FROM w""")
def soft_pair_log_volume(spark, d):
    """Trainable-box volume of each stored box and the next: neighbours in the order of row_idx, found by a range-sorted self join."""
    b = _stored(spark, d)
    order = [F.col("row_idx"), F.col("chunk_id"), F.col("h"), F.col("c")]
    # rows are numbered within ranges of row_idx, so that no window holds all rows
    part = F.floor(F.col("row_idx") / 1000)
    numbered = b.withColumn("p", part).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*order)))
    w = Window.partitionBy("p").orderBy("i")
    inner = numbered.withColumn("lo_b", F.lead("lo").over(w)).withColumn("hi_b", F.lead("hi").over(w))
    firsts = numbered.where("i = 1").select("p", F.col("lo").alias("lo_n"), F.col("hi").alias("hi_n"))
    ranges = firsts.select("p").withColumn("q", F.lag("p").over(Window.orderBy("p")))  # a row for each thousand
    nxt = firsts.join(ranges, "p").where("q is not null").select(F.col("q").alias("p"), "lo_n", "hi_n")
    full = inner.join(nxt, "p", "left").withColumn("lo_b", F.coalesce("lo_b", "lo_n")).withColumn("hi_b", F.coalesce("hi_b", "hi_n")).where("lo_b is not null")
    lv = B.soft_log_volume(B.overlap_lo(F.col("lo"), F.col("lo_b")), B.overlap_hi(F.col("hi"), F.col("hi_b")))
    return full.select("chunk_id", "row_idx", F.round(lv, 5).alias("soft_log_volume"))


# ---- lens retrieval ------------------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    points = retrieval.dense_topk(_queries(spark, d), _corpus(spark, d), 20)
    return cut_lineage(retrieval.lens_pairs(points, _boxes(spark, d)))


_TO_PAIRS = f"WITH {_BASE}, {_KNN}, {_BOXES}, {_PAIRS}"
_TO_LENS = f"{_TO_PAIRS}, {_TAU}, {_LENS}"
_TO_UNION = f"{_TO_LENS}, {_MEMBERS}, {_UNION}"


@query(f"{_TO_PAIRS} SELECT query_id, a, b, CAST(ra AS INTEGER) AS ra, CAST(rb AS INTEGER) AS rb, round(log_volume, 5) AS log_volume FROM pairs")
def pair_log_volume(spark, d):
    return _pairs(spark, d).select("query_id", "a", "b", "ra", "rb", F.round("log_volume", 5).alias("log_volume"))


@query(f"{_TO_PAIRS} SELECT round(quantile_cont(log_volume, 0.5), 5) AS tau, count(*) AS n_pairs, round(min(log_volume), 5) AS min, round(quantile_cont(log_volume, 0.1), 5) AS p10, round(quantile_cont(log_volume, 0.9), 5) AS p90, round(max(log_volume), 5) AS max FROM pairs")
def tau_v(spark, d):
    return calibrate.tau_of(_pairs(spark, d)).select(*[F.round(c, 5).alias(c) if c != "n_pairs" else c for c in ("tau", "n_pairs", "min", "p10", "p90", "max")])


@query(f"{_TO_PAIRS}, {_TAU} SELECT query_id, count(*) AS n_kept, round(max(log_volume), 5) AS best FROM pairs, tau WHERE log_volume >= tau GROUP BY query_id")
def pair_volume_threshold(spark, d):
    pairs = _pairs(spark, d)
    return pairs.where(F.col("log_volume") >= calibrate.tau_of(pairs).first().tau).groupBy("query_id").agg(F.count("*").alias("n_kept"), F.round(F.max("log_volume"), 5).alias("best"))


def _lensed(spark, d) -> dict[str, DataFrame]:
    queries, corpus, boxes = _queries(spark, d), _corpus(spark, d), _boxes(spark, d)
    params = retrieval.LensParams()
    points = cut_lineage(retrieval.dense_topk(queries, corpus, 25))
    pairs = cut_lineage(retrieval.lens_pairs(points.where(F.col("rank") <= params.k_descent), boxes))
    lenses = cut_lineage(retrieval.lens_candidates(pairs, queries, params.m_lenses, calibrate.tau_of(pairs).select("tau")))
    return {"queries": queries, "corpus": corpus, "boxes": boxes, "points": points, "lenses": lenses}


def _unioned(spark, d) -> dict[str, DataFrame]:
    x, p = _lensed(spark, d), retrieval.LensParams()
    members = cut_lineage(retrieval.lens_members(x["lenses"], x["boxes"], p.cap))
    lists = retrieval.lens_lists(x["lenses"], members, p.cap)
    return x | {"members": members, "lists": lists, "union": retrieval.ordered_union(x["points"], lists, p.k_points, p.total)}


@query(f"{_TO_LENS} SELECT query_id, lens, a, b, round(mid[1], 5) AS mid_0, round(mx[64] - mn[64], 5) AS side_63, round(log_score, 5) AS log_score FROM lenses")
def lens_candidates(spark, d):
    return _lensed(spark, d)["lenses"].select("query_id", "lens", "a", "b", F.round(F.col("mid")[0], 5).alias("mid_0"), F.round(F.col("max")[63] - F.col("min")[63], 5).alias("side_63"), F.round("log_score", 5).alias("log_score"))


@query(f"{_TO_LENS}, {_MEMBERS} SELECT * FROM members")
def lens_contained(spark, d):
    return _unioned(spark, d)["members"]


@query(f"{_TO_UNION} SELECT * FROM un")
def lens_union(spark, d):
    return _unioned(spark, d)["union"]


# ---- calibration ---------------------------------------------------------------------------------------------------

_GRID = ", ".join(f"({a}::DOUBLE)" for a in GRID)
_RATIOS = f"""WITH {_BASE}, {_KNN}, grid(alpha) AS (VALUES {_GRID}),
num AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM unit),
draw AS (SELECT i, ('0x' || substr(md5(i || ':a:1337'), 1, 8))::BIGINT % (SELECT count(*) FROM num) AS ia, ('0x' || substr(md5(i || ':b:1337'), 1, 8))::BIGINT % (SELECT count(*) FROM num) AS ib FROM range(1000) t(i)),
ab AS (SELECT i, x.chunk_id AS a, y.chunk_id AS b FROM draw JOIN num x ON ia = x.idx JOIN num y ON ib = y.idx WHERE ia <> ib),
bx AS (SELECT alpha, vec_id AS chunk_id, list_transform(v, lambda x: (x - alpha * knn)::FLOAT::DOUBLE) AS lo, list_transform(v, lambda x: (x + alpha * knn)::FLOAT::DOUBLE) AS hi FROM unit JOIN knn ON vec_id = chunk_id, grid),
own AS (SELECT alpha, quantile_cont(list_sum(list_transform(range(1, 65), lambda i: ln(hi[i] - lo[i]))), 0.5) AS median_log_box FROM bx GROUP BY alpha),
w AS (SELECT x.alpha, list_transform(range(1, 65), lambda i: (least(x.hi[i], y.hi[i]) - greatest(x.lo[i], y.lo[i])) / 0.01::DOUBLE) AS w FROM ab JOIN bx x ON x.chunk_id = a JOIN bx y ON y.chunk_id = b AND x.alpha = y.alpha),
s AS (SELECT alpha, list_transform(w, lambda x: (0.01::DOUBLE * ({_softplus('x')}))::FLOAT::DOUBLE) AS sides FROM w),
two AS (SELECT alpha, quantile_cont(list_sum(list_transform(sides, lambda s: ln(greatest(s, 1e-30::DOUBLE)))), 0.5) AS median_log_pair FROM s GROUP BY alpha),
ratios AS (SELECT alpha, median_log_box, median_log_pair, exp(median_log_pair - median_log_box) AS ratio FROM own JOIN two USING (alpha))"""


def _ratios(spark, d, grid=GRID) -> DataFrame:
    corpus = _corpus(spark, d)
    # pairs are drawn by position in the order of ids
    ids = cut_lineage(_in_order(corpus.select("chunk_id")))
    return calibrate.alpha_ratios(corpus, cut_lineage(retrieval.self_knn_mean(corpus)), calibrate.draw_pairs(ids, 1000), grid)


def _in_order(ids: DataFrame) -> DataFrame:
    """chunk_id and idx from 0 in the order of integer ids: numbered within ranges of a thousand ids, shifted by those before."""
    part = ids.withColumn("p", F.floor(F.col("chunk_id") / 1000))
    before = part.groupBy("p").agg(F.count("*").alias("n"))
    before = before.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each thousand
    return part.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("chunk_id"))).join(before, "p").select("chunk_id", (F.col("before") + F.col("r") - 1).alias("idx"))


@query(f"{_RATIOS} SELECT alpha, round(median_log_box, 4) AS median_log_box, round(median_log_pair, 4) AS median_log_pair FROM ratios")
def alpha_grid_ratio(spark, d):
    return _ratios(spark, d).select("alpha", F.round("median_log_box", 4).alias("median_log_box"), F.round("median_log_pair", 4).alias("median_log_pair"))


@query(f"{_RATIOS} SELECT alpha FROM ratios ORDER BY abs(ln(greatest(ratio, 1e-30)) - ln(0.05)), alpha LIMIT 1")
def alpha_choice(spark, d):
    return calibrate.choose_alpha(_ratios(spark, d)).select("alpha")


# ---- retrieval metrics ---------------------------------------------------------------------------------------------

_GOLD = "gold AS (SELECT query_id, chunk_id, pos FROM (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS pos FROM q JOIN unit ON q.label = unit.label AND vec_id <> query_id) WHERE pos <= 2)"
_EVAL = f"""{_TO_UNION}, {_GOLD},
gl AS (SELECT query_id, list(chunk_id ORDER BY pos) AS gold FROM gold GROUP BY 1), dl AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ranked FROM dense WHERE rank <= 25 GROUP BY 1), ul AS (SELECT query_id, list(chunk_id ORDER BY rank) AS lensed FROM un GROUP BY 1),
ev AS (SELECT * FROM q JOIN dl USING (query_id) LEFT JOIN ul USING (query_id) LEFT JOIN gl USING (query_id))"""


def _gold(spark, d) -> DataFrame:
    q = _queries(spark, d).select("query_id", "label")
    firsts = _corpus(spark, d).select("chunk_id", "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("chunk_id"))).where("r <= 3")
    both = q.join(firsts, "label").where("chunk_id <> query_id")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("pos <= 2").select("query_id", "chunk_id", "pos")


def _evaluated(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    x = _unioned(spark, d)
    gold = runs.ranked_lists(_gold(spark, d).withColumnRenamed("pos", "rank")).withColumnRenamed("ranked", "gold")
    base, lens = runs.ranked_lists(x["points"]), runs.ranked_lists(x["union"]).withColumnRenamed("ranked", "lensed")
    return x["queries"].select("query_id", "label").join(base, "query_id").join(lens, "query_id", "left").join(gold, "query_id", "left"), x


@query(f"""{_EVAL} SELECT query_id, CASE WHEN len(list_filter(gold, lambda g: NOT list_contains(ranked, g))) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS base_pair_25, CASE WHEN len(list_filter(gold, lambda g: NOT list_contains(lensed, g))) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS lens_pair_25,
CASE WHEN len(list_filter(gold, lambda g: NOT list_contains(ranked[1:10], g))) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS base_pair_10, CASE WHEN len(list_filter(gold, lambda g: list_contains(ranked, g))) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS base_any_25, CASE WHEN len(list_filter(gold, lambda g: list_contains(lensed, g))) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS lens_any_25 FROM ev""")
def retrieval_recall(spark, d):
    ev, _ = _evaluated(spark, d)
    g, r, u = F.col("gold"), F.col("ranked"), F.col("lensed")
    return ev.select("query_id", M.pair_recall_at_k(r, g, 25).alias("base_pair_25"), M.pair_recall_at_k(u, g, 25).alias("lens_pair_25"), M.pair_recall_at_k(r, g, 10).alias("base_pair_10"), M.any_gold_at_k(r, g, 25).alias("base_any_25"), M.any_gold_at_k(u, g, 25).alias("lens_any_25"))


@query(f"{_EVAL} SELECT query_id, CASE WHEN len(list_filter(gold, lambda g: NOT list_contains(ranked, g))) = 0 THEN round(1.0::DOUBLE / list_max(list_transform(gold, lambda g: list_position(ranked, g))), 6) ELSE 0.0 END AS rr FROM ev")
def first_completion_rr(spark, d):
    ev, _ = _evaluated(spark, d)
    return ev.select("query_id", F.round(M.first_completion_rr(F.col("ranked"), F.col("gold")), 6).alias("rr"))


@query(f"{_EVAL} SELECT query_id, count(*) > 0 AND bool_or(list_contains(gold, a) AND list_contains(gold, b)) AS covered FROM ev JOIN lenses USING (query_id) GROUP BY query_id")
def lens_coverage(spark, d):
    ev, x = _evaluated(spark, d)
    parents = x["lenses"].groupBy("query_id").agg(F.collect_list(F.array("a", "b")).alias("parents"))  # five a query
    return ev.join(parents, "query_id").select("query_id", M.covered(F.col("parents"), F.coalesce("gold", F.array().cast("array<bigint>"))).alias("covered"))


@query(f"""{_EVAL}, o AS (SELECT len(list_filter(ranked, lambda x: list_contains(lensed, x))) AS shared, len(list_filter(ranked, lambda x: NOT list_contains(lensed, x))) AS only_base, len(lensed) AS size FROM ev)
SELECT count(*) AS n, round(avg(shared), 6) AS mean_shared, round(quantile_cont(shared::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(shared::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(shared::DOUBLE, 0.9), 6) AS p90, round(avg(only_base), 6) AS mean_only_base, round(avg(size), 6) AS mean_size FROM o""")
def context_overlap(spark, d):
    ev, _ = _evaluated(spark, d)
    o = ev.select(F.size(F.array_intersect("ranked", "lensed")).alias("shared"), F.size(F.array_except("ranked", "lensed")).alias("only_base"), F.size("lensed").alias("size"))
    p = lambda q: F.round(F.percentile("shared", q), 6)
    return o.agg(F.count("*").alias("n"), F.round(F.avg("shared"), 6).alias("mean_shared"), p(0.5).alias("p50"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.round(F.avg("only_base"), 6).alias("mean_only_base"), F.round(F.avg("size"), 6).alias("mean_size"))


@query(f"{_EVAL} SELECT label, count(*) AS n, round(avg(len(list_filter(gold, lambda g: list_contains(ranked, g))) / len(gold)), 6) AS base_rate, round(avg(len(list_filter(gold, lambda g: list_contains(lensed, g))) / len(gold)), 6) AS lens_rate FROM ev GROUP BY label HAVING count(*) >= 2")
def gold_recall_rates(spark, d):
    ev, _ = _evaluated(spark, d)
    share = lambda c: F.round(F.avg(F.size(F.array_intersect("gold", c)) / F.size("gold")), 6)
    return ev.groupBy("label").agg(F.count("*").alias("n"), share("ranked").alias("base_rate"), share("lensed").alias("lens_rate")).where("n >= 2")


# ---- sweep ---------------------------------------------------------------------------------------------------------


def _points(spark, d, k: int = 200) -> DataFrame:
    return cut_lineage(retrieval.dense_topk(_queries(spark, d), _corpus(spark, d), k))


_GT = "gt AS (SELECT DISTINCT query_id, title FROM gold JOIN (SELECT vec_id AS chunk_id, (vec_id % 7)::VARCHAR AS title FROM unit) USING (chunk_id))"


@query(f"WITH {_BASE} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 25")
def sweep_dense(spark, d):
    return sweep.dense(_points(spark, d))


@query(f"""WITH {_BASE}, {_GOLD}, o AS (SELECT query_id, chunk_id, min(k) AS k FROM (SELECT query_id, chunk_id, pos AS k FROM gold UNION ALL SELECT query_id, chunk_id, 1000 + rank FROM dense WHERE rank <= 200) GROUP BY 1, 2)
SELECT query_id, chunk_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS r FROM o) WHERE r <= 25""")
def sweep_oracle(spark, d):
    return sweep.oracle(_points(spark, d), _gold(spark, d))


@query(f"""WITH {_BASE}, {_GOLD}, {_GT}, o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM (SELECT query_id, chunk_id, rank, (chunk_id % 7)::VARCHAR AS title FROM dense WHERE rank <= 200) ANTI JOIN gt USING (query_id, title))
SELECT query_id, chunk_id, CAST(r AS INTEGER) AS rank FROM o WHERE r <= 25""")
def sweep_gold_removed(spark, d):
    titles = _corpus(spark, d).select("chunk_id", (F.col("chunk_id") % 7).cast("string").alias("title"))
    gold = _gold(spark, d).join(titles, "chunk_id").select("query_id", "title")
    return sweep.gold_removed(_points(spark, d), titles, gold)


@query(f"""WITH {_BASE}, c AS (SELECT vec_id AS chunk_id, md5(vec_id || ':1337') AS h FROM unit), pl AS (SELECT chunk_id, row_number() OVER (ORDER BY substr(h, 1, 2), h, chunk_id) - 1 AS place FROM c),
w AS (SELECT query_id, k, (('0x' || substr(md5(query_id || ':1337'), 1, 8))::BIGINT % (SELECT count(*) FROM pl) + k) % (SELECT count(*) FROM pl) AS place FROM q, range(25) t(k))
SELECT query_id, chunk_id, CAST(k + 1 AS INTEGER) AS rank FROM w JOIN pl USING (place)""")
def sweep_random(spark, d):
    return sweep.random_chunks(_queries(spark, d), _corpus(spark, d))


# ---- text and answers ----------------------------------------------------------------------------------------------

_WS = T.SPACE_CLASS + "+"
_PUNCT = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""


def _norm(col: str) -> str:
    bare = f"translate(lower({col}), '{_PUNCT}', '')"
    parts = f"string_split(regexp_replace({bare}, '([^\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"trim(regexp_replace(list_aggregate(list_transform({parts}, lambda p: CASE WHEN p IN ('a', 'an', 'the') THEN ' ' ELSE p END), 'string_agg', ''), '{_WS}', ' ', 'g'))"


_SCORED = f"""g AS (SELECT DISTINCT gen_id, id, condition, answer, error FROM generations), m AS (SELECT DISTINCT id, dataset, n_hops, answer AS gold FROM multihop_questions WHERE answer IS NOT NULL),
n AS (SELECT gen_id, id, condition, dataset, n_hops, error, {_norm('coalesce(g.answer, chr(32))')} AS p, {_norm('gold')} AS o FROM g JOIN m USING (id)),
t AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS a, list_filter(string_split(o, ' '), lambda x: x <> '') AS b FROM n),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0)::DOUBLE AS shared FROM t),
scored AS (SELECT gen_id, id, condition, dataset, n_hops, error, CASE WHEN p = o THEN 1.0::DOUBLE ELSE 0.0 END AS em,
  CASE WHEN p IN ('yes', 'no', 'noanswer') OR o IN ('yes', 'no', 'noanswer') THEN CASE WHEN p = o THEN 1.0::DOUBLE ELSE 0.0 END WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0::DOUBLE ELSE 0.0 END
  WHEN shared = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (shared / len(a)) * (shared / len(b)) / (shared / len(a) + shared / len(b)) END AS f1 FROM c)"""


def _scored(spark, d) -> DataFrame:
    g = table(spark, d, "generations").select("gen_id", "id", "condition", "answer", "error").distinct()
    m = table(spark, d, "multihop_questions").where("answer is not null").select("id", "dataset", "n_hops", F.col("answer").alias("gold")).distinct()
    both = g.join(m, "id")
    said = F.coalesce("answer", F.lit(""))
    kept = ("gen_id", "id", "condition", "dataset", "n_hops", "error")
    return both.select(*kept, T.answer_scores(said, F.col("gold")).alias("s")).select(*kept, "s.em", "s.f1")


@query(f"WITH {_SCORED} SELECT gen_id, id, round(f1, 6) AS f1, em FROM scored")
def answer_f1(spark, d):
    return _scored(spark, d).select("gen_id", "id", F.round("f1", 6).alias("f1"), "em")


@query(f"WITH {_SCORED} SELECT condition, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em, sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS errors FROM scored GROUP BY condition")
def answer_em(spark, d):
    return _scored(spark, d).groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("em"), 6).alias("em"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query(f"SELECT DISTINCT chunk_id, trim(regexp_replace(replace(title, '_', ' '), '{_WS}', ' ', 'g')) AS title FROM passages WHERE title IS NOT NULL")
def title_normalize(spark, d):
    return table(spark, d, "passages").where("title is not null").select("chunk_id", T.normalize_title(F.col("title")).alias("title")).distinct()


@query("SELECT chunk_id, md5(concat_ws(' | ', title, text)) AS digest, length(concat_ws(' | ', title, text)) AS n FROM passages")
def passage_text(spark, d):
    p = T.passage_text(F.col("title"), F.col("text"))
    return table(spark, d, "passages").select("chunk_id", F.md5(p).alias("digest"), F.length(p).cast("bigint").alias("n"))


_FETCH = """r AS (SELECT DISTINCT gen_id, retrieved_chunk_ids FROM generations), e AS (SELECT gen_id, unnest(retrieved_chunk_ids) AS chunk_id, generate_subscripts(retrieved_chunk_ids, 1) AS rank FROM r),
l AS (SELECT gen_id, list('[' || n || '] (' || title || ') ' || text ORDER BY rank) AS lines FROM (SELECT gen_id, rank, row_number() OVER (PARTITION BY gen_id ORDER BY rank, chunk_id) AS n, coalesce(title, '') AS title, coalesce(text, '') AS text FROM e JOIN passages USING (chunk_id)) GROUP BY gen_id)"""


@query(f"WITH {_FETCH}, s AS (SELECT DISTINCT gen_id, id FROM generations) SELECT gen_id, md5('Passages:' || chr(10) || coalesce(list_aggregate(lines, 'string_agg', chr(10)), '') || chr(10) || chr(10) || 'Question: ' || coalesce(id, '') || chr(10) || 'Answer:') AS digest FROM s LEFT JOIN l USING (gen_id)")
def prompt_text(spark, d):
    g = table(spark, d, "generations")
    got = g.select(F.col("gen_id").alias("query_id"), "retrieved_chunk_ids").distinct().select("query_id", F.posexplode("retrieved_chunk_ids").alias("rank", "chunk_id"))
    chunks = runs.fetch_chunks(got, table(spark, d, "passages"))
    asked = g.select(F.col("gen_id").alias("query_id"), F.col("id").alias("question")).distinct()
    return runs.with_prompt(asked, chunks).select(F.col("query_id").alias("gen_id"), F.md5("prompt").alias("digest"))


# ---- runs ----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT id, dataset, coalesce(n_hops, -1) AS n_hops FROM multihop_questions WHERE id NOT IN (SELECT id FROM generations WHERE condition = 'oracle' AND id IS NOT NULL)")
def resume_todo(spark, d):
    done = table(spark, d, "generations").where("condition = 'oracle'")
    return runs.todo(table(spark, d, "multihop_questions"), done, ["id"]).select("id", "dataset", F.coalesce("n_hops", F.lit(-1)).alias("n_hops")).distinct()


@query("WITH a AS (SELECT DISTINCT id FROM generations WHERE condition = 'baseline'), b AS (SELECT DISTINCT id FROM generations WHERE condition = 'oracle') SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS in_both, count(*) FILTER (b.id IS NULL) AS only_first, count(*) FILTER (a.id IS NULL) AS only_second FROM a FULL JOIN b ON a.id = b.id")
def run_alignment(spark, d):
    g = table(spark, d, "generations")
    return runs.alignment(g.where("condition = 'baseline'"), g.where("condition = 'oracle'"), "id")


@query("SELECT id, gen_id, condition FROM (SELECT DISTINCT id, gen_id, condition, arrived_at FROM generations) QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC, gen_id DESC) = 1")
def latest_record(spark, d):
    g = table(spark, d, "generations").select("id", "gen_id", "condition", "arrived_at")
    return runs.latest(g, "id", ["arrived_at", "gen_id"]).select("id", "gen_id", "condition")


@query("SELECT substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 16) AS digest, count(*) AS n FROM (SELECT id FROM (SELECT DISTINCT id FROM multihop_questions) ORDER BY md5(id || ':1337'), id LIMIT 1000)")
def id_digest(spark, d):
    return runs.id_digest(runs.sample_ids(table(spark, d, "multihop_questions").select("id").distinct(), "id", 1000), "id")


@query("SELECT id, condition, count(DISTINCT gen_id) AS n FROM generations GROUP BY 1, 2 HAVING count(DISTINCT gen_id) > 1")
def repeated_keys(spark, d):
    return table(spark, d, "generations").groupBy("id", "condition").agg(F.countDistinct("gen_id").alias("n")).where("n > 1")


# ---- audit ---------------------------------------------------------------------------------------------------------

_FACTS = "f AS (SELECT title, count(*) AS n FROM (SELECT unnest(supporting_titles) AS title FROM hotpot_questions) WHERE title IS NOT NULL GROUP BY 1), h AS (SELECT title, count(*) AS k FROM passages WHERE title IS NOT NULL GROUP BY 1), t AS (SELECT title, n, coalesce(k, 0) AS k FROM f LEFT JOIN h USING (title))"


def _facts(spark, d) -> DataFrame:
    return table(spark, d, "hotpot_questions").select(F.explode("supporting_titles").alias("title"))


@query(f"WITH {_FACTS} SELECT sum(n)::BIGINT AS n_facts, count(*) AS n_titles, count(*) FILTER (k = 0) AS n_missing_titles, coalesce(sum(n) FILTER (k = 0), 0)::BIGINT AS n_missing_facts, count(*) FILTER (k > 1) AS n_ambiguous_titles FROM t")
def corpus_audit(spark, d):
    return audit.corpus_audit(_facts(spark, d), table(spark, d, "passages"))


@query(f"WITH {_FACTS} SELECT title, n FROM t WHERE k = 0 ORDER BY n DESC, title LIMIT 20")
def top_missing(spark, d):
    return audit.top_missing(_facts(spark, d), table(spark, d, "passages"))


@query("""WITH q AS (SELECT DISTINCT dataset, id, gold_titles FROM multihop_questions), h AS (SELECT DISTINCT title FROM passages WHERE title IS NOT NULL),
e AS (SELECT dataset, id, title, h.title IS NOT NULL AS hit FROM (SELECT dataset, id, unnest(gold_titles) AS title FROM q) LEFT JOIN h USING (title)),
p AS (SELECT dataset, id, count(title) AS gold, count(*) FILTER (hit AND title IS NOT NULL) AS hits FROM e GROUP BY 1, 2), f AS (SELECT k.dataset, k.id, coalesce(gold, 0) AS gold, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT dataset, id FROM q) k LEFT JOIN p ON k.dataset = p.dataset AND k.id = p.id)
SELECT dataset, count(*) AS n, round(avg(CASE WHEN hits = gold THEN 1.0 ELSE 0.0 END), 6) AS all_rate, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_rate FROM f GROUP BY dataset""")
def corpus_coverage(spark, d):
    q = table(spark, d, "multihop_questions").select("dataset", "id", "gold_titles").distinct()
    return audit.corpus_coverage(q, table(spark, d, "passages"), "dataset", "id", "gold_titles").select("dataset", "n", F.round("all_rate", 6).alias("all_rate"), F.round("any_rate", 6).alias("any_rate"))


@query("SELECT dataset, coalesce(n_hops, -1) AS n_hops, count(*) AS n FROM (SELECT DISTINCT id, dataset, n_hops FROM multihop_questions) GROUP BY 1, 2")
def hop_distribution(spark, d):
    return audit.hop_distribution(table(spark, d, "multihop_questions").select("id", "dataset", F.coalesce("n_hops", F.lit(-1)).alias("n_hops")).distinct())


@query("SELECT rec_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(supporting_facts, lambda f: f.title), lambda t: t IS NOT NULL))), '|') AS titles FROM hotpot_questions WHERE supporting_facts IS NOT NULL")
def supporting_titles(spark, d):
    t = F.sort_array(F.array_distinct(F.filter(F.transform("supporting_facts", lambda f: f["title"]), lambda x: x.isNotNull())))
    return table(spark, d, "hotpot_questions").where("supporting_facts is not null").select("rec_no", F.array_join(t, "|").alias("titles"))


# ---- statistics ----------------------------------------------------------------------------------------------------

_BOOT = """sz AS (SELECT grp, count(*) AS n, avg(x) AS point_estimate FROM v GROUP BY grp), ix AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY k, x) - 1 AS idx FROM v),
dr AS (SELECT grp, n, r, ('0x' || substr(md5(r || ':' || slot || ':1337'), 1, 8))::BIGINT % n AS idx FROM sz, range(20) a(r), LATERAL (SELECT unnest(range(n)) AS slot) b),
mn AS (SELECT dr.grp, r, sum(x) / any_value(n) AS m FROM dr JOIN ix ON dr.grp = ix.grp AND dr.idx = ix.idx GROUP BY dr.grp, r)
SELECT sz.grp, round(any_value(point_estimate), 6) AS point_estimate, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM sz JOIN mn ON sz.grp = mn.grp GROUP BY sz.grp"""


def _interval(df: DataFrame) -> DataFrame:
    out = stats.bootstrap_hash(df, ["grp"], "k", "x", n_resamples=20)
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("point_estimate", "ci_low", "ci_high")])


@query(f"WITH {_SCORED}, v AS (SELECT condition AS grp, gen_id || ':' || id AS k, round(f1, 9) AS x FROM scored), {_BOOT}")
def bootstrap_mean_ci(spark, d):
    s = cut_lineage(_scored(spark, d))
    return _interval(s.select(F.col("condition").alias("grp"), F.concat_ws(":", "gen_id", "id").alias("k"), F.round("f1", 9).alias("x")))


def _interval_10k(df: DataFrame) -> DataFrame:
    out = stats.bootstrap_numpy(df, ["grp"], "x", key="k")
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("point_estimate", "ci_low", "ci_high")], "n_resamples")


@query()
def bootstrap_mean_ci_10k(spark, d):
    s = _scored(spark, d)
    return _interval_10k(s.select(F.col("condition").alias("grp"), F.concat_ws(":", "gen_id", "id").alias("k"), F.round("f1", 9).alias("x")))


_PAIRED = "v AS (SELECT dataset AS grp, id AS k, round(b - a, 9) AS x FROM (SELECT dataset, id, avg(f1) FILTER (condition = 'baseline') AS a, avg(f1) FILTER (condition = 'oracle') AS b FROM scored GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL)"


def _paired(spark, d) -> DataFrame:
    s = _scored(spark, d)
    by = s.groupBy("dataset", "id").agg(F.avg(F.when(F.col("condition") == "baseline", F.col("f1"))).alias("a"), F.avg(F.when(F.col("condition") == "oracle", F.col("f1"))).alias("b"))
    return cut_lineage(by.where("a is not null and b is not null").select(F.col("dataset").alias("grp"), F.col("id").alias("k"), F.round(F.col("b") - F.col("a"), 9).alias("x")))


@query(f"WITH {_SCORED}, {_PAIRED}, {_BOOT}")
def bootstrap_paired_ci(spark, d):
    return _interval(_paired(spark, d))


@query()
def bootstrap_paired_ci_10k(spark, d):
    return _interval_10k(_paired(spark, d))


@query(f"WITH {_SCORED} SELECT CASE WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(n_hops) = 0 THEN 'n_hops' ELSE 'all' END AS stratum, coalesce(dataset, n_hops::VARCHAR, '') AS level, count(*) AS n, round(avg(f1), 6) AS mean FROM scored GROUP BY GROUPING SETS ((), (dataset), (n_hops))")
def strata_summary(spark, d):
    return stats.strata_summary(_scored(spark, d), ["dataset", "n_hops"], "f1").withColumn("mean", F.round("mean", 6)).withColumn("level", F.coalesce("level", F.lit("")))


@query(f"WITH {_SCORED}, cells AS (SELECT condition, count(*) AS n, avg(f1) AS mean, stddev_pop(f1) AS sd, var_pop(f1) AS v FROM scored GROUP BY condition) SELECT condition, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((SELECT sqrt(avg(v)) FROM cells), 6) AS pooled_sd FROM cells")
def seed_pooled_sd(spark, d):
    return stats.pooled_deviation(_scored(spark, d), "condition", "f1").select("condition", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "pooled_sd")])


@query(f"""WITH {_SCORED}, {_PAIRED}, l AS (SELECT grp, 100 * avg(x) AS lift FROM v GROUP BY grp), k AS (SELECT dataset, avg(CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END) AS cov FROM scored GROUP BY dataset),
s AS (SELECT count(*) AS n_eligible, count(*) FILTER (lift >= 5) AS n_go, count(*) FILTER (lift >= 2) AS n_weak, min(lift) AS worst FROM l JOIN k ON grp = dataset WHERE coalesce(cov, 0) >= 0.7)
SELECT n_eligible, n_go, n_weak, round(worst, 4) AS worst, CASE WHEN n_go = n_eligible AND n_eligible >= 3 THEN 'GO' WHEN n_weak >= 2 AND worst >= -1 THEN 'WEAK GO' ELSE 'NO-GO' END AS verdict FROM s""")
def decision_datasets(spark, d):
    lift = _paired(spark, d).groupBy("grp").agg((100 * F.avg("x")).alias("lift"))
    cov = _scored(spark, d).groupBy(F.col("dataset").alias("grp")).agg(F.avg(F.col("error").isNull().cast("double")).alias("cov"))
    return stats.dataset_decision(lift.join(cov, "grp"), "lift", "cov").select("n_eligible", "n_go", "n_weak", F.round("worst", 4).alias("worst"), "verdict")


@query(f"""WITH {_SCORED}, {_PAIRED}, s AS (SELECT grp, 100 * avg(x) AS lift, avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END) AS cov FROM v GROUP BY grp)
SELECT grp, round(lift, 4) AS lift, CASE WHEN lift >= 2 AND cov >= 0.3 THEN 'GO' WHEN lift >= 1 AND cov >= 0.15 THEN 'WEAK GO' ELSE 'NO-GO' END AS decision FROM s""")
def decision_answers(spark, d):
    s = _paired(spark, d).groupBy("grp").agg((100 * F.avg("x")).alias("lift"), F.avg((F.col("x") >= 0).cast("double")).alias("cov"))
    return s.select("grp", F.round("lift", 4).alias("lift"), stats.answer_decision(F.col("lift"), F.col("cov")).alias("decision"))


@query(f"WITH {_SCORED}, p AS (SELECT condition, count(*) AS n, avg(f1) AS f1, avg(em) AS em FROM scored GROUP BY condition) SELECT condition, n, round(f1, 6) AS f1, round(em, 6) AS em, round((SELECT max(f1) FILTER (condition = 'oracle') - max(f1) FILTER (condition = 'baseline') FROM p), 6) AS drop FROM p")
def sweep_summary(spark, d):
    s = _scored(spark, d).withColumn("condition", F.when(F.col("condition") == "baseline", "gold_removed").otherwise(F.col("condition"))).withColumn("pair_in_context", F.lit(True)).withColumn("n_chunks", F.lit(0))
    out = sweep.summary(s).withColumn("condition", F.when(F.col("condition") == "gold_removed", "baseline").otherwise(F.col("condition")))
    return out.select("condition", "n", F.round("f1", 6).alias("f1"), F.round("em", 6).alias("em"), F.round("drop", 6).alias("drop"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(quantile_cont(value::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.9), 6) AS p90, round(max(value), 6) AS max, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def percentiles(spark, d):
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("min"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.round(F.max("value"), 6).alias("max"), F.countDistinct("user_id").alias("users"))


# ---- synthetic world -----------------------------------------------------------------------------------------------

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_WORLD = f"""ent AS (SELECT e::INTEGER AS entity FROM range(96) t(e)), prp AS (SELECT k::INTEGER AS prop FROM range(12) t(k)),
att0 AS (SELECT entity, prop FROM ent, prp WHERE {_DRAW.format("'has:' || entity || ':' || prop || ':7'")} < {int(0.35 * (1 << 32))}),
att AS (SELECT * FROM att0 UNION ALL SELECT entity, ({_DRAW.format("'own:' || entity || ':7'")} % 12)::INTEGER FROM ent ANTI JOIN att0 USING (entity)),
rng AS (SELECT entity, row_number() OVER (ORDER BY {_DRAW.format("'ring:' || entity || ':7'")}, entity) AS r FROM ent),
par AS (SELECT a.entity, b.entity AS other FROM rng a JOIN rng b ON b.r = a.r % 96 + 1),
hld AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY {_DRAW.format("'held:' || entity || ':7'")}, entity) AS r FROM ent) WHERE r <= 24),
qs AS (SELECT a.entity AS i, b.entity AS j FROM ent a, ent b WHERE a.entity <> b.entity),
trn AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {_DRAW.format("'ask:' || i || ':' || j || ':7'")}, j) AS r FROM qs WHERE i NOT IN (SELECT entity FROM hld)) WHERE r <= 24),
two AS (SELECT i, j, x.prop FROM qs JOIN par ON par.entity = i JOIN att x ON x.entity = other JOIN att y ON y.entity = j AND y.prop = x.prop),
ood AS (SELECT * FROM qs WHERE i IN (SELECT entity FROM hld)), seen AS (SELECT * FROM qs WHERE i NOT IN (SELECT entity FROM hld) AND NOT EXISTS (SELECT 1 FROM trn WHERE trn.i = qs.i AND trn.j = qs.j))"""


def _world(spark) -> tuple[dict[str, DataFrame], world.WorldParams]:
    p = world.WorldParams()
    return {k: cut_lineage(v) for k, v in world.build_world(spark, p).items()}, p


def _every_question(w, p) -> DataFrame:
    return world.ood_probe(w, p).unionByName(world.seen_control(w, p)).unionByName(w["train_query"])


@query(f"WITH {_WORLD} SELECT i, j, prop FROM two")
def two_hop_answer(spark, d):
    w, p = _world(spark)
    return world.two_hop_answers(_every_question(w, p), w["partner"], w["attrs"])


_WEIGHT = "(" + " + ".join(f"('0x' || substr(md5('weight:' || k.prop || ':' || (a.prop + {{0}}) || ':7'), {1 + 4 * i}, 4))::BIGINT" for i in range(4)) + " - 131070)"
_THRESHOLD = f"""wx AS (SELECT a.entity, k.prop, sum({_WEIGHT.format(0)}) AS w FROM att a, prp k GROUP BY 1, 2), wy AS (SELECT a.entity, k.prop, sum({_WEIGHT.format(12)}) AS w FROM att a, prp k GROUP BY 1, 2),
pre AS (SELECT i, j, wx.prop, wx.w + wy.w AS pre FROM qs JOIN par ON par.entity = i JOIN wx ON wx.entity = other JOIN wy ON wy.entity = j AND wy.prop = wx.prop),
fit AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {_DRAW.format("'fit:' || i || ':' || j || ':7'")}, j) AS r FROM qs) WHERE r <= 12),
rate AS (SELECT sum(s * s) / 12 AS rate FROM (SELECT count(*) / 96 AS s FROM att GROUP BY prop)),
srt AS (SELECT prop, list(pre.pre::DOUBLE ORDER BY pre.pre) AS a FROM pre JOIN fit USING (i, j) GROUP BY prop), pos AS (SELECT prop, a, (1 - rate) * (len(a) - 1) AS spot FROM srt, rate),
theta AS (SELECT prop, a[floor(spot)::BIGINT + 1] + (a[ceil(spot)::BIGINT + 1] - a[floor(spot)::BIGINT + 1]) * (spot - floor(spot)) AS theta FROM pos)"""


@query(f"WITH {_WORLD}, {_THRESHOLD} SELECT i, j, prop FROM pre JOIN theta USING (prop) WHERE pre > theta")
def threshold_answer(spark, d):
    w, p = _world(spark)
    return world.threshold_answers(_every_question(w, p), w, p)


@query(f"""WITH {_WORLD}, par_ AS (SELECT 'attr' AS kind, [1, entity + 6, 3, prop + 102, 2, 0] AS t FROM att UNION ALL SELECT 'partner', [1, entity + 6, 4, other + 6, 2, 0] FROM par UNION ALL SELECT 'query', [1, i + 6, j + 6, 5, prop + 102, 2] FROM two JOIN trn USING (i, j))
SELECT kind, array_to_string(t, ' ') AS tokens FROM par_""")
def world_paragraphs(spark, d):
    w, p = _world(spark)
    return world.paragraphs(w, p).select("kind", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query(f"""WITH {_WORLD}, sz AS (SELECT i, j, count(*) AS g FROM two GROUP BY 1, 2), a AS (SELECT coalesce(g, 0) AS g FROM trn LEFT JOIN sz USING (i, j)), b AS (SELECT coalesce(g, 0) AS g FROM ood LEFT JOIN sz USING (i, j))
SELECT (SELECT count(*) FROM att) + 96 + (SELECT count(*) FROM two JOIN trn USING (i, j)) AS n_paragraphs, 72::BIGINT AS n_trained, (SELECT count(*) FROM hld) AS n_heldout, (SELECT count(*) FROM trn) AS n_train_queries, (SELECT count(*) FROM att) AS n_attrs,
(SELECT round(avg(g), 6) FROM a) AS mean_answer_train, (SELECT count(*) FROM b) AS n_ood, (SELECT round(avg(g), 6) FROM b) AS mean_answer_ood, (SELECT round(avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END), 6) FROM b) AS share_ood_nonempty, (SELECT count(*) FROM seen) AS n_seen,
(SELECT bool_and(entity <> other) AND count(DISTINCT other) = 96 FROM par) AS partners_are_a_derangement, (SELECT count(*) = 0 FROM trn WHERE i IN (SELECT entity FROM hld)) AS heldout_never_asked, round((SELECT count(*) FROM att) / 96, 6) AS mean_attrs""")
def world_statistics(spark, d):
    w, p = _world(spark)
    means = ("mean_answer_train", "mean_answer_ood", "share_ood_nonempty", "mean_attrs")
    out = world.world_statistics(w, p)
    return out.select(*[F.round(c, 6).alias(c) if c in means else c for c in out.columns])


_F1G = f"""WITH {_WORLD}, pr AS (SELECT i, j, prop, {_DRAW.format("i || ':' || j || ':' || prop")} % 1000 AS p FROM qs, prp), sz AS (SELECT i, j, count(*) AS g FROM two GROUP BY 1, 2),
rk AS (SELECT pr.*, g, row_number() OVER (PARTITION BY pr.i, pr.j ORDER BY p DESC, prop) AS r FROM pr JOIN sz ON pr.i = sz.i AND pr.j = sz.j),
hit AS (SELECT rk.i, rk.j, g, count(two.prop) / g AS f1 FROM rk LEFT JOIN two ON rk.i = two.i AND rk.j = two.j AND rk.prop = two.prop WHERE r <= g GROUP BY rk.i, rk.j, g)"""


def _probed(w, p, questions: DataFrame) -> DataFrame:
    probs = questions.withColumn("prop", F.explode(F.sequence(F.lit(0), F.lit(p.n_props - 1)))).withColumn("p", F.expr("cast(conv(substr(md5(concat(i, ':', j, ':', prop)), 1, 8), 16, 10) as bigint) % 1000"))
    return world.f1_at_g(world.two_hop_answers(questions, w["partner"], w["attrs"]), probs)


@query(f"{_F1G} SELECT i, j, g, round(f1, 6) AS f1, CASE WHEN f1 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS exact FROM hit")
def f1_at_g(spark, d):
    w, p = _world(spark)
    return _probed(w, p, _every_question(w, p)).select("i", "j", "g", F.round("f1", 6).alias("f1"), "exact")


@query(f"""{_F1G}, o AS (SELECT count(*) AS n, avg(f1) AS f, avg(CASE WHEN f1 = 1 THEN 1.0 ELSE 0.0 END) AS e FROM hit JOIN ood USING (i, j)), s AS (SELECT count(*) AS n, avg(f1) AS f, avg(CASE WHEN f1 = 1 THEN 1.0 ELSE 0.0 END) AS e FROM hit JOIN seen USING (i, j))
SELECT o.n AS n_ood, round(o.f, 6) AS f1_ood, round(o.e, 6) AS exact_ood, s.n AS n_seen, round(s.f, 6) AS f1_seen, round(s.e, 6) AS exact_seen, round(o.f - s.f, 6) AS gap FROM o, s""")
def probe_report(spark, d):
    w, p = _world(spark)
    out = world.probe_report(_probed(w, p, world.ood_probe(w, p)), _probed(w, p, world.seen_control(w, p)))
    return out.select("n_ood", "n_seen", *[F.round(c, 6).alias(c) for c in ("f1_ood", "exact_ood", "f1_seen", "exact_seen", "gap")])
