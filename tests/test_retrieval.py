import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionkit import catalog
from regionkit.operators import calibrate, retrieval, sweep


def frame(spark, x, id_="chunk_id"):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], f"{id_} bigint, v array<double>")


def reference(x, c, h, q, p, tau):
    """The whole retrieval for one query, with plain NumPy."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ (q / np.linalg.norm(q)), 9)
    top = np.lexsort((np.arange(len(x)), -s))[: p.k_descent]
    lo, hi = ((c + sign * h[:, None]).astype("float32").astype(float) for sign in (-1, 1))
    found = []
    for (i, a), (j, b) in combinations(enumerate(top), 2):
        l, r = np.maximum(lo[a], lo[b]), np.minimum(hi[a], hi[b])
        w = (r - l) / p.beta
        side = (p.beta * np.where(w > 30, w, np.log1p(np.exp(np.clip(w, -50, 30))))).astype("float32").astype(float)
        vol = np.log(np.maximum(side, 1e-30)).sum()
        if vol < tau:
            continue
        mn, mx = (((l + r) / 2 + k * side / 2).astype("float32").astype(float) for k in (-1, 1))
        mid = (mn + mx) / 2
        cos = q @ mid / (np.linalg.norm(q) * np.linalg.norm(mid))
        found.append((-round(vol + np.log(max(cos + 1, 1e-12)), 9), i, j, a, b, mn, mx, mid))
    union = list(top[: p.k_points])
    for _, _, _, a, b, mn, mx, mid in sorted(found, key=lambda t: t[:3])[: p.m_lenses]:
        inside = list(np.flatnonzero(((c >= mn) & (c <= mx)).all(axis=1)))
        if len(inside) > p.cap:
            inside = sorted(inside, key=lambda k: (round(np.sqrt(((c[k] - mid) ** 2).sum()), 9), k))[: p.cap]
        for k in (a, b):
            if k not in inside:
                inside.insert(0, k)
        for k in inside[: p.cap]:
            if k not in union and len(union) < p.total:
                union.append(k)
    return [int(k) for k in union]


@pytest.mark.parametrize("block", [16, 2048])
def test_whole_retrieval_against_numpy(spark, block):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    corpus = frame(spark, x)
    knn = retrieval.self_knn_mean(corpus, 5, block)
    boxes = retrieval.build_boxes(corpus, knn, 0.8).persist()
    h = {r.chunk_id: r.h for r in boxes.collect()}
    p = retrieval.LensParams(k_points=3, k_descent=8, m_lenses=3, cap=4, total=12)
    queries = frame(spark, x[:5], "query_id")
    tau = -20.0
    out = retrieval.lens_retrieve(queries, corpus, boxes, p, tau)["union"].orderBy("query_id", "rank").collect()
    for i in range(5):
        got = [r.chunk_id for r in out if r.query_id == i]
        assert got == reference(x, x, np.array([h[k] for k in range(60)]), x[i], p, tau)


def test_dense_ties_go_to_the_smaller_id(spark):
    corpus = frame(spark, [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    got = retrieval.dense_topk(frame(spark, [[1.0, 0.0]], "query_id"), corpus, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        retrieval.dense_topk(corpus, corpus, 0)


def test_dense_of_nothing(spark):
    empty = frame(spark, []) if False else spark.createDataFrame([], "chunk_id bigint, v array<double>")
    assert retrieval.dense_topk(frame(spark, [[1.0]], "query_id"), empty, 3).count() == 0


def test_members_in_index_order_up_to_the_cap(spark):
    c = [[0.9, 0.9], [0.1, 0.1], [5.0, 5.0]] + [[0.5, 0.5]] * 3
    boxes = frame(spark, c).withColumnRenamed("v", "c")
    lens = spark.createDataFrame([(0, 1, [-0.5, -0.5], [1.5, 1.5], [0.5, 0.5])], "query_id bigint, lens int, min array<double>, max array<double>, mid array<double>")
    got = lambda cap, block: [r.chunk_id for r in retrieval.lens_members(lens, boxes, cap, block).orderBy("pos").collect()]
    assert got(5, 100) == got(5, 2) == [0, 1, 3, 4, 5]
    assert got(3, 100) == got(3, 2) == [3, 4, 5]


def test_missing_parents_come_first_b_before_a(spark):
    lenses = spark.createDataFrame([(0, 1, 8, 9)], "query_id bigint, lens int, a bigint, b bigint")
    members = spark.createDataFrame([(0, 1, 1, 1), (0, 1, 2, 2)], "query_id bigint, lens int, chunk_id bigint, pos int")
    got = [r.chunk_id for r in retrieval.lens_lists(lenses, members, 3).orderBy("pos").collect()]
    assert got == [9, 8, 1]


def test_union_keeps_first_occurrences_and_the_total(spark):
    points = spark.createDataFrame([(0, i, i + 1) for i in range(6)], "query_id bigint, chunk_id bigint, rank int")
    lists = spark.createDataFrame([(0, 1, 1, 1), (0, 1, 7, 2), (0, 2, 8, 1), (0, 2, 7, 2)], "query_id bigint, lens int, chunk_id bigint, pos int")
    got = [r.chunk_id for r in retrieval.ordered_union(points, lists, 3, 5).orderBy("rank").collect()]
    assert got == [0, 1, 2, 7, 8]


def test_alpha_grid_is_monotone_and_chosen_in_logs(spark):
    rng = np.random.default_rng(2)
    corpus = frame(spark, rng.standard_normal((80, 4)))
    knn = retrieval.self_knn_mean(corpus)
    ids = corpus.select("chunk_id", F.col("chunk_id").alias("idx"))
    r = calibrate.alpha_ratios(corpus, knn, calibrate.draw_pairs(ids, 200), (0.5, 1.0, 2.0, 4.0)).orderBy("alpha").collect()
    assert [x.ratio for x in r] == sorted(x.ratio for x in r)
    t = spark.createDataFrame([(1.0, 0.01), (2.0, 0.25), (3.0, 0.06)], "alpha double, ratio double")
    assert calibrate.choose_alpha(t).first().alpha == 3.0
    assert calibrate.choose_alpha(t.where("alpha < 3")).first().alpha == 1.0


def test_random_chunks_have_no_repeats(spark):
    q = spark.range(3).withColumnRenamed("id", "query_id")
    got = sweep.random_chunks(q, spark.range(40).withColumnRenamed("id", "chunk_id"), 25).collect()
    for i in range(3):
        ids = [r.chunk_id for r in got if r.query_id == i]
        assert len(ids) == len(set(ids)) == 25


def test_full_grid_reaches_beyond_two(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((6, 64)), 15, axis=0) + 0.1 * rng.standard_normal((90, 64))
    df = spark.createDataFrame([(i, i // 15, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id bigint, label int, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    q = {k: catalog.QUERIES[k](spark, str(tmp_path)).collect() for k in ("alpha_choice", "alpha_grid_ratio")}
    assert {r.alpha for r in q["alpha_grid_ratio"]} == {0.3, 0.35, *calibrate.ALPHA_GRID}
    ratio = {r.alpha: r.median_log_pair - r.median_log_box for r in q["alpha_grid_ratio"]}
    best = min(ratio, key=lambda a: (abs(max(ratio[a], math.log(1e-30)) - math.log(0.05)), a))
    assert q["alpha_choice"][0].alpha == best > 2.0


def test_dense_topk_keeps_ties_at_the_edge_by_id(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, v array<double>")
    queries = spark.createDataFrame([(100, [2.0, 0.0]), (7, [1.0, 0.0])], "query_id bigint, v array<double>")
    got = {}
    for r in retrieval.dense_topk(queries, corpus, 4, exclude_self=True, block=8).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.chunk_id
    assert got == {100: {1: 1, 2: 2, 3: 4, 4: 5}, 7: {1: 1, 2: 2, 3: 4, 4: 5}}
    assert retrieval.dense_topk(queries, corpus.limit(2), 50).where("query_id = 100").count() == 2
