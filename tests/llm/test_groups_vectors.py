import random
import time
from pathlib import Path

import numpy as np
import pytest

from regionkit.llm import ann
from regionkit.llm.topn import top_n_per_group


def test_top_n_against_sorting(spark):
    rng = random.Random(0)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 20)}", str(rng.randint(0, 300)), rng.choice([0.1, 0.2, 0.2, 0.3, float("nan"), None, -0.0, 0.0])) for _ in range(3000)]
    rows += [(None, "1", 0.5), ("hot", None, 0.9), ("inf", "a", float("inf")), ("inf", "b", float("-inf"))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "query_id string, chunk_id string, score double, g int")
    got = {}
    for r in top_n_per_group(df, "query_id", "chunk_id", "score", 5, subgroups=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -np.inf))
    assert got == {g: {k + 1: x for k, x in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:5])} for g, d in best.items()}
    assert top_n_per_group(df.where("false"), "query_id", "chunk_id", "score", 5).count() == 0


def brute(ids, x, metric, least, k):
    out = set()
    for i in range(len(x)):
        if metric == ann.COSINE:
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            s = u @ u[i]
        else:
            s = -np.sqrt(((x - x[i]) ** 2).sum(1))
        s[i] = -np.inf
        for j in np.lexsort((ids, -np.round(s, 9)))[:k]:
            if s[j] >= least:
                out.add((ids[i], ids[j]))
    return out


@pytest.mark.parametrize("metric,least,noise,dim", [(ann.COSINE, 0.9, 0.05, 24), (ann.EUCLID, -0.1, 0.01, 8)])
def test_recall_against_brute_force(spark, metric, least, noise, dim):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, dim))
    for i in range(0, 1200, 4):
        x[i + 1] = x[i] + noise * rng.standard_normal(dim)
        x[i + 2] = x[i + 1] + noise * rng.standard_normal(dim)
    x[400:408] = x[400]
    x = x.astype("float32").astype(float)
    ids = np.array([str(i) for i in rng.permutation(1200)])
    rows = [(i, [float(a) for a in v], 1) for i, v in zip(ids, x)]
    rows += [(None, rows[0][1], 1), ("n1", None, 1), ("n2", [1.0], 1), ("n3", [float("nan")] + [1.0] * (dim - 1), 1), ("n4", [float("inf")] + [1.0] * (dim - 1), 1), rows[5], rows[5]]
    if metric == ann.COSINE:
        rows.append(("n5", [0.0] * dim, 1))
    df = spark.createDataFrame(rows, "id string, v array<float>, cls int")
    got = {(r.id, r.other) for r in ann.most_similar(df, "id", "v", dim, metric, least).collect()}
    want = brute(ids, x, metric, least, 5)
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.03 * len(want)


def pairs_at(rng, n, dim, cosine):
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    return x, cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)


BANDS = (0.90, 0.92, 0.94, 0.96, 0.98)


@pytest.mark.parametrize("n", [7_900, 80_800, 808_000, 100_000_000])
def test_recall_by_band_of_similarity(n):
    """Of pairs at the lower end of each band, how many are candidates; the codes are fitted for n rows."""
    x, _ = pairs_at(np.random.default_rng(7), 8000, 64, 0.9)
    codes = ann.Codes(x[:4000], n, ann.COSINE, 0.9)
    for cosine in BANDS:
        a, b = pairs_at(np.random.default_rng(11), 4000, 64, cosine)
        assert codes.meet(a, b).mean() >= (0.975 if cosine == 0.9 else 0.98)


@pytest.mark.parametrize("n", [7_900, 100_000_000])
def test_recall_by_band_of_distance(n):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((8000, 16))
    codes = ann.Codes(x[:4000], n, ann.EUCLID, 0.1)
    for distance in (0.1, 0.07, 0.03):
        step = rng.standard_normal((4000, 16))
        assert codes.meet(x[4000:], x[4000:] + distance * step / np.linalg.norm(step, axis=1, keepdims=True)).mean() >= 0.975


@pytest.mark.parametrize("n", [3000, 400_000])
def test_probing_finds_every_code_within_the_radius_and_no_other(n):
    x, _ = pairs_at(np.random.default_rng(13), 1200, 16, 0.9)
    codes = ann.Codes(x, n, ann.COSINE, 0.9)
    assert codes.radius == 2 * codes.m - 1
    codes.passes = lambda c, e: np.ones(len(c), bool)
    cls = np.random.default_rng(4).permutation(1200)
    parts = [*zip(*ann._entries(codes, cls, x))]
    cols = [np.concatenate(p) for p in parts]
    order = np.argsort(cols[0], kind="stable")
    got = [p for p in ann._pairs_met(codes, *(c[order] for c in cols), most=10_000)]
    a, b = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    words = codes(x)[1]
    want = {tuple(sorted((int(cls[i]), int(cls[j])))) for t in range(codes.tables) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(words[:, None, t] ^ words[None, :, t]) <= codes.radius, 1)))}
    assert {(int(p), int(q)) for p, q in zip(a, b)} == want


def test_checks_of_places_lose_no_pair():
    rng = np.random.default_rng(5)
    for dim in (3, 16):
        x = rng.standard_normal((3000, dim))
        codes = ann.Codes(x[:2000], 3000, ann.EUCLID, 0.1)
        step = rng.standard_normal(x.shape)
        y = x + 0.0999 * step / np.linalg.norm(step, axis=1, keepdims=True)
        far = x * 5  # beyond the range of the sample
        assert codes.passes(codes.check(x - codes.mean), codes.check(y - codes.mean)).all()
        assert codes.passes(codes.check(far - codes.mean), codes.check(far + (y - x) - codes.mean)).all()


def test_buckets_reach_over_batches(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((3, 8)), 60, axis=0) + 0.001 * rng.standard_normal((180, 8))
    df = spark.createDataFrame([(f"{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, v array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.id, r.other) for r in ann.most_similar(df, "id", "v", 8, ann.EUCLID, -0.1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute(np.array([f"{i:03d}" for i in range(180)]), x, ann.EUCLID, -0.1, 5)
    assert len(got & want) >= 0.97 * len(want)


def test_different_vectors_under_one_id_and_equal_ones_under_many(spark):
    rows = [("a", [1.0, 2.0]), ("a", [0.5, 9.0]), ("a", [1.0, 2.0]), ("b", [0.5, 9.0]), ("c", [1.0, 2.0]), ("d", [0.5, 9.05])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    got = sorted((r.id, r.other) for r in ann.most_similar(df, "id", "v", 2, ann.EUCLID, -0.1).collect())
    assert got == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "d"), ("d", "a"), ("d", "b")]  # a is the smaller of its two, and c is left alone


def test_recall_at_the_least_similarity(spark):
    x, y = pairs_at(np.random.default_rng(8), 3000, 64, 0.902)
    df = spark.createDataFrame([(f"{k}{i}", [float(e) for e in v]) for k, z in (("a", x), ("b", y)) for i, v in enumerate(z)], "id string, v array<double>")
    got = {(r.id, r.other) for r in ann.most_similar(df, "id", "v", 64, ann.COSINE, 0.9).collect()}
    assert sum((f"a{i}", f"b{i}") in got for i in range(3000)) >= 0.985 * 3000


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 8))
    x[:400] = x[0] + 1e-4 * rng.standard_normal((400, 8))
    x[400:460] = x[400]
    x = x.astype("float32").astype(float)
    ids = np.array([f"{i:04d}" for i in rng.permutation(900)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, v array<float>")
    whole = ann.candidate_pairs
    monkeypatch.setattr(ann, "candidate_pairs", lambda *a: whole(*a, crowded=5000, block=64))
    got = {(r.id, r.other) for r in ann.most_similar(df, "id", "v", 8, ann.EUCLID, -0.1).collect()}
    want = brute(ids, x, ann.EUCLID, -0.1, 5)
    assert len(got & want) >= 0.97 * len(want)


def test_few_vectors(spark):
    e = lambda rows: sorted((r.id, r.other) for r in ann.most_similar(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 2, ann.EUCLID, -0.1).collect())
    assert e([]) == []
    assert e([("a", [1.0, 2.0])]) == []
    assert e([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]) == [("a", "b"), ("b", "a")]
    assert e([("a", [1.0, 2.0]), ("b", [1.0, 2.05]), ("c", [9.0, 9.0])]) == [("a", "b"), ("b", "a")]


def test_rounds_of_packed_groups_meet_every_pair_within_the_radius_and_no_other(spark, monkeypatch):
    x, y = pairs_at(np.random.default_rng(21), 600, 16, 0.93)
    x = np.concatenate([x, y]).astype("float32").astype(float)
    codes = ann.Codes(x, 200_000, ann.COSINE, 0.9)
    assert codes.tables > 1
    monkeypatch.setattr(ann, "GROUP", 16)
    monkeypatch.setattr(ann, "ROUND", 1)
    classes = spark.createDataFrame([(i - 600, [float(a) for a in v]) for i, v in enumerate(x)], "cls bigint, v array<float>")
    got = [tuple(r) for r in ann.candidate_pairs(classes, codes, ann.COSINE, 5, 0.9).collect()]
    i, j = np.triu_indices(1200, 1)
    meet = codes.meet(x[i], x[j])
    assert len(got) == len({*got}) and {*got} == {(int(a) - 600, int(b) - 600) for a, b in zip(i[meet], j[meet])}


def test_shuffle_files_of_a_search_do_not_pile_up(spark):
    """What is left on disk when a search has run, against the bytes of its vectors."""

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        paths = [files.apply(i).getPath() for i in range(files.size())]
        return sum(Path(p).stat().st_size for p in paths if "shuffle_" in p and Path(p).exists())

    x = np.random.default_rng(22).standard_normal((6000, 64)).astype("float32").astype(float)
    df = spark.createDataFrame([(f"{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, v array<float>")
    before = left()
    found = ann.most_similar(df, "id", "v", 64, ann.COSINE, 0.9)
    found.count()
    for _ in range(40):  # files are deleted in the background
        if left() - before <= 4 * 6000 * 64 * 4:
            break
        time.sleep(0.25)
    assert left() - before <= 4 * 6000 * 64 * 4
