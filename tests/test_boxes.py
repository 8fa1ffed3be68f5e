import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionkit.functions import boxes as B
from regionkit.functions import vectors as V


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("x")).first().x


def lv(spark, a, b, beta=B.BETA):
    c = {"la": a[0], "ha": a[1], "lb": b[0], "hb": b[1]}
    return one(spark, B.pair_log_volume(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), beta), **c)


def test_hard_limit_and_symmetry(spark):
    a, b = ([0.0, 0.0], [1.0, 1.0]), ([0.5, 0.5], [1.5, 1.5])
    assert math.exp(lv(spark, a, b, 1e-6)) == pytest.approx(0.25, rel=1e-5)
    assert lv(spark, a, b) == pytest.approx(lv(spark, b, a))
    assert lv(spark, a, a) >= lv(spark, a, b)


def test_disjoint_boxes_stay_finite(spark):
    far = lv(spark, ([0.0] * 3, [1.0] * 3), ([10.0] * 3, [11.0] * 3))
    assert far == pytest.approx(3 * math.log(0.01 * math.log1p(math.exp(-50))), rel=1e-4)
    near = lv(spark, ([0.0] * 3, [1.0] * 3), ([1.1] * 3, [2.1] * 3))
    assert far < near < math.log(1e-4)


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    lo = rng.standard_normal((2, 64)).astype("float32").astype(float)
    hi = lo + 1
    w = (np.minimum(*hi) - np.maximum(*lo)) / 0.01
    side = (0.01 * np.where(w > 30, w, np.log1p(np.exp(np.clip(w, -50, 30))))).astype("float32").astype(float)
    want = np.log(np.maximum(side, 1e-30)).sum()
    assert lv(spark, (list(lo[0]), list(hi[0])), (list(lo[1]), list(hi[1]))) == pytest.approx(want, abs=1e-9)


def test_volume_of_degenerate_box(spark):
    c = {"lo": [0.0, 1.0, 0.0], "hi": [1.0, 0.5, 1.0]}
    assert one(spark, B.box_volume(F.col("lo"), F.col("hi")), **c) == 0.0
    assert one(spark, B.box_log_volume(F.col("lo"), F.col("hi")), **c) == -math.inf


def test_beta_must_be_positive():
    with pytest.raises(ValueError):
        B.soft_sides(F.col("a"), F.col("b"), 0.0)


def test_containment_has_closed_borders(spark):
    c = {"lo": [0.0, 0.0], "hi": [1.0, 1.0], "p": [1.0, 0.0], "q": [1.0, 1.01]}
    assert one(spark, B.contains(F.col("lo"), F.col("hi"), F.col("p")), **c)
    assert not one(spark, B.contains(F.col("lo"), F.col("hi"), F.col("q")), **c)


def test_vectors(spark):
    c = {"a": [3.0, 4.0], "z": [0.0, 0.0]}
    assert one(spark, V.norm("a"), **c) == 5.0
    assert one(spark, V.cosine("a", "z"), **c) == 0.0
    assert one(spark, V.unit("z"), **c) == [0.0, 0.0]
    assert one(spark, V.project("a", [[1.0, 0.0], [1.0, 1.0]]), **c) == [3.0, 7.0]


def test_soft_boxes_of_training(spark):
    c = {"lo": [0.0], "hi": [1.0]}
    side = 0.1 * math.log1p(math.exp(10.0))
    assert one(spark, B.soft_log_volume(F.col("lo"), F.col("hi")), **c) == pytest.approx(math.log(side + 1e-6))
    assert one(spark, B.intersection_embedding(F.col("lo"), F.col("hi")), **c) == pytest.approx([0.5, side])
    assert one(spark, B.overlap_share(F.col("lo"), F.col("hi"), F.col("lo"), F.col("hi")), **c) == pytest.approx(1.0)
