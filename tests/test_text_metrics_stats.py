import math
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regionkit import catalog
from regionkit.functions import metrics as M
from regionkit.functions import text as T
from regionkit.operators import audit, runs, stats, world


def plain(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def scores(spark, rows):
    df = spark.createDataFrame(rows, "p string, g string")
    return [tuple(r) for r in df.select(T.normalize_answer(F.col("p")), T.f1_score(F.col("p"), F.col("g")), T.exact_match(F.col("p"), F.col("g"))).collect()]


def test_answers(spark):
    got = scores(spark, [("The Eiffel-Tower!", "eiffeltower"), ("a cat sat here", "cat sat there"), ("yes please", "yes"), ("", ""), ("", "x"), ("no", "No."), ("x x y", "x y y")])
    assert got[0] == ("eiffeltower", 1.0, 1.0)
    assert got[1][1] == pytest.approx(2 / 3)
    assert [g[1] for g in got[2:]] == [0.0, 1.0, 0.0, 1.0, pytest.approx(2 / 3)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAn theThe,._é’  \n-x日", max_size=30), min_size=20, max_size=40))
def test_normalization_is_pythons(spark, texts):
    got = scores(spark, [(t, "x") for t in texts])
    assert [g[0] for g in got] == [plain(t) for t in texts]


def test_titles_and_prompts(spark):
    df = spark.createDataFrame([(" A_b   C ",)], "t string")
    assert df.select(T.normalize_title(F.col("t"))).first()[0] == "A b C"
    c = spark.sql("SELECT array(named_struct('title', 'T', 'text', 'x'), named_struct('title', '', 'text', 'y')) AS c, 'Q?' AS q")
    assert c.select(T.prompt(F.col("c"), F.col("q"))).first()[0] == "Passages:\n[1] (T) x\n[2] () y\n\nQuestion: Q?\nAnswer:"


def test_metrics(spark):
    df = spark.sql("SELECT array('a','b','c','d') AS r, array('b','d') AS g, cast(array() AS array<string>) AS e, array(array('b','d'), array('a','b')) AS p")
    row = df.select(M.pair_recall_at_k(F.col("r"), F.col("g"), 4), M.pair_recall_at_k(F.col("r"), F.col("g"), 3), M.any_gold_at_k(F.col("r"), F.col("g"), 2), M.first_completion_rr(F.col("r"), F.col("g")), M.first_completion_rr(F.col("r"), F.col("g"), 3), M.covered(F.col("p"), F.col("g")), M.covered(F.col("p"), F.col("e")), M.pair_recall_at_k(F.col("r"), F.col("e"), 3)).first()
    assert tuple(row)[:7] == (1.0, 0.0, 1.0, 0.25, 0.0, True, False)
    assert math.isnan(row[7])


def test_bootstraps(spark):
    x = np.random.default_rng(0).standard_normal(50)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "grp string, k int, x double")
    a = stats.bootstrap_hash(df, ["grp"], "k", "x", 200).first()
    b = stats.bootstrap_numpy(df, ["grp"], "x", 500).first()
    for r in (a, b):
        assert r.point_estimate == pytest.approx(x.mean())
        assert r.ci_low < x.mean() < r.ci_high
    assert stats.bootstrap_hash(df, ["grp"], "k", "x", 200).first() == a
    assert stats.bootstrap_hash(df.where("false"), ["grp"], "k", "x", 5).count() == 0


def test_registered_intervals_draw_10000(spark, tmp_path):
    rng = np.random.default_rng(3)
    right = {c: rng.random(40) < p for c, p in (("baseline", 0.4), ("oracle", 0.7))}
    rows = [(i + 1000 * (c == "oracle"), f"q{i}", c, "x" if ok else "y", None) for c, v in right.items() for i, ok in enumerate(v)]
    spark.createDataFrame(rows, "gen_id bigint, id string, condition string, answer string, error string").write.parquet(f"{tmp_path}/generations.parquet")
    spark.createDataFrame([(f"q{i}", "d", 2, "x") for i in range(40)], "id string, dataset string, n_hops int, answer string").write.parquet(f"{tmp_path}/multihop_questions.parquet")

    def interval(keyed):
        x = np.array([v for _, v in sorted(keyed)])
        r = np.random.default_rng(1337)
        low, high = np.percentile([x[r.integers(0, len(x), len(x))].mean() for _ in range(10_000)], [2.5, 97.5])
        return pytest.approx((x.mean(), low, high, 10_000), abs=1e-6)

    got = {r[0]: tuple(r)[1:] for r in catalog.QUERIES["bootstrap_mean_ci_10k"](spark, str(tmp_path)).collect()}
    assert got == {c: interval([(f"{i + 1000 * (c == 'oracle')}:q{i}", float(ok)) for i, ok in enumerate(v)]) for c, v in right.items()}
    got = {r[0]: tuple(r)[1:] for r in catalog.QUERIES["bootstrap_paired_ci_10k"](spark, str(tmp_path)).collect()}
    assert got == {"d": interval([(f"q{i}", float(b) - float(a)) for i, (a, b) in enumerate(zip(right["baseline"], right["oracle"]))])}


def test_decisions(spark):
    df = spark.createDataFrame([(2.0, 0.3), (1.5, 0.4), (3.0, 0.1), (-1.0, 0.9)], "l double, c double")
    assert [r[0] for r in df.select(stats.answer_decision(F.col("l"), F.col("c"))).collect()] == ["GO", "WEAK GO", "NO-GO", "NO-GO"]
    v = lambda rows: stats.dataset_decision(spark.createDataFrame(rows, "l double, c double"), "l", "c").first().verdict
    assert v([(6.0, 0.9), (7.0, 0.8), (5.0, 1.0)]) == "GO"
    assert v([(6.0, 0.9), (7.0, 0.8)]) == "WEAK GO"
    assert v([(6.0, None), (7.0, 0.8)]) == "NO-GO"


def test_audit(spark):
    facts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "title string")
    corpus = spark.createDataFrame([("a",), ("c",), (None,)], "title string")
    r = audit.corpus_audit(facts, corpus).first()
    assert (r.n_facts, r.n_titles, r.n_missing_titles, r.n_missing_facts) == (3, 2, 1, 1)
    assert [tuple(x) for x in audit.top_missing(facts, corpus).collect()] == [("b", 1)]


def test_world(spark):
    p = world.WorldParams(n_entities=20, n_props=5, queries_per_entity=4)
    w = {k: v.persist() for k, v in world.build_world(spark, p).items()}
    assert w["partner"].where("entity = other").count() == 0
    assert w["attrs"].select("entity").distinct().count() == 20
    held = {r.entity for r in w["heldout"].collect()}
    assert not held & {r.i for r in w["train_query"].collect()}
    has = {(r.entity, r.prop) for r in w["attrs"].collect()}
    pi = {r.entity: r.other for r in w["partner"].collect()}
    got = {(r.i, r.j, r.prop) for r in world.two_hop_answers(w["train_query"], w["partner"], w["attrs"]).collect()}
    want = {(q.i, q.j, k) for q in w["train_query"].collect() for k in range(5) if (pi[q.i], k) in has and (q.j, k) in has}
    assert got == want
    assert {len(r.tokens) for r in world.paragraphs(w, p).collect()} == {6}
    assert world.ood_probe(w, p).count() == len(held) * 19
    assert world.seen_control(w, p).join(w["train_query"], ["i", "j"]).count() == 0
    ood = world.ood_probe(w, p)
    both = {(r.i, r.j, r.prop) for r in world.two_hop_answers(ood, w["partner"], w["attrs"]).collect()}
    other = {(r.i, r.j, r.prop) for r in world.threshold_answers(ood, w, p).collect()}
    assert other and len(both ^ other) > 0.2 * 5 * ood.count() * 0.5  # another relation, of a like share of answers
    assert 0.5 < len(other) / len(both) < 2
    stats_ = world.world_statistics(w, p).first()
    assert stats_.partners_are_a_derangement and stats_.heldout_never_asked and stats_.n_trained + stats_.n_heldout == 20
    asked = world.supervised_queries(w, p, "threshold")
    assert asked.count() == w["train_query"].count()


def test_world_fills_empty_entities(spark):
    w = world.build_world(spark, world.WorldParams(n_entities=6, n_props=3, density=0.0, queries_per_entity=99))
    assert sorted(r.entity for r in w["attrs"].collect()) == [*range(6)]
    assert w["train_query"].count() == 4 * 5


def test_f1_at_g(spark):
    truth = spark.createDataFrame([(0, 1, 0), (0, 1, 2)], "i int, j int, prop int")
    probs = spark.createDataFrame([(0, 1, 0, 0.9), (0, 1, 1, 0.5), (0, 1, 2, 0.5), (5, 5, 0, 1.0)], "i int, j int, prop int, p double")
    r = world.f1_at_g(truth, probs).collect()
    assert [(x.f1, x.exact) for x in r] == [(0.5, 0.0)]


def test_generation_retries_and_records_errors(spark):
    def broken(text):
        raise RuntimeError("busy")

    df = spark.createDataFrame([("Question: x",)], "prompt string")
    assert runs.generate(df).first().prediction == "Question: x"
    r = runs.generate(df, broken, tries=2, wait=0.0).first()
    assert (r.prediction, r.error) == ("", "RuntimeError: busy")


def test_latest_and_todo(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, n int, v string")
    assert {(r.id, r.v) for r in runs.latest(df, "id", ["n"]).collect()} == {("a", "y"), ("b", "z")}
    assert [r.id for r in runs.todo(df, df.where("id = 'a'"), ["id"]).collect()] == ["b"]
    assert Counter(len(r.ranked) for r in runs.ranked_lists(df.selectExpr("id query_id", "n rank", "v chunk_id")).collect()) == {2: 1, 1: 1}
