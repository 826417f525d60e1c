"""Decisions and metrics on small cases, against brute force."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, decide, features, metrics


@pytest.mark.parametrize(("tp", "n", "t", "want"), [(2, 3, 2, 0.714286), (3, 3, 4, 0.9375), (4, 5, 4, 0.8333), (0, 0, 0, 1), (0, 0, 2, 0), (0, 2, 0, 0)])
def test_f05(spark, tp, n, t, want):
    assert spark.range(1).select(metrics.f05(F.lit(tp), F.lit(n), F.lit(t))).first()[0] == pytest.approx(want, abs=1e-4)


def test_one_owner(spark):
    d = spark.createDataFrame([("A", 1, 0.9), ("B", 1, 0.8), ("C", 2, 0.5), ("D", 2, 0.5)], "s1 string, p int, prob double")
    assert {r["s1"]: r["decided"] for r in decide.one_owner(d, alpha=0).collect()} == {"A": 0.9, "B": 0.0, "C": 0.5, "D": 0.5}
    assert {r["s1"] for r in decide.hard_owner(d).collect()} == {"A", "C"}
    assert decide.one_owner(d, alpha=1).filter("decided <> prob").count() == 0


def test_rival(spark):
    d = spark.createDataFrame([("A", 1, 0, 0.9), ("B", 1, 0, 0.6), ("C", 1, 0, 0.2)], "s1 string, p int, is_s3 int, p1 double")
    assert [r["p_rival"] for r in features.stage2(d).orderBy("s1").collect()] == [0.6, 0.9, 0.9]


def test_union_at_k(spark):
    d = spark.createDataFrame([(1, 2, "w", 0), (1, 2, "c", 4)], "s1 int, p int, pass string, rank int")
    r = blocking.union_at_k(d, {"c": 3}, ["w", "c"]).first()
    assert (r["r_w"], r["r_c"]) == (0, 999)


def brute_expected(q, k):
    out = 0.0
    for draw in product((0, 1), repeat=len(q)):
        pr = np.prod([p if x else 1 - p for p, x in zip(q, draw)])
        tp, true = sum(draw[:k]), sum(draw)
        f = 1.0 if not k and not true else 0.0 if not tp else 1.25 * tp / (k + 0.25 * true)
        out += pr * f
    return out


def test_expected_f_is_exact():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        q = np.sort(rng.random(n))[::-1]
        assert decide.expected_f(q) == pytest.approx([brute_expected(q, k) for k in range(n + 1)])


def test_expected_f_selection(spark):
    d = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.85), (1, 12, 0.05), (2, 13, 0.1)], "s1 int, p int, prob double")
    got = decide.apply_decision(d, {"method": "expected_f", "p_min": 0.01})
    assert {(r["s1"], r["p"]) for r in got.collect()} == {(1, 10), (1, 11)}


def test_tune(spark):
    d = spark.createDataFrame([(i, i * 10 + j, 0.9 if j == 0 else 0.4) for i in range(20) for j in range(2)], "s1 int, p int, prob double")
    t = d.filter("prob > 0.5").select("s1", "p")
    best = decide.tune(d, t, d.select("s1").distinct())
    assert best["f05"] == 1.0


def test_top_k_bounds(spark):
    d = spark.createDataFrame([(1, p, 0.5) for p in range(9)], "s1 int, p int, score double")
    got = blocking.top_k(d, 3, ["s1"]).orderBy("rank").collect()
    assert [r["p"] for r in got] == [0, 1, 2]


def test_choose_k():
    assert blocking.choose_k([(1, 0.5), (2, 0.99), (3, 1.0)]) == 2
    assert blocking.choose_k([(1, 0.5), (2, 0.9), (3, 0.91), (20, 0.92)]) == 2
