"""Encoders behind their interface, refits, blends and the described extras."""

import numpy as np
from pyspark.sql import functions as F

from kinweave.operators import encoders, extras, learn
from kinweave.plans import refit
from kinweave.sources import records


def lengths():
    return lambda texts: np.array([[len(t), 1.0] for t in texts])


def overlap():
    return lambda a, b: np.array([len(set(x) & set(y)) for x, y in zip(a, b)])


def test_encoder_interface(spark):
    d = spark.createDataFrame([(1, "aaa"), (2, None), (3, "")], "doc int, text string")
    got = {r["doc"]: r["v"] for r in encoders.encode(d, "text", lengths).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / 10**0.5) and np.allclose(got[2], [0, 1])
    assert all(len(r["v"]) == 64 for r in encoders.encode(d, "text").collect())


def test_gated_scores(spark):
    d = spark.createDataFrame([(1, "abc", "bcd", 0.5), (2, "abc", "abc", 0.0), (3, None, "x", 0.9)], "s1 int, a string, b string, p1 double")
    got = {r["s1"]: r["ce"] for r in encoders.score_pairs(d, "a", "b", overlap, F.col("p1") >= 0.01).collect()}
    assert got == {1: 2.0, 2: -12.0, 3: 0.0}
    assert {r["s1"] for r in encoders.score_pairs(d, "a", "b", gate=F.col("p1") >= 0.01).filter("ce = -12").collect()} == {2}


def test_split_is_stratified(spark):
    s1 = spark.createDataFrame([(i, "A" if i % 2 else "B") for i in range(200)], "s1 int, country string")
    truth = spark.createDataFrame([(i, 1) for i in range(0, 200, 4)], "s1 int, p int")
    d = extras.stratified_split(s1, truth, 0.2)
    assert {(r["singleton"], r["country"]): r["n"] for r in d.filter("held").groupBy("singleton", "country").agg(F.count(F.lit(1)).alias("n")).collect()} == {(True, "A"): 20, (True, "B"): 10, (False, "B"): 10}


def pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, i * 10 + j, int(j == 0), float(rng.normal(2.0 * (j == 0), 0.6)), float(rng.random())) for i in range(80) for j in range(3)]
    return spark.createDataFrame(rows, "s1 int, p int, label int, f double, noise double")


def test_refit_blend_rethreshold(spark, tmp_path):
    d = pairs(spark, 1)
    truth, s1 = d.filter("label = 1").select("s1", "p"), d.select("s1").distinct()
    small = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 2, "folds": 2}
    fit = {k: v for k, v in small.items() if k != "folds"}
    extra = d.select("s1", "p", (F.col("f") * 2).alias("value"))
    a = refit.refit(spark, f"{tmp_path}/a", d, truth, s1, {"ce": extra}, ("noise",), threshold=0.5, **fit)
    assert a["features"] == ["f", "ce"] and a["oof"]["overall"] > 0.8
    b = refit.refit(spark, f"{tmp_path}/b", d.withColumn("ce", F.col("f") * 2), truth, s1, weight=0.5, seeds=(1,), threshold=0.5, held_out=True, **fit)
    assert b["held_out"]["overall"] > 0.7
    new = pairs(spark, 2).withColumn("ce", F.col("f") * 2)
    sel = refit.blend(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], new, s1, f"{tmp_path}/out", 0.5)
    right = sel.join(new.filter("label = 1").select("s1", "p"), ["s1", "p"]).count()
    assert right / sel.count() > 0.8
    assert records.read_tsv(spark, f"{tmp_path}/out/matching_results").count() == 80
    strict = refit.rethreshold(spark, f"{tmp_path}/a", new, s1, f"{tmp_path}/out2", 0.95)
    assert strict.count() <= sel.count()


def test_studies(spark):
    d = pairs(spark, 3)
    fit = {"maxIter": 2, "maxDepth": 2, "folds": 2, "minInstancesPerNode": 2}
    study = dict(refit.fold_study(d, {"f": ["f"], "noise": ["noise"]}, **fit))
    assert study["f"] > 0.9 > study["noise"]
    assert dict(learn.ablation(d, {"signal": ["f"]}, **fit))["signal"] < study["f"]
    assert 2 <= learn.imbalance_weight(d) <= 12
    model = learn.self_train(d, pairs(spark, 4), ["f", "noise"], maxIter=2, maxDepth=2)
    assert learn.importance(model, ["f", "noise"])[0][0] == "f"
    assert learn.auc(learn.leave_country_out(d.withColumn("country", (F.col("s1") % 2).cast("string")), ["f"], maxIter=2, maxDepth=2), "prob").first()[0] > 0.9


def test_seeds_differ_and_share_folds(spark):
    d = pairs(spark, 5)
    fit = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 2}
    models, both = learn.ensemble(d, ["f", "noise"], (1, 2), **fit)
    one = learn.out_of_fold(d, ["f", "noise"], seed=1, **fit).select("s1", "p", F.col("raw").alias("one"))
    far = both.join(one, ["s1", "p"]).agg(F.max(F.abs(F.col("raw") - F.col("one")))).first()[0]
    assert len(models) == 2 and far > 0


def test_a_forced_threshold_keeps_the_tuned_alpha(spark, tmp_path, monkeypatch):
    d = pairs(spark, 6)
    monkeypatch.setattr(refit.decide, "tune", lambda *a, **k: {"method": "threshold", "thr": 0.4, "alpha": 0.3, "f05": 0.9})
    report = refit.refit(spark, f"{tmp_path}/a", d, d.filter("label = 1").select("s1", "p"), d.select("s1").distinct(), threshold=0.6, maxIter=2, maxDepth=2, minInstancesPerNode=2)
    assert report["knobs"] == {"method": "threshold", "thr": 0.6, "alpha": 0.3}
    assert refit.load(spark, f"{tmp_path}/a")["knobs"]["alpha"] == 0.3
