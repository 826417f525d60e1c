"""Second-stage variants: refits with extra or fewer columns, their store, blends and new thresholds."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide, learn, metrics
from ..sources import records


def save(spark: SparkSession, path: str, models: list[PipelineModel], isotonic, features: list[str], knobs: dict) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/trees-{i}")
    isotonic.write().overwrite().save(f"{path}/isotonic")
    records.write_report(spark, {"features": features, "knobs": knobs, "models": len(models)}, f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    models = [PipelineModel.load(f"{path}/trees-{i}") for i in range(meta["models"])]
    return meta | {"models": models, "isotonic": IsotonicRegressionModel.load(f"{path}/isotonic")}


def predict(models: list[PipelineModel], isotonic, df: DataFrame) -> DataFrame:
    """(s1, p, prob): the mean raw score of all seeds, calibrated."""
    outs = [learn.predict(m, df, f"raw_{i}").select("s1", "p", f"raw_{i}") for i, m in enumerate(models)]
    d = reduce(lambda a, b: a.join(b, ["s1", "p"]), outs)
    mean = sum((F.col(f"raw_{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return learn.calibrate(isotonic, d.select("s1", "p", mean.alias("raw"))).select("s1", "p", "prob")


def refit(
    spark: SparkSession, path: str, pairs: DataFrame, truth: DataFrame, s1: DataFrame, extra: dict[str, DataFrame] | None = None, drop: tuple[str, ...] = (), seeds=(42,), weight: float | None = None,
    threshold: float | None = None, held_out: bool = False, **params,
) -> dict:
    """Fit one variant on labelled stage-2 ``pairs``, store it at ``path`` and return its report.

    ``extra`` attaches score columns by pair key, ``drop`` leaves columns out, ``weight``
    is the power of 1 / n, ``threshold`` overrides the tuned one (the tuned alpha stays); ``held_out`` adds the
    metric on S1s that the tuning did not see.
    """
    d = reduce(lambda a, kv: records.attach(a, kv[1], kv[0]), (extra or {}).items(), pairs)
    columns = learn.feature_columns(d, drop)
    if weight is not None:
        d, params = learn.group_weights(d, weight), params | {"weight": "weight"}
    models, oof = learn.ensemble(d, columns, seeds, **params)
    iso = learn.fit_isotonic(oof)
    scored = learn.calibrate(iso, oof).select("s1", "p", "label", "prob").persist()
    ids = s1.select("s1").distinct()
    own = ids.filter(learn.fold_of(F.col("s1"), 5, 9) != 0) if held_out else ids
    knobs = decide.tune(scored, truth, own)
    if threshold is not None:
        knobs = {"method": "threshold", "thr": threshold, "alpha": knobs["alpha"]}
    report = {"knobs": knobs, "features": columns, "oof": metrics.macro_f05(decide.apply_decision(scored, knobs), truth, ids).first().asDict()}
    if held_out:
        rest = ids.filter(learn.fold_of(F.col("s1"), 5, 9) == 0)
        sub, true = scored.join(rest, "s1", "left_semi"), truth.join(rest, "s1", "left_semi")
        report["held_out"] = metrics.macro_f05(decide.apply_decision(sub, knobs), true, rest).first().asDict()
    save(spark, path, models, iso, columns, knobs)
    scored.write.mode("overwrite").parquet(f"{path}/oof")
    return report


def decide_and_write(df: DataFrame, s1: DataFrame, knobs: dict, out_dir: str) -> DataFrame:
    """Selected pairs of scored ``df``; both id lists are written."""
    sel = decide.apply_decision(df, knobs).join(df.select("s1", "p", "prob"), ["s1", "p"])
    named = s1.select(F.col("s1").alias("entity_id"))
    records.write_tsv(records.id_lists(named, sel, records.MATCHING_HEADER, "prob"), f"{out_dir}/matching_results")
    records.write_tsv(records.id_lists(named, df, records.CANDIDATE_HEADER, "prob"), f"{out_dir}/candidate_pairs")
    return sel


def blend(spark: SparkSession, paths: list[str], pairs: DataFrame, s1: DataFrame, out_dir: str, threshold: float = 0.8, alpha: float = 1.0) -> DataFrame:
    """The mean of stored variants' probabilities on new pairs, one decision, both lists written."""
    members = [predict((m := load(spark, p))["models"], m["isotonic"], pairs) for p in paths]
    return decide_and_write(decide.blend(members), s1, {"method": "threshold", "thr": threshold, "alpha": alpha}, out_dir)


def rethreshold(spark: SparkSession, path: str, pairs: DataFrame, s1: DataFrame, out_dir: str, threshold: float) -> DataFrame:
    """A stored variant with another threshold."""
    m = load(spark, path)
    return decide_and_write(predict(m["models"], m["isotonic"], pairs), s1, {"method": "threshold", "thr": threshold, "alpha": m["knobs"].get("alpha", 1.0)}, out_dir)


def fold_study(df: DataFrame, variants: dict[str, list[str]], **params) -> list[tuple[str, float]]:
    """(variant, out-of-fold AUC) of feature sets over the same folds."""
    return [(n, learn.auc(learn.out_of_fold(df, cols, **params)).first()[0]) for n, cols in variants.items()]


def track(spark: SparkSession, path: str, row: dict) -> None:
    """Append one run to a table of experiments."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "run string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
