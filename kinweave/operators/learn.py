"""Pair classifiers: grouped folds, boosted trees, calibration, ensembles and studies."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Never features: keys, labels, fold marks, and the late pass that stage 2 alone may see.
NOT_FEATURES = {"s1", "p", "label", "prob", "oof", "fold", "weight", "raw", "r_f", "cos_f", "source", "country"}
#: Default tree parameters; ``fit_trees`` stops early only where it is given a validation column.
TREES = {"maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "featureSubsetStrategy": "0.8", "maxIter": 60}


def feature_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES and c not in drop]


def fold_of(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """A group's fold, the same wherever it is computed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of ``n`` keys chosen by hash; the same for the same keys and seed."""
    few = df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
    return df.join(few, key, "left_semi")


def group_weights(df: DataFrame, power: float = 1.0) -> DataFrame:
    """Adds ``weight``: 1 / n**power of the S1's pairs, scaled to a mean of 1."""
    d = df.withColumn("_w", F.pow(F.count(F.lit(1)).over(Window.partitionBy("s1")).cast("double"), F.lit(-power)))
    return d.withColumn("weight", F.col("_w") / d.agg(F.avg("_w")).scalar()).drop("_w")


def fit_trees(df: DataFrame, features: list[str], seed: int = 42, weight: str | None = None, validation: str | None = None, **params) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=seed, predictionCol="_hard", **(TREES | params)).setRawPredictionCol("_raw").setProbabilityCol("_prob")
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return PipelineModel([assembler, gbt.fit(assembler.transform(df))])


def predict(model: PipelineModel, df: DataFrame, name: str = "raw") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("_prob")[1]).drop("features", "_hard", "_raw", "_prob")


def out_of_fold(df: DataFrame, features: list[str], folds: int = 5, seed: int = 42, weight: str | None = None, fold_seed: int | None = None, **params) -> DataFrame:
    """``df`` with ``raw``: each pair scored by the model that saw no pair of its S1; folds go by ``fold_seed`` or else ``seed``."""
    d = df.withColumn("fold", fold_of(F.col("s1"), folds, seed if fold_seed is None else fold_seed)).persist()
    parts = []
    for k in range(folds):
        model = fit_trees(d.filter(F.col("fold") != k), features, seed, weight, **params)
        parts.append(predict(model, d.filter(F.col("fold") == k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fit_isotonic(df: DataFrame, raw: str = "raw", label: str = "label"):
    """Monotone calibration of a score by pooling; scores outside are clipped to the ends."""
    return IsotonicRegression(featuresCol=raw, labelCol=label, predictionCol="prob").fit(df)


def calibrate(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def ensemble(df: DataFrame, features: list[str], seeds=(42, 43, 44), **params) -> tuple[list[PipelineModel], DataFrame]:
    """(models, mean out-of-fold score) over seeds; folds are the first seed's for all."""
    models, outs = [], []
    for s in seeds:
        models.append(fit_trees(df, features, s, **params))
        outs.append(out_of_fold(df, features, seed=s, fold_seed=seeds[0], **params).select("s1", "p", F.col("raw").alias(f"raw_{s}")))
    scored = reduce(lambda a, b: a.join(b, ["s1", "p"]), outs)
    mean = sum((F.col(f"raw_{s}") for s in seeds), F.lit(0.0)) / len(seeds)
    return models, df.join(scored.select("s1", "p", mean.alias("raw")), ["s1", "p"])


def importance(model: PipelineModel, features: list[str], top: int = 30) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:top]


def auc(df: DataFrame, score: str = "raw", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve by rank sums, tied scores sharing their mean rank.

    Negatives below a score are those of all lower bins (1024 over the scores' range)
    and those below it in its own bin, so no task sorts all scores.
    """
    ends = df.agg(F.min(score).alias("a"), F.max(score).alias("b"))
    low, high = ends.select("a").scalar(), ends.select("b").scalar()
    b = F.coalesce(F.floor(F.try_divide((F.col(score) - low) * 1024, high - low)), F.lit(0))
    per = df.withColumn("_bin", b).groupBy("_bin", score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    neg, before = F.col("n") - F.col("pos"), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = per.groupBy("_bin").agg(F.sum(neg).alias("neg"))  # 1025 rows at most
    bins = bins.select("_bin", F.coalesce(F.sum("neg").over(before(Window.orderBy("_bin"))), F.lit(0.0)).alias("base"))
    within = F.coalesce(F.sum(neg).over(before(Window.partitionBy("_bin").orderBy(score))), F.lit(0.0))
    d = per.withColumn("within", within).join(F.broadcast(bins), "_bin").withColumn("below", F.col("base") + F.col("within"))
    return d.agg((F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)) / (F.sum("pos") * F.sum(F.col("n") - F.col("pos")))).alias("auc"))


def leave_country_out(df: DataFrame, features: list[str], **params) -> DataFrame:
    """``df`` with ``prob``: each country scored by trees of the others, calibrated on a fifth of their S1s."""
    parts = []
    for (country,) in df.select("country").distinct().orderBy("country").collect():
        rest, held = df.filter(F.col("country") != country), df.filter(F.col("country") == country)
        part = rest.withColumn("_c", fold_of(F.col("s1"), 5, 7))
        model = fit_trees(part.filter("_c <> 0").drop("_c"), features, **params)
        iso = fit_isotonic(predict(model, part.filter("_c = 0").drop("_c")))
        parts.append(calibrate(iso, predict(model, held)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def mine_pairs(df: DataFrame, hard: int = 6, easy: int = 2, seed: int = 11) -> DataFrame:
    """Encoder training pairs: all positives, each S1's best-scored negatives and some at random, each pair once."""
    best = Window.partitionBy("s1").orderBy(F.desc("combo"), F.asc("p"))
    lot = Window.partitionBy("s1").orderBy(F.xxhash64("p", F.lit(seed)), F.asc("p"))
    neg = df.filter("label = 0").withColumn("_b", F.row_number().over(best)).withColumn("_r", F.row_number().over(lot))
    return df.filter("label = 1").select("s1", "p", "label").unionByName(neg.filter((F.col("_b") <= hard) | (F.col("_r") <= easy)).select("s1", "p", "label"))


def hard_examples(df: DataFrame, negatives: float = 0.2, positives: float = 0.8) -> DataFrame:
    """Negatives that stage 1 believes and positives that it doubts."""
    return df.filter(((F.col("label") == 0) & (F.col("p1") >= negatives)) | ((F.col("label") == 1) & (F.col("p1") <= positives)))


def pseudo_labels(df: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Sure pairs with the label that their probability says."""
    return df.filter((F.col("prob") >= high) | (F.col("prob") <= low)).withColumn("label", (F.col("prob") >= high).cast("int"))


def self_train(labelled: DataFrame, other: DataFrame, features: list[str], bands=((0.05, 0.95), (0.02, 0.98)), **params) -> PipelineModel:
    """Two rounds of training with the sure pairs of the unlabelled side."""
    model = fit_trees(labelled, features, **params)
    for low, high in bands:
        sure = pseudo_labels(predict(model, other, "prob"), low, high)
        cols = [*features, "label"]
        model = fit_trees(labelled.select(*cols).unionByName(sure.select(*cols)), features, **params)
    return model


def ablation(df: DataFrame, groups: dict[str, list[str]], **params) -> list[tuple[str, float]]:
    """(group left out, out-of-fold AUC), the full set first."""
    every = feature_columns(df)
    out = [("none", auc(out_of_fold(df, every, **params)).first()[0])]
    for name, cols in groups.items():
        out.append((name, auc(out_of_fold(df, [c for c in every if c not in cols], **params)).first()[0]))
    return out


def imbalance_weight(df: DataFrame) -> float:
    """Positive weight min(12, max(2, 1.5 * sqrt(negatives / positives)))."""
    n = df.agg(F.sum("label"), F.count(F.lit(1))).first()
    return float(min(12.0, max(2.0, 1.5 * ((n[1] - n[0]) / max(n[0], 1)) ** 0.5)))


def error_rows(pairs: DataFrame, pred: DataFrame, truth: DataFrame, n: int = 200) -> dict[str, DataFrame]:
    """The most probable false positives, and false negatives by model (a candidate) or by blocking (none)."""
    fp = pairs.join(pred, ["s1", "p"], "left_semi").join(truth, ["s1", "p"], "left_anti").orderBy(F.desc("prob"), "s1", "p").limit(n)
    lost = truth.join(pred, ["s1", "p"], "left_anti")
    by_model = pairs.join(lost, ["s1", "p"], "left_semi").orderBy("prob", "s1", "p").limit(n)
    by_blocking = lost.join(pairs.select("s1", "p"), ["s1", "p"], "left_anti").orderBy("s1", "p").limit(n)
    return {"false_positive": fp, "false_negative_model": by_model, "false_negative_blocking": by_blocking}


def shard(df: DataFrame, i: int, n: int, *keys: str) -> DataFrame:
    """The i-th of n parts by key hash; the parts make up the whole."""
    return df.filter(F.pmod(F.xxhash64(*[F.col(k) for k in keys or ("s1", "p")]), F.lit(n)) == i)
