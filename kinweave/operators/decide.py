"""Decisions: one-owner damping, thresholds, expected-F subsets, blends and the knob grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def one_owner(df: DataFrame, prob: str = "prob", alpha: float = 1.0) -> DataFrame:
    """Adds ``decided``: probabilities below the pool record's best are multiplied by ``alpha``; ties keep all."""
    if alpha >= 1:
        return df.withColumn("decided", F.col(prob))
    d = with_best(df, prob)
    return d.withColumn("decided", F.when(F.col(prob) >= F.col("_best"), F.col(prob)).otherwise(F.col(prob) * alpha)).drop("_best")


def with_best(df: DataFrame, prob: str) -> DataFrame:
    """Adds ``_best``, the pool record's largest probability: a pre-aggregated maximum joined back, so hot records may be split."""
    return df.join(df.groupBy("p").agg(F.max(prob).alias("_best")), "p").select(*df.columns, "_best")


def hard_owner(df: DataFrame, prob: str = "prob") -> DataFrame:
    """One S1 for each pool record: the most probable, then the least id."""
    w = Window.partitionBy("p").orderBy(F.desc(prob), F.asc("s1"))
    return df.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def select_threshold(df: DataFrame, threshold: float, prob: str = "decided") -> DataFrame:
    return df.filter(F.col(prob) >= threshold).select("s1", "p")


def expected_f(q: np.ndarray, beta2: float = 0.25) -> np.ndarray:
    """Expected F of taking the first k of the records with independent probabilities q, for k = 0..n.

    Exact: the numbers of true records among the taken and the left ones have
    Poisson-binomial distributions, grown one record at a time.
    """
    n = len(q)
    rest = [np.array([1.0])]  # distributions of the true ones among the last records
    for p in q[::-1]:
        rest.append(np.convolve(rest[-1], [1 - p, p]))
    rest.reverse()
    out, taken = [float(np.prod(1 - q))], np.array([1.0])
    for k in range(1, n + 1):
        taken = np.convolve(taken, [1 - q[k - 1], q[k - 1]])
        tp, more = np.arange(len(taken))[:, None], np.arange(len(rest[k]))[None, :]
        f = (1 + beta2) * tp / (k + beta2 * (tp + more))
        out.append(float(taken @ f @ rest[k]))
    return np.array(out)


def select_expected_f(df: DataFrame, p_min: float, temp: float = 1.0, prob: str = "decided", most: int = 16) -> DataFrame:
    """For each S1 the best-first subset with the largest expected F0.5 (at most ``most``; ties take fewer)."""
    q = df.select("s1", "p", F.pow(F.greatest(F.least(F.col(prob), F.lit(1.0)), F.lit(0.0)), F.lit(temp)).alias("q")).filter(F.col("q") > p_min)
    w = Window.partitionBy("s1").orderBy(F.desc("q"), F.asc("p"))
    q = q.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most)
    lists = q.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("i", "p", "q"))).alias("x"))  # at most ``most`` each

    def size(x: pd.Series) -> pd.Series:
        return pd.Series([int(np.argmax(np.round(expected_f(np.array(list(v), dtype=float)), 12))) for v in x], dtype="int32")

    k = F.pandas_udf(size, "int")(F.transform("x", lambda r: r["q"]))
    return lists.withColumn("k", k).select("s1", F.explode(F.slice("x", F.lit(1), F.col("k"))).alias("r")).select("s1", "r.p")


def apply_decision(df: DataFrame, knobs: dict, prob: str = "prob") -> DataFrame:
    """Selected (s1, p) by knobs: method threshold or expected_f, alpha, thr, p_min, temp."""
    d = one_owner(df, prob, knobs.get("alpha", 1.0))
    if knobs.get("method", "threshold") == "expected_f":
        return select_expected_f(d, knobs["p_min"], knobs.get("temp", 1.0))
    return select_threshold(d, knobs["thr"])


def blend(members: list[DataFrame], name: str = "prob") -> DataFrame:
    """(s1, p, prob): the mean of all members' probabilities; members cover the same pairs."""
    out = members[0].select("s1", "p", F.col(name).alias("m0"))
    for i, m in enumerate(members[1:], 1):
        out = out.join(m.select("s1", "p", F.col(name).alias(f"m{i}")), ["s1", "p"])
    total = sum((F.col(f"m{i}") for i in range(1, len(members))), F.col("m0"))
    return out.select("s1", "p", (total / len(members)).alias(name))


def weighted_blend(df: DataFrame, weights: dict[str, float], name: str = "prob") -> DataFrame:
    """One probability from several columns by fixed weights."""
    return df.withColumn(name, sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()))


def member_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.corr(a, b).alias("corr"))


def threshold_grid(df: DataFrame, truth: DataFrame, s1: DataFrame, alphas=(0.0, 0.3, 1.0), thresholds=None, prob: str = "prob") -> DataFrame:
    """(alpha, thr, f05): the metric of every setting of the grid, in one grouped aggregation.

    Each pair is spread over the thresholds that select it; S1s without a selected pair
    count as the metric says. ``s1`` is (s1), every entity that counts.
    """
    thresholds = thresholds or [round(0.30 + 0.05 * i, 2) for i in range(13)]
    d = with_best(df, prob)
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("thr")) for a in alphas for t in thresholds])).alias("g")
    hit = truth.select("s1", "p", F.lit(1).alias("hit"))
    d = d.join(hit, ["s1", "p"], "left").select("s1", "p", F.coalesce("hit", F.lit(0)).alias("hit"), prob, "_best", grid).select("*", "g.*")
    d = d.filter(F.when(F.col(prob) >= F.col("_best"), F.col(prob)).otherwise(F.col(prob) * F.col("alpha")) >= F.col("thr"))
    per = d.groupBy("alpha", "thr", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("tp"))
    n_truth = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_truth"))
    base = s1.select("s1").join(n_truth, "s1", "left").na.fill(0, ["n_truth"])
    every = base.select("s1", "n_truth", grid).select("s1", "n_truth", "g.*").join(per, ["alpha", "thr", "s1"], "left").na.fill(0, ["n_pred", "tp"])
    return every.groupBy("alpha", "thr").agg(F.avg(metrics.f05(F.col("tp"), F.col("n_pred"), F.col("n_truth"))).alias("f05"))


def tune(df: DataFrame, truth: DataFrame, s1: DataFrame, most: int = 200_000, prob: str = "prob") -> dict:
    """The best knobs on at most ``most`` S1s: thresholds for each alpha, then expected-F settings at the best alpha."""
    few = s1.orderBy(F.xxhash64("s1"), "s1").limit(most).persist()
    sub, true = df.join(few, "s1", "left_semi").persist(), truth.join(few, "s1", "left_semi").persist()
    table = [r.asDict() | {"method": "threshold"} for r in threshold_grid(sub, true, few, prob=prob).collect()]  # 39 rows
    alpha = max(table, key=lambda r: (r["f05"], -r["alpha"], -r["thr"]))["alpha"]
    for temp in (0.8, 1.0, 1.2, 1.5):
        for p_min in (0.05, 0.1, 0.2, 0.3):
            knobs = {"method": "expected_f", "temp": temp, "p_min": p_min, "alpha": alpha}
            table.append(knobs | {"f05": metrics.macro_f05(apply_decision(sub, knobs, prob), true, few).first()["overall"]})
    best = max(table, key=lambda r: r["f05"])
    return {k: best[k] for k in ("method", "alpha", "thr", "temp", "p_min", "f05") if k in best}
