"""Evaluation: F0.5 per entity, blocking quality, and corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_truth: Column) -> Column:
    """1 if nothing is true nor predicted, 0 if one side is empty or nothing is hit, else 1.25 tp / (pred + truth / 4)."""
    return F.when((n_pred == 0) & (n_truth == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (n_pred + 0.25 * n_truth))


def per_entity(pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(s1, n_pred, n_truth, tp, f05) of every S1, candidates or not; repeated pairs count once."""
    both = pred.select("s1", "p").distinct().withColumn("a", F.lit(1)).join(truth.select("s1", "p").distinct().withColumn("b", F.lit(1)), ["s1", "p"], "full_outer").na.fill(0, ["a", "b"])
    n = both.groupBy("s1").agg(F.sum("a").alias("n_pred"), F.sum("b").alias("n_truth"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    d = s1.select("s1").distinct().join(n, "s1", "left").na.fill(0, ["n_pred", "n_truth", "tp"])
    return d.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_truth")))


def macro_f05(pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """One row: overall, singleton and non-singleton means and their numbers of entities."""
    single = F.col("n_truth") == 0
    return per_entity(pred, truth, s1).agg(
        F.avg("f05").alias("overall"), F.avg(F.when(single, F.col("f05"))).alias("singleton"), F.avg(F.when(~single, F.col("f05"))).alias("non_singleton"),
        F.sum(single.cast("int")).alias("n_singleton"), F.sum((~single).cast("int")).alias("n_non_singleton"),
    )


def blocking_quality(candidates: DataFrame, truth: DataFrame, n_s1: int, n_pool: int) -> DataFrame:
    """One row: recall of true pairs, number of candidates, reduction ratio."""
    c = candidates.select("s1", "p").distinct().withColumn("c", F.lit(1))
    t = truth.select("s1", "p").distinct().withColumn("t", F.lit(1))
    n = c.join(t, ["s1", "p"], "full_outer").agg(F.sum(F.when(F.col("c").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hits"), F.count("t").alias("n_true"), F.count("c").alias("n_candidates"))
    return n.select((F.col("hits") / F.greatest("n_true", F.lit(1))).alias("recall"), "n_candidates", (1 - F.col("n_candidates") / F.lit(float(n_s1 * n_pool))).alias("reduction_ratio"))


def oracle_f05(candidates: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """The macro F0.5 of choosing exactly the true ones among the candidates."""
    hit = candidates.select("s1", "p").distinct().join(truth.select("s1", "p").distinct(), ["s1", "p"])
    return macro_f05(hit, truth, s1).select(F.col("overall").alias("oracle_f05"))


def match_histogram(truth: DataFrame, s1: DataFrame, most: int = 10) -> DataFrame:
    """(matches, n): how many S1s have so many matches; ``most`` and over together."""
    n = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("k"))
    d = s1.select("s1").join(n, "s1", "left").na.fill(0, ["k"])
    return d.groupBy(F.least("k", F.lit(most)).alias("matches")).agg(F.count(F.lit(1)).alias("n"))


def summary(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: singleton share, mean matches, pool records with several owners, share of pairs within one country.

    ``s1`` is (s1, country), ``pool`` (p, country).
    """
    per = s1.select("s1").join(truth.groupBy("s1").agg(F.count(F.lit(1)).alias("k")), "s1", "left").na.fill(0, ["k"]).agg(F.avg((F.col("k") == 0).cast("double")).alias("singleton_rate"), F.avg("k").alias("mean_matches"))
    owners = truth.groupBy("p").agg(F.countDistinct("s1").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("multi_owner"))
    same = truth.join(s1.select("s1", F.col("country").alias("ca")), "s1").join(pool.select("p", F.col("country").alias("cb")), "p").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("same_country"))
    return per.select("*", owners.scalar().alias("multi_owner"), same.scalar().alias("same_country"))


def empty_rates(records: DataFrame, columns: list[str], by: str = "source") -> DataFrame:
    """Share of empty values of each column, by source."""
    return records.groupBy(by).agg(*[F.avg((F.coalesce(F.col(c), F.lit("")) == "").cast("double")).alias(f"{c}_empty") for c in columns], F.count(F.lit(1)).alias("n"))


def probability_histogram(df: DataFrame, value: str = "prob", bins: int = 10) -> DataFrame:
    """(bin, n) over [0, 1]; 1 falls into the last bin."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def country_summary(pred: DataFrame, candidates: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, n_s1, matches_per_s1, empty_share, candidates_per_s1)."""
    n = lambda d, name: d.groupBy("s1").agg(F.count(F.lit(1)).alias(name))
    d = s1.select("s1", "country").join(n(pred, "m"), "s1", "left").join(n(candidates, "c"), "s1", "left").na.fill(0, ["m", "c"])
    return d.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.avg("m").alias("matches_per_s1"), F.avg((F.col("m") == 0).cast("double")).alias("empty_share"), F.avg("c").alias("candidates_per_s1"))
