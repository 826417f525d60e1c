"""Operators that the matching system describes beside its main plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import top_k


def stratified_split(s1: DataFrame, truth: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``held``: a share of each stratum (singleton or not, country), by hash rank within it."""
    d = s1.join(truth.select("s1").distinct().withColumn("_m", F.lit(1)), "s1", "left").withColumn("singleton", F.col("_m").isNull())
    w = Window.partitionBy("singleton", "country")
    rank = F.row_number().over(w.orderBy(F.xxhash64("s1", F.lit(seed)), "s1"))
    return d.withColumn("held", rank <= F.floor(F.count(F.lit(1)).over(w) * share)).drop("_m")


#: Weight of each key in the combined score.
KEY_WEIGHTS = {"name": 1.0, "ascii": 1.0, "digits": 1.5, "street": 2.0, "post": 2.0, "rare": 1.5, "prefix": 1.5}


def index_keys(records: DataFrame) -> DataFrame:
    """(doc, strategy, key): seven kinds of inverted-index keys of normalised records, empty ones left out."""
    part = lambda c, n: F.substring(c, 1, n)
    words = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) > 2)
    both = lambda a, b: F.when((a != "") & (b != ""), F.array(F.concat_ws("|", a, b))).otherwise(F.array().cast("array<string>"))
    long = F.array_sort(F.filter(F.split("addr_words", " "), lambda t: F.length(t) > 4))
    ways: dict[str, Column] = {
        "name": words("name_core"), "ascii": words("name_norm"), "digits": F.filter(F.split("name_nums", " "), lambda t: t != ""), "street": both(F.col("primary_num"), part("addr_words", 6)),
        "post": both(F.col("postcode"), F.col("primary_num")), "rare": F.when(F.size(long) > 1, F.array(F.concat_ws("|", F.get(long, F.lit(0)), F.get(long, F.lit(1))))).otherwise(F.array().cast("array<string>")),
        "prefix": both(part("name_compact", 4), part("addr_core", 4)),
    }
    each = [records.select("doc", F.lit(n).alias("strategy"), F.explode(F.array_distinct(k)).alias("key")) for n, k in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


def inverted_index_candidates(s1: DataFrame, pool: DataFrame, k: int = 25, most: int = 1000, weights: dict[str, float] | None = None) -> DataFrame:
    """The k best pool records of each S1 by the sum of weight / (frequency + 1) over shared keys.

    Keys of more than ``most`` pool records tell nothing and are left out.
    """
    weights = KEY_WEIGHTS | (weights or {})
    weight = F.coalesce(*[F.when(F.col("strategy") == n, F.lit(w)) for n, w in weights.items()], F.lit(0.0))
    freq = pool.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    p = pool.join(freq, ["strategy", "key"]).select("strategy", "key", F.col("doc").alias("p"), "n")
    scored = s1.select(F.col("doc").alias("s1"), "strategy", "key").join(p, ["strategy", "key"]).groupBy("s1", "p").agg(F.sum(weight / (F.col("n") + 1)).alias("score"))
    return top_k(scored, k, ["s1"])


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct words that b has; -1 if a is empty."""
    x = F.array_distinct(F.filter(F.split(a, " "), lambda t: t != ""))
    y = F.array_distinct(F.filter(F.split(b, " "), lambda t: t != ""))
    return F.when(F.size(x) == 0, -1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard likeness of the sets of character n-grams; 0 if a side is shorter than n."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n))))
    x, y = grams(a), grams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.length(a) < n) | (F.length(b) < n), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared))


def match_flag(a: Column, b: Column) -> Column:
    """1 equal, -1 different, 0 if either is missing."""
    return F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(-1)


def log_number_gap(a: Column, b: Column) -> Column:
    """ln(1 + |difference|) of two numbers in text; -1 if either is none."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.ln(1 + F.abs(x - y)), F.lit(-1.0))


def composites(name: Column, address: Column) -> dict[str, Column]:
    """Harmonic mean, minimum and product of two likenesses."""
    return {"harmonic": F.when(name + address > 0, 2 * name * address / (name + address)).otherwise(0.0), "least": F.least(name, address), "product": name * address}
