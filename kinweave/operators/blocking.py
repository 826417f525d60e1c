"""Candidate generation: top-K similarity joins, capped key joins, expansion and union.

All joins carry the country as an equality; ranks start at 0; ties go by id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

ABSENT = 999
#: Neighbours per pass and source, when nothing else is configured.
DEFAULT_K = {"w": 5, "e1": 5, "e2": 0, "c": 5, "a": 5}


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "p") -> DataFrame:
    """The k best rows of each group, with ``rank`` from 0; Spark limits groups before it shuffles.

    Scores are rounded to nine decimals first, so that equal ones tie however they were summed.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(score, F.round(score, 9)).withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def dense_top_k(s1: DataFrame, pool: DataFrame, k: int, name: str, block: int = 20_000) -> DataFrame:
    """Exact inner-product neighbours of (doc, country, v) in (doc, country, source, v), for each source.

    Both sides are cut into blocks of about ``block`` vectors; each pair of blocks of a
    country is one matrix product that yields its own k best, so neither all pairs nor
    a whole country meet in one task. The best of all blocks are ranked at the end.
    """
    if k <= 0:
        return empty_pass(s1, pool, name)
    n_q, n_p = -(-max(1, s1.count()) // block), -(-max(1, pool.count()) // block)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = s1.select(F.col("doc").alias("s1"), "country", F.col("v").alias("vq"), F.pmod(F.xxhash64("doc"), F.lit(n_q)).alias("bq"), spread(n_p).alias("bp"))
    p = pool.select(F.col("doc").alias("p"), "country", "source", F.col("v").alias("vp"), F.pmod(F.xxhash64("doc"), F.lit(n_p)).alias("bp"), spread(n_q).alias("bq"))
    kind = lambda d: d.schema["doc"].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a = np.stack(left["vq"]).astype(np.float64)
            for source, side in right.groupby("source"):
                side = side.sort_values("p", kind="stable")  # equal scores go by id
                b = np.stack(side["vp"]).astype(np.float64)
                for i in range(0, len(a), 2048):
                    score = a[i : i + 2048] @ b.T
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    n = top.shape[1]
                    out.append(pd.DataFrame({"s1": np.repeat(left["s1"].to_numpy()[i : i + 2048], n), "p": side["p"].to_numpy()[top.ravel()], "source": source, "score": np.take_along_axis(score, top, axis=1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"s1": [], "p": [], "source": [], "score": []})

    keys = ["country", "bq", "bp"]
    scored = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(best, f"s1 {kind(s1)}, p {kind(pool)}, source string, score double")
    return top_k(scored, k, ["s1", "source"]).select("s1", "p", F.lit(name).alias("pass"), "rank", "score")


def sparse_top_k(s1: DataFrame, pool: DataFrame, k: int, name: str, max_df: int = 3000) -> DataFrame:
    """Cosine neighbours over postings (doc, country, [source], term, w); pairs without a common term never appear.

    Terms that over ``max_df`` pool documents of a country and source have are left
    out on both sides, which bounds the join's fan-out.
    """
    if k <= 0:
        return empty_pass(s1, pool, name)
    df = vectors.document_frequency(pool, ["country", "source"])
    p = vectors.drop_frequent(pool, df, max_df, ["country", "source"])
    sources = pool.select("country", "source").distinct()
    q = s1.select("doc", "country", "term", "w").join(sources, "country")
    frequent = df.filter(F.col("df") > max_df).select("country", "source", "term")
    q = q.join(frequent, ["country", "source", "term"], "left_anti")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc", "source")))
    q = q.withColumn("w", F.col("w") / norm).select(F.col("doc").alias("s1"), "country", "source", "term", F.col("w").alias("wq"))
    p = p.select(F.col("doc").alias("p"), "country", "source", "term", F.col("w").alias("wp"))
    scored = q.join(p, ["country", "source", "term"]).groupBy("s1", "p", "source").agg(F.sum(F.col("wq") * F.col("wp")).alias("score"))
    return top_k(scored, k, ["s1", "source"]).select("s1", "p", F.lit(name).alias("pass"), "rank", "score")


def native_script_top_k(s1: DataFrame, pool: DataFrame, records: DataFrame, k: int, max_df: int = 20_000) -> DataFrame:
    """Address neighbours among pool records with names in another script (``records``: doc, nonlatin)."""
    only = pool.join(records.filter("nonlatin = 1").select("doc"), "doc", "left_semi")
    return sparse_top_k(s1, only, k, "a", max_df)


def key_join(s1: DataFrame, pool: DataFrame, keys: list[str], cap: int, name: str) -> DataFrame:
    """Pairs equal in all ``keys`` and country; empty keys and pool groups over ``cap`` are skipped."""
    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in keys])
    by = [*keys, "country"]
    p = pool.filter(full)
    small = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cap).select(*by)
    p = p.join(small, by, "left_semi").select(F.col("doc").alias("p"), *by)
    q = s1.filter(full).select(F.col("doc").alias("s1"), *by)
    return q.join(p, by).select("s1", "p", F.lit(name).alias("pass"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("score"))


def empty_pass(s1: DataFrame, pool: DataFrame, name: str) -> DataFrame:
    kind = lambda d: d.schema["doc"].dataType.simpleString()
    return s1.sparkSession.createDataFrame([], f"s1 {kind(s1)}, p {kind(pool)}, pass string, rank int, score double")


def union_passes(*passes: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), passes)


def union_at_k(long: DataFrame, k: dict[str, int], passes: list[str]) -> DataFrame:
    """One row per pair with each pass's best rank under its K (999 where absent); a pass without a K is not limited."""
    limit = F.coalesce(*[F.when(F.col("pass") == p, F.lit(n)) for p, n in k.items()], F.lit(10**6)) if k else F.lit(10**6)
    rank = lambda p: F.coalesce(F.min(F.when(F.col("pass") == p, F.col("rank"))), F.lit(ABSENT)).cast("int").alias(f"r_{p}")
    return long.filter(F.col("rank") < limit).groupBy("s1", "p").agg(*[rank(p) for p in passes])


def append_pairs(direct: DataFrame, more: DataFrame) -> DataFrame:
    """Direct and added pairs together; ranks that one side lacks are 999."""
    both = direct.unionByName(more, allowMissingColumns=True)
    return both.na.fill(ABSENT, [c for c in both.columns if c.startswith("r_")])


def n_pass(df: DataFrame) -> DataFrame:
    """Adds the number of passes that found a pair, the late ``f`` pass aside."""
    ranks = [c for c in df.columns if c.startswith("r_") and c != "r_f"]
    return df.withColumn("n_pass", sum(((F.col(c) < ABSENT).cast("int") for c in ranks), F.lit(0)))


def pool_neighbours(queries: DataFrame, pool: DataFrame, k: int, max_df: int, per_source: bool = True) -> DataFrame:
    """(q, p, source, rank, score): cosine neighbours of pool records among pool records of their country."""
    part = ["country", "source"] if per_source else ["country"]
    df = vectors.document_frequency(pool, part)
    p = vectors.drop_frequent(pool, df, max_df, part)
    q = queries.select("doc", "country", "term", "w")
    if per_source:
        q = q.join(pool.select("country", "source").distinct(), "country")
    q = q.join(df.filter(F.col("df") > max_df).select(*part, "term"), [*part, "term"], "left_anti")
    over = ["doc", "source"] if per_source else ["doc"]
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*over)))
    q = q.withColumn("w", F.col("w") / norm).select(F.col("doc").alias("q"), *part, "term", F.col("w").alias("wq"))
    p = p.select(F.col("doc").alias("p"), *part, "term", F.col("w").alias("wp"))
    group = ["q", "source"] if per_source else ["q"]
    scored = q.join(p, [*part, "term"]).groupBy(*group, "p").agg(F.sum(F.col("wq") * F.col("wp")).alias("score"))
    return top_k(scored, k, group)


def pool_twins(pool: DataFrame, records: DataFrame, k: int = 6, max_df: int = 20_000) -> DataFrame:
    """(p, p_twin1, p_twin3, p_ntwin80): how alike the nearest other pool records are.

    The record itself is among its k neighbours and is left out; 0 where there is none.
    """
    near = pool_neighbours(pool, pool, k, max_df, per_source=False).filter("q <> p")
    best = near.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("v"))  # k - 1 at most
    at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    close = F.coalesce(F.size(F.filter("v", lambda x: x >= 0.8)), F.lit(0))
    return records.select(F.col("doc").alias("p")).join(best.withColumnRenamed("q", "p"), "p", "left").select("p", at(0).alias("p_twin1"), at(2).alias("p_twin3"), F.when(F.col("v").isNull(), 0).otherwise(close).alias("p_ntwin80"))


def sibling_expand(scored: DataFrame, pool: DataFrame, k: int, least: float, top: int, max_df: int = 20_000, score: str = "combo") -> DataFrame:
    """New (s1, p, rank): pool neighbours of each S1's best candidates that are not candidates yet.

    The ``top`` candidates with a score of ``least`` or more ask, for each source, for
    their k + 1 neighbours (themselves included).
    """
    w = Window.partitionBy("s1").orderBy(F.desc(score), F.asc("p"))
    asks = scored.withColumn("i", F.row_number().over(w)).filter((F.col("i") <= top) & (F.col(score) >= least)).select("s1", F.col("p").alias("q"))
    queries = pool.join(asks.select(F.col("q").alias("doc")).distinct(), "doc", "left_semi")
    near = pool_neighbours(queries, pool, k + 1, max_df)
    new = asks.join(near, "q").groupBy("s1", "p").agg(F.min("rank").alias("rank"))
    return new.join(scored.select("s1", "p"), ["s1", "p"], "left_anti")


def tune_k(long: DataFrame, truth: DataFrame, n_s1: int, k_max: int = 40) -> DataFrame:
    """(pass, k, recall, per_s1): what each pass finds at each K, from the ranks of one run."""
    hit = long.join(truth.withColumn("hit", F.lit(1)), ["s1", "p"], "left").na.fill(0, ["hit"])
    step = hit.groupBy("pass", "rank").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).filter(F.col("rank") < k_max)
    w = Window.partitionBy("pass").orderBy("rank")
    total = F.greatest(truth.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    return step.withColumn("total", total).select("pass", (F.col("rank") + 1).alias("k"), (F.sum("hits").over(w) / F.col("total")).alias("recall"), (F.sum("n").over(w) / F.lit(n_s1)).alias("per_s1"))


def choose_k(curve: list[tuple[int, float]], target: float = 0.98, most: int = 15) -> int:
    """The least K that reaches the target recall, else the knee (furthest above the chord), at most ``most``."""
    curve = sorted(curve)
    for k, r in curve:
        if r >= target:
            return min(k, most)
    if len(curve) < 3:
        return min(curve[-1][0], most) if curve else 0
    (k0, r0), (k1, r1) = curve[0], curve[-1]
    above = lambda k, r: (r - r0) / max(r1 - r0, 1e-12) - (k - k0) / max(k1 - k0, 1)
    return min(max(curve, key=lambda x: above(*x))[0], most)
