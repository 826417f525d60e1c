"""Text as vectors: weighted postings in SQL, hashed dense vectors, and their products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def words(text: str) -> Column:
    """Words of two characters or more."""
    return F.filter(F.split(F.lower(F.col(text)), r"\W+"), lambda t: F.length(t) > 1)


def word_grams(text: str, most: int = 2) -> Column:
    """Words and runs of up to ``most`` words."""
    w = words(text)
    out = w
    for n in range(2, most + 1):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i, n=n: F.array_join(F.slice(w, i, n), " "))
        out = F.concat(out, F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>")))
    return out


def char_grams(text: str, n: int = 3) -> Column:
    t = F.col(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def term_counts(docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """(doc, *keep, term, tf)."""
    return docs.select("doc", *keep, F.explode(terms).alias("term")).groupBy("doc", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def unit_length(postings: DataFrame, weight: str = "w") -> DataFrame:
    """Weights divided by the document's Euclidean norm."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy("doc")))
    return postings.withColumn(weight, F.col(weight) / norm)


def tfidf(counts: DataFrame, n_docs: int | Column, min_df: int = 2) -> DataFrame:
    """Postings (doc, …, term, w): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length; terms in under ``min_df`` documents go."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    w = (1 + F.ln("tf")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1)
    return unit_length(counts.join(df, "term").withColumn("w", w)).drop("tf", "df")


def drop_frequent(postings: DataFrame, df: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Leaves out terms that over ``most`` pool documents of a partition have, and renormalises.

    ``df`` (by…, term, df) counts pool documents of each partition. Terms the pool does
    not have cannot match and count as rare.
    """
    frequent = df.filter(F.col("df") > most).select(*by, "term")
    return unit_length(postings.join(frequent, [*by, "term"], "left_anti"))


def document_frequency(postings: DataFrame, by: list[str]) -> DataFrame:
    return postings.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


def token_idf(tokens: DataFrame, n_docs: int | Column) -> DataFrame:
    """(term, idf): ln(documents / occurrences), occurrences within a document counting each time."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return tokens.groupBy("term").agg(F.ln(n / F.count(F.lit(1))).alias("idf"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """A unit vector of signed hashed character 3-grams: the stand-in where no encoder is at hand.

    An Arrow UDF: as a higher-order expression it would pass over the grams once for
    each dimension.
    """

    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s.fillna(""):
            b = np.frombuffer(f"  {t.lower()} ".encode(), dtype=np.uint8).astype(np.uint64)
            h = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * np.uint64(0x9E3779B97F4A7C15)
            v = np.bincount(((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dims)
            out.append(v / max(np.sqrt(v @ v), 1e-300))
        return pd.Series(out)

    return F.pandas_udf(run, ArrayType(DoubleType()))(text)


def sparse_pair_score(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """``pairs`` (s1, p, …) with the product of their postings; 0 where they share no term."""
    l, r = left.select(F.col("doc").alias("s1"), "term", F.col("w").alias("wl")), right.select(F.col("doc").alias("p"), "term", F.col("w").alias("wr"))
    got = pairs.select("s1", "p").join(l, "s1").join(r, ["p", "term"]).groupBy("s1", "p").agg(F.sum(F.col("wl") * F.col("wr")).alias(name))
    return pairs.join(got, ["s1", "p"], "left").na.fill(0.0, [name])


def dense_pair_score(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the inner product of their vectors (doc, v)."""
    l, r = left.select(F.col("doc").alias("s1"), F.col("v").alias("vl")), right.select(F.col("doc").alias("p"), F.col("v").alias("vr"))
    return pairs.join(l, "s1").join(r, "p").withColumn(name, dot(F.col("vl"), F.col("vr"))).drop("vl", "vr")
