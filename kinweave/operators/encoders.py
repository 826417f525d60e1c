"""Text encoders and pair scorers behind one interface, run in batches on the executors.

A model is anything that maps a list of texts to vectors, or of text pairs to scores.
It is built once per worker by a factory that the executors can import, so any
library at hand may serve. Where none is, hashed character grams stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from . import vectors

Encoder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[str], list[str]], np.ndarray]


def encode(df: DataFrame, text: str, make: Callable[[], Encoder] | None = None, batch: int = 256, name: str = "v", dims: int = 64) -> DataFrame:
    """``df`` with unit vectors of ``text``; rows run in order of length within a partition, so batches are even."""
    if make is None:
        return df.withColumn(name, vectors.hashed_vector(F.coalesce(F.col(text), F.lit("")), dims).cast("array<float>"))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            out = []
            for i in range(0, len(s), batch):
                v = np.asarray(model(s.iloc[i : i + batch].fillna("").tolist()), dtype=np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                out += (v / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.sortWithinPartitions(F.length(text)).withColumn(name, F.pandas_udf(run, ArrayType(FloatType()))(text))


def score_pairs(df: DataFrame, left: str, right: str, make: Callable[[], PairScorer] | None = None, gate=None, name: str = "ce", otherwise: float = -12.0, batch: int = 256) -> DataFrame:
    """``df`` with a pair score where ``gate`` (a condition) holds and ``otherwise`` elsewhere.

    Only gated rows reach the model. Without a model the score is the logit of the
    pair's hashed-gram likeness.
    """
    gate = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    if make is None:
        v = lambda c: vectors.hashed_vector(F.coalesce(F.col(c), F.lit("")), 64)
        cos = F.least(F.greatest((vectors.dot(v(left), v(right)) + 1) / 2, F.lit(1e-4)), F.lit(1 - 1e-4))
        return df.withColumn(name, F.when(gate, F.ln(cos / (1 - cos))).otherwise(otherwise))

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in parts:
            out = [float(x) for i in range(0, len(a), batch) for x in model(a.iloc[i : i + batch].fillna("").tolist(), b.iloc[i : i + batch].fillna("").tolist())]
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    scored = df.filter(gate).withColumn(name, F.pandas_udf(run, DoubleType())(left, right))
    return scored.unionByName(df.filter(~gate).withColumn(name, F.lit(otherwise)))


def contrastive_pairs(pairs: DataFrame, most: int = 6_000_000, seed: int = 64) -> DataFrame:
    """Training pairs for a bi-encoder: true pairs, at most ``most`` by hash, ordered so that a batch stays within a country.

    Two pairs of one S1 are told apart by ``s1``, so a trainer can mask them as negatives.
    """
    few = pairs.filter("label = 1").orderBy(F.xxhash64("s1", "p", F.lit(seed)), "s1", "p").limit(most)
    return few.repartition("country").sortWithinPartitions("country", F.xxhash64("s1", "p", F.lit(seed)))
