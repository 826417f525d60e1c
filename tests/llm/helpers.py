"""Small awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "za") for b in ("bel", "dor", "fin", "gat", "hul", "jor", "kin", "lum", "mor", "nis")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS, k=n))


def awkward(spark, extra=()):
    rows = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, None, None, None), (None, "text without an id", "en", "b"), (4, "", "en", "a"), (5, " \n\t ", "en", "a"),
        (6, prose(6, 30_000), "en", "a"), (7, "x" * 50_000, "en", "a"), (8, "Ünïcödé ΣΑΣ ẞ 日本語 🙂 <|endoftext|> 12²", "de", "a"), (9, prose(9, 3), "en", "c"), (9, prose(9, 3), "en", "c"), (10, prose(1, 60) + " changed " + prose(10, 60), "en", "a"),
        *extra,
    ]
    return spark.createDataFrame([(*r, i, f"k{i}") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key string").withColumnRenamed("key", "fp")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
