"""The whole plan: records to candidates, features, two stages of scoring and a decision."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocking, decide, features, learn, metrics, vectors
from ..sources import records
from .config import Config


def staged(df: DataFrame, cfg: Config, name: str) -> DataFrame:
    """Written and read again where a work folder is set (cuts lineage); the plan goes on otherwise."""
    if not cfg.work_dir:
        return df
    path = f"{cfg.work_dir}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spaces(s1: DataFrame, pool: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """TF-IDF postings of S1 and pool in the word, character and address spaces, fitted on both."""
    both = s1.withColumn("side", F.lit("q")).unionByName(pool.withColumn("side", F.lit("p")))
    n = both.count()
    out = {}
    ways = {
        "word": (F.concat_ws(" ", "name_core", "addr_core"), lambda: vectors.word_grams("text", 2)),
        "char": (F.col("name_compact"), lambda: vectors.char_grams("text", 3)),
        "addr": (F.col("addr_core"), lambda: vectors.words("text")),
    }
    for name, (source, terms) in ways.items():
        d = both.select(F.col("entity_id").alias("doc"), "side", "country", "source", source.alias("text"))
        post = vectors.tfidf(vectors.term_counts(d, terms(), "side", "country", "source"), n)
        out[name] = (post.filter("side = 'q'").drop("side"), post.filter("side = 'p'").drop("side"))
    return out


def candidates(s1: DataFrame, pool: DataFrame, cfg: Config) -> DataFrame:
    """Candidate pairs of normalised records with pass ranks, scores, context and twin features."""
    k = cfg.passes()
    sp = {n: tuple(staged(x, cfg, f"{n}-{i}") for i, x in enumerate(v)) for n, v in spaces(s1, pool).items()}
    doc = lambda d: d.withColumnRenamed("entity_id", "doc")
    dense = lambda d, t: d.select(F.col("entity_id").alias("doc"), "country", "source", vectors.hashed_vector(t).alias("v"))
    full, name = F.concat_ws(" ", "name_norm", "addr_norm"), F.col("name_norm")
    e1 = (staged(dense(s1, full), cfg, "e1-q"), staged(dense(pool, full), cfg, "e1-p"))
    e2 = (staged(dense(s1, name), cfg, "e2-q"), staged(dense(pool, name), cfg, "e2-p"))
    first = lambda d: doc(d).withColumn("nt", F.substring_index("name_core", " ", 1)).withColumn("ph", F.substring_index("name_phon", " ", 1))
    parts = {
        "w": blocking.sparse_top_k(sp["word"][0].drop("source"), sp["word"][1], k["w"], "w", cfg.max_df_word),
        "c": blocking.sparse_top_k(sp["char"][0].drop("source"), sp["char"][1], k["c"], "c", cfg.max_df_char),
        "e1": blocking.dense_top_k(*e1, k["e1"], "e1"), "e2": blocking.dense_top_k(*e2, k["e2"], "e2"),
        "a": blocking.native_script_top_k(sp["addr"][0].drop("source"), sp["addr"][1], doc(pool), k["a"], cfg.max_df_char),
        "x1": blocking.key_join(first(s1), first(pool), ["primary_num", "nt"], cfg.key_cap, "x1"), "x2": blocking.key_join(first(s1), first(pool), ["ph", "city_guess"], cfg.key_cap, "x2"),
    }
    wide = staged(blocking.union_at_k(blocking.union_passes(*parts.values()), k, list(parts)), cfg, "direct")

    def scored(pairs: DataFrame) -> DataFrame:
        d = vectors.dense_pair_score(vectors.dense_pair_score(pairs, *e1, "cos_full"), *e2, "cos_name")
        for c, s in (("tf_word", "word"), ("tf_char", "char"), ("tf_addr", "addr")):
            d = vectors.sparse_pair_score(d, *sp[s], c)
        return features.combo(d)

    d = scored(wide)
    if cfg.sibling_k:
        d = staged(d, cfg, "scored")
        new = blocking.sibling_expand(d, sp["word"][1], cfg.sibling_k, cfg.sibling_min, cfg.sibling_top)
        d = blocking.append_pairs(d, scored(new.withColumnRenamed("rank", "r_s")))
    d = blocking.n_pass(d).join(pool.select(F.col("entity_id").alias("p"), "source", F.col("country").alias("_cp")), "p").join(s1.select(F.col("entity_id").alias("s1"), "country"), "s1")
    d = features.context(d.withColumn("same_country", (F.col("country") == F.col("_cp")).cast("int")).drop("_cp"))
    freq = lambda t, key, n: features.name_frequency(doc(t)).select(F.col("doc").alias(key), F.col("freq").alias(n))
    d = d.join(freq(s1, "s1", "s1_name_freq"), "s1").join(freq(pool, "p", "p_name_freq"), "p")
    d = d.join(blocking.pool_twins(sp["word"][1], doc(pool)), "p", "left")
    idf = vectors.token_idf(s1.select("name_norm").unionByName(pool.select("name_norm")).select(F.explode(text.split_words(F.col("name_norm"))).alias("term")), s1.count() + pool.count())
    return staged(features.string_features(d, doc(s1), doc(pool), idf), cfg, "features")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1", "p", F.lit(1).alias("label")), ["s1", "p"], "left").na.fill(0, ["label"])


def two_stages(pairs: DataFrame, cfg: Config, **params) -> tuple[DataFrame, dict]:
    """Labelled pairs with the final out-of-fold ``prob``, and the fitted models."""
    first = learn.feature_columns(pairs)
    oof = learn.out_of_fold(pairs, first, cfg.folds, cfg.seed, **params)
    iso1 = learn.fit_isotonic(oof)
    p1 = staged(learn.calibrate(iso1, oof).withColumnRenamed("prob", "p1").drop("raw", "fold"), cfg, "stage1")
    s2 = features.stage2(p1).join(p1.select("s1", "p", "label"), ["s1", "p"])
    second = learn.feature_columns(s2)
    raw = learn.out_of_fold(s2, second, cfg.folds, cfg.seed, **params)
    iso2 = learn.fit_isotonic(raw)
    models = {"features": first, "trees": learn.fit_trees(pairs, first, cfg.seed, **params), "isotonic": iso1, "stage2_features": second, "stage2_trees": learn.fit_trees(s2, second, cfg.seed, **params), "stage2_isotonic": iso2}
    return learn.calibrate(iso2, raw).select("s1", "p", "label", "p1", "prob"), models


def score(pairs: DataFrame, models: dict) -> DataFrame:
    """(s1, p, p1, prob) of new pairs by fitted models."""
    p1 = learn.calibrate(models["isotonic"], learn.predict(models["trees"], pairs)).withColumnRenamed("prob", "p1").drop("raw")
    s2 = features.stage2(p1)
    return learn.calibrate(models["stage2_isotonic"], learn.predict(models["stage2_trees"], s2)).select("s1", "p", "p1", "prob")


def match(spark: SparkSession, train_dir: str, test_dir: str, out_dir: str, cfg: Config | None = None, **params) -> dict:
    """Train on one folder, decide on another, write both id lists; returns the report."""
    cfg = cfg or Config.from_env()
    s1, pool = records.load_split(spark, train_dir, "train")
    truth = records.truth_pairs(records.load_truth(spark, train_dir))
    norm = lambda d, n: staged(text.normalize(d, cfg.transliterate), cfg, n)
    n1, np_ = norm(s1, "s1"), norm(pool, "pool")
    pairs = label(candidates(n1, np_, cfg), truth)
    # Entities without a candidate count too, so the sample is one of entities, and the metric is over it.
    ids = staged(learn.sample(s1.select(F.col("entity_id").alias("s1")), "s1", cfg.train_sample, cfg.seed), cfg, "sample")
    oof, models = two_stages(pairs.join(ids, "s1", "left_semi"), cfg, **params)
    true = truth.join(ids, "s1", "left_semi")
    knobs = decide.tune(oof, true, ids, cfg.tune_sample) if cfg.method == "tune" else {"method": cfg.method, "thr": cfg.threshold, "alpha": cfg.alpha}
    report = {"knobs": knobs, "oof": metrics.macro_f05(decide.apply_decision(oof, knobs), true, ids).first().asDict()}
    t1, tp = records.load_split(spark, test_dir, "test")
    cand = candidates(norm(t1, "t1"), norm(tp, "tp"), cfg)
    done = staged(score(cand, models), cfg, "scored-test")
    sel = decide.apply_decision(done, knobs).join(done.select("s1", "p", "prob"), ["s1", "p"])
    records.write_tsv(records.id_lists(t1, sel, records.MATCHING_HEADER, "prob"), f"{out_dir}/matching_results")
    records.write_tsv(records.id_lists(t1, done, records.CANDIDATE_HEADER, "prob"), f"{out_dir}/candidate_pairs")
    report["countries"] = [r.asDict() for r in metrics.country_summary(sel, done, t1.select(F.col("entity_id").alias("s1"), "country")).orderBy("country").collect()]
    records.write_report(spark, report, f"{out_dir}/report")
    return report


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Match records of noisy sources to a clean one.")
    for name in ("--train-dir", "--test-dir", "--out-dir"):
        a.add_argument(name, required=True)
    a.add_argument("--work-dir", default="")
    a.add_argument("--train-sample", type=int, default=600_000)
    x = a.parse_args(argv)
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    print(match(spark, x.train_dir, x.test_dir, x.out_dir, Config.from_env(work_dir=x.work_dir, train_sample=x.train_sample)))


if __name__ == "__main__":
    main()
