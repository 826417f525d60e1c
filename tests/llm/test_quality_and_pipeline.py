"""Operator 6 by held-out accuracy and against plain formulas; the pipeline's stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import compact, quality, secrets, simhash

from .helpers import awkward, by_id, empty, prose


def labelled(spark, n=240):
    rows = [(i, prose(i, 80) if i % 3 else prose(i, 40).replace(" ", "### ") + "$$$", "en", "a", 0) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    d, l = labelled(spark)
    model = quality.train(d, l)
    rows = quality.score(d, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    odd = awkward(spark)
    assert quality.score(odd, model).count() == odd.count()
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert quality.score(empty(spark), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    d, l = labelled(spark)
    flipped = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["quality"], 0) for r in l.collect()], "doc_id long, quality int, toxic int")
    a, b = quality.train(d, l), quality.train(d, flipped)
    assert np.allclose(a.product, b.product) and (a.slope, a.offset) == (b.slope, b.offset)


def test_without_labels(spark):
    d, l = labelled(spark, 30)
    for some in (l.limit(0), l.filter("quality = 1"), l.selectExpr("doc_id", "cast(null as int) quality", "toxic")):
        s = {r["score"] for r in quality.score(d, quality.train(d, some)).collect()}
        assert len(s) == 1 and 0 < s.pop() < 1


def test_features_are_indicators():
    doc, f = quality.features([b"ab ab ab", b"", b"abcd"], 18)
    assert set(doc) == {0, 2}
    alone, g = quality.features([b"abcd"], 18)
    assert set(f[doc == 2]) == set(g)  # neighbours in a slice do not matter
    assert len(f[doc == 0]) == len(set(f[doc == 0])) == 5  # "ab ", "b a", " ab", the word and its pair


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, epochs=2000)
    cost = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w[:5] + w[5])).sum()
    best = cost(w)
    for _ in range(300):
        assert cost(w + rng.standard_normal(6) * 0.02) >= best - 1e-2


def test_pipeline_stages(spark, tmp_path):
    d, l = labelled(spark)
    passage = prose(9000, 70)
    more = spark.createDataFrame([(1000 + i, prose(1000 + i, 80) + " " + passage, "en", "b", 0) for i in range(3)] + [(1100, prose(1, 80), "en", "b", 0), (1200, prose(1200, 70) + ' token = "a9Zk20xLmQ77" ' + prose(1201, 20), "en", "b", 0)], d.schema)
    d.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    l.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    good = {i for i in range(240) if i % 3} | {1000, 1001, 1002, 1100, 1200}
    assert set(by_id(seen["quality"])) == good
    assert set(by_id(seen["simhash"])) == good - {1100}
    text = {i: r["text"] for i, r in by_id(seen["passages"]).items()}
    assert set(text) == good - {1100} and sum(passage in t for t in text.values()) == 1
    assert "a9Zk20xLmQ77" not in by_id(seen["secrets"])[1200]["text"]
    assert {r["doc_id"] for r in seen["packing"].collect()} == good - {1100}
    assert seen["packing"].agg({"length": "sum"}).first()[0] == corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [simhash.keep_one, compact.drop_repeats, secrets.redact_documents])
def test_stages_take_empty_tables(spark, stage):
    assert stage(empty(spark)).count() == 0


@pytest.mark.parametrize("stage", [simhash.keep_one, compact.drop_repeats])
def test_columns_named_like_our_own(spark, stage):
    names = ["__fp", "own_fp", "best_fp", "best_id", "__doc", "__removed", "doc", "h1", "h2", "gone"]
    d = awkward(spark).select("doc_id", "text", *[F.col("n_chars").alias(n) for n in names])
    out = stage(d)
    want = {r["n_chars"] for r in stage(awkward(spark).select("doc_id", "text", "fp")).select(F.substring("fp", 2, 9).cast("long").alias("n_chars")).collect()}
    assert out.columns == d.columns
    assert {r["gone"] for r in out.collect()} == want and all(len({r[n] for n in names}) == 1 for r in out.collect())
