"""Files in and out: scans, sinks, caches, the validator, and the whole plan on a small split."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import validate
from kinweave.plans import pipeline
from kinweave.plans.config import Config
from kinweave.sources import records


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def required(spark):
    return spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")


CASES = [
    (["source1_entity_id,matched_entity_ids", "S1-1,S2-1"], "comma-separated header"),
    (["a\tb", "S1-1\tS2-1"], "unexpected header"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1", "S1-1\t", "S1-2\t"], "row without a tab"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\t", "S1-1\t", "S1-2\t"], "duplicate row"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S2-1", "S1-2\t"], "repeated id in a list"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\tS1-2", "S1-2\t"], "self-match"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\tX-2", "S1-2\t"], "wrong prefix"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-9", "S1-2\t"], "unknown id"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\t"], "required entity missing"),
    (["source1_entity_id\tmatched_entity_ids", "S1-1\t", "S1-2\t", "S1-3\t"], "unexpected entity"),
]


@pytest.mark.parametrize(("lines", "rule"), CASES, ids=[r for _, r in CASES])
def test_validator(spark, tmp_path, required, lines, rule):
    path = write(tmp_path / "m.tsv", *lines)
    valid = spark.createDataFrame([("S2-1",)], "p string")
    issues = validate.validate(spark, path, None, required, valid)
    assert [r["rule"] for r in issues.collect()] == [f"matched: {rule}"]
    assert validate.exit_code(issues) == 1


def test_validator_passes_and_warns(spark, tmp_path, required):
    m = write(tmp_path / "m.tsv", "source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1", "", "S1-2\t")
    c = write(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids", "S1-1\tS2-2", "S1-2\t")
    issues = validate.validate(spark, m, c, required)
    assert validate.exit_code(issues) == 0
    assert "matched outside candidates" in {r["rule"] for r in issues.collect()}
    assert validate.exit_code(validate.validate(spark, str(tmp_path / "none.tsv"), None, required)) == 1


def test_scan_and_sink(spark, tmp_path):
    path = write(tmp_path / "test_source1.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry", 'S1-1\t"Foo" \'s\t\tUS', "S1-2\tNA\tx\tUS")
    d = records.read_tsv(spark, path, records.RECORD_COLUMNS)
    assert [r["business_name"] for r in d.orderBy("entity_id").collect()] == ['"Foo" \'s', "NA"]
    assert d.filter("business_address is null").count() == 0
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-1", "S3-2")], "s1 string, p string")
    records.write_tsv(records.id_lists(d, pairs, records.MATCHING_HEADER), str(tmp_path / "out"))
    back = {r["source1_entity_id"]: r["matched_entity_ids"] for r in records.read_tsv(spark, str(tmp_path / "out"), records.MATCHING_HEADER).collect()}
    assert back == {"S1-1": "S2-1,S3-2", "S1-2": ""}


def test_cache(spark, tmp_path):
    made = []

    def build(d):
        made.append(1)
        return d.withColumn("y", d["x"] + 1)

    a = spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        assert records.cached(spark, str(tmp_path / "c"), a, build).count() == 2
    assert len(made) == 1
    records.cached(spark, str(tmp_path / "c"), a.filter("x = 1"), build)
    assert len(made) == 2


def split(folder, name, seed):
    rng = random.Random(seed)
    words, streets = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "zeta", "theta"], ["oak", "elm", "main", "lake", "hill"]
    rows = {1: [], 2: [], 3: []}
    truth = []
    for i in range(60):
        w, n = rng.sample(words, 3), rng.randint(1, 999)
        addr = f"{n} {rng.choice(streets)} street, springfield, {10000 + i}"
        rows[1].append((f"S1-{i}", " ".join(w) + " Inc", addr, "US"))
        ids = []
        for s in (2, 3):
            if rng.random() < 0.8:
                ids.append(f"S{s}-{i}")
                rows[s].append((f"S{s}-{i}", " ".join(w[: rng.randint(2, 3)]), addr.replace("street", "st"), "US"))
            rows[s].append((f"S{s}-x{i}", " ".join(rng.sample(words, 2)), f"{rng.randint(1, 999)} {rng.choice(streets)} road, shelbyville", "US"))
        truth.append((f"S1-{i}", ",".join(ids)))
    for s, r in rows.items():
        write(folder / f"{name}_source{s}.tsv", "\t".join(records.RECORD_COLUMNS), *["\t".join(x) for x in r])
    write(folder / f"{name}_ground_truth.tsv", "\t".join(records.MATCHING_HEADER), *["\t".join(x) for x in truth])
    return dict(truth)


def test_whole_plan(spark, tmp_path):
    split(tmp_path, "train", 1)
    truth = split(tmp_path, "test", 2)
    cfg = Config(work_dir=str(tmp_path / "work"), folds=2, threshold=0.5, k_passes={"w": 3, "c": 3, "e1": 3})
    report = pipeline.match(spark, str(tmp_path), str(tmp_path), str(tmp_path / "out"), cfg, maxIter=5, maxDepth=3, minInstancesPerNode=2)
    assert report["oof"]["overall"] > 0.8
    got = {r[0]: set(filter(None, r[1].split(","))) for r in records.read_tsv(spark, str(tmp_path / "out/matching_results"), records.MATCHING_HEADER).collect()}
    want = {k: set(filter(None, v.split(","))) for k, v in truth.items()}
    assert set(got) == set(want)
    hit = sum(len(got[k] & want[k]) for k in want)
    assert hit / sum(map(len, want.values())) > 0.7
    s1, pool = records.load_split(spark, str(tmp_path), "test")
    ids = s1.select(F.col("entity_id").alias("s1"))
    out = [str(tmp_path / "out" / n) for n in ("matching_results", "candidate_pairs")]
    assert validate.validate(spark, *out, ids, pool.select(F.col("entity_id").alias("p"))).count() == 0
    assert validate.main(["--matching", out[0], "--candidate", out[1], "--data-dir", str(tmp_path), "--check-ids"]) == 0
    read = lambda n, h: validate.read_lists(spark, str(tmp_path / f"out/{n}"), h, n)[0]
    assert report["countries"][0]["n_s1"] == 60


def test_a_header_in_each_part(spark, tmp_path, required):
    parts = tmp_path / "parts"
    parts.mkdir()
    for n, row in enumerate(("S1-1\tS2-1", "S1-2\t")):
        write(parts / f"part-{n}.csv", "source1_entity_id\tmatched_entity_ids", row)
    valid = spark.createDataFrame([("S2-1",)], "p string")
    assert validate.validate(spark, str(parts), None, required, valid).count() == 0
    write(parts / "part-2.csv", "a\tb")
    assert [r["rule"] for r in validate.validate(spark, str(parts), None, required, valid).collect()] == ["matched: unexpected header"]


def test_metric_is_over_the_sample(spark, tmp_path):
    split(tmp_path, "train", 1)
    split(tmp_path, "test", 2)
    base = dict(folds=2, k_passes={"w": 3, "c": 3, "e1": 3}, train_sample=20)
    fit = dict(maxIter=3, maxDepth=3, minInstancesPerNode=2)
    report = pipeline.match(spark, str(tmp_path), str(tmp_path), str(tmp_path / "out"), Config(work_dir=str(tmp_path / "work"), method="tune", **base), **fit)
    assert report["oof"]["overall"] > 0.6  # a third of the entities; over all of them it could not pass 0.4
    assert "f05" in report["knobs"]
