"""Golden cases of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import fuzzy, text
from kinweave.operators import features


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names)).select(expr).first()[0]


def test_skeleton(spark):
    assert one(spark, text.skeleton(F.col("a")), a="praaivett") == "prvt"


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 0), ("a", "a", 1), ("a", "", 2), ("a", "b", 3)])
def test_state(spark, a, b, want):
    assert one(spark, features.state4(F.col("a"), F.col("b")), a=a, b=b) == want


def test_set_comparison(spark):
    jac, conf = features.jaccard(F.col("a"), F.col("b")), features.conflict(F.col("a"), F.col("b"))
    assert one(spark, jac, a="a b", b="b c") == pytest.approx(1 / 3)
    assert one(spark, conf, a="a b", b="b c") == 0
    assert one(spark, jac, a="", b="b") == -1
    assert one(spark, conf, a="", b="b") == 0
    assert one(spark, conf, a="a", b="b") == 1


def test_name(spark):
    d = spark.createDataFrame([("L'Été & Fils dba Foo Svcs. Pvt Ltd (India)",), ("www.foo-bar.com",), ("#tag 007",), (None,), ("The A",)], "business_name string")
    r = [x.asDict() for x in text.normalize_name(d).collect()]
    assert r[0]["legal"] == "PVT" and "foo services" in r[0]["name_core"]
    assert "lete" in r[0]["name_vars"].split("|")[0]
    assert r[1]["name_core"] == "foobar" and r[1]["is_web"] == 1
    assert r[2]["is_web"] == 1 and r[2]["name_nums"] == "7"
    assert r[3]["name_norm"] == "" and r[3]["acronym"] == ""
    assert r[4]["name_core"] == "the a"  # nothing is left, so the whole name stands


def test_address(spark):
    d = spark.createDataFrame([("N° 12, 10ST Street, near City Mall, Tyler, TX 75701-1234",), ("007 Premier Rd, Fl, Opp Bank, Mumbai, MH, 400001",), ("",), (None,)], "business_address string")
    r = [x.asDict() for x in text.normalize_address(d).collect()]
    assert (r[0]["postcode"], r[0]["primary_num"], r[0]["landmark"], r[0]["city_guess"]) == ("75701", "12", "city mall", "tyler")
    assert r[0]["addr_comps"].split("|")[1] == "10 st"
    assert r[1]["postcode"] == "400001" and r[1]["house_nums"] == "7 1" and "maharashtra" in r[1]["addr_norm"]
    assert r[2]["addr_empty"] == 1 and r[3]["addr_norm"] == ""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(0, 90))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
    assert fuzzy.ratio_of("kitten", "sitting") == pytest.approx(61.538, abs=1e-3)


def test_fuzzy_golden():
    assert fuzzy.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert fuzzy.token_set_of("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_of("", "a") == 0
    assert fuzzy.token_sort_of("a b c", "c b a") == 100
    assert fuzzy.partial_of("test", "this is a test!") == 100
    assert fuzzy.partial_of("", "a") == 0
    assert fuzzy.phonetic_of("knight 42 thompson") == "NT 42 0MPSN"
    assert fuzzy.transliterate_of("Crème Brûlée") == "Creme Brulee"
    assert fuzzy.transliterate_of("राम").startswith("raam")
