"""Text functions on literals, beside their Unicode forms."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import fuzzy, text, unicode


def value(spark, column, **cells):
    schema = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


def test_normalize(spark):
    n = text.normalize(F.col("x"))
    assert value(spark, n, x="  Ünïcode-Text, No.1 ") == "unicode text no 1"
    assert value(spark, n, x="") == "" and value(spark, n, x=None) == ""
    assert value(spark, text.tokens(F.col("x")), x="Null & Sons N/A unknown") == ["sons", "a"]


def test_markers_leet_suffixes(spark):
    t = text.name_tokens(F.col("x"))
    assert value(spark, t, x="Fake D/B/A: 8rands visi0n.com @home 17337") == ["fake", "brands", "vision", "home", "17337"]
    assert value(spark, t, x="née Kaffee formerly known as Tea") == ["kaffee", "tea"] or value(spark, t, x="nee Kaffee") == ["kaffee"]
    assert value(spark, text.core_tokens(t), x="The Blue Oak Ltd") == ["blue", "oak"]


def test_numbers(spark):
    n = F.array_sort(text.numeric_tokens(text.tokens(F.col("x"))))
    assert value(spark, n, x="17337 main 0669 12 000") == sorted({"17337", "7337", "669", "12", "0"})


def test_skeleton_and_keys(spark):
    s = text.skeleton(F.col("x"))
    assert value(spark, s, x="products") == "prtkts" and value(spark, s, x="shiva") == "sp"
    keys = set(value(spark, text.name_keys(text.name_tokens(F.col("x"))), x="Blue Oak Ltd"))
    assert {"blue", "oak", "ltd", "#blueoak", "#blueoakltd", "#oakblue", "~pl", "~k", "~lt"} - keys <= {"~k"}
    assert "#securecloud" in value(spark, text.name_keys(text.name_tokens(F.col("x"))), x="securecloudcom")
    assert value(spark, text.name_keys(text.name_tokens(F.col("x"))), x="") == []


def test_grams_and_sets(spark):
    assert value(spark, text.char_ngrams(F.col("x")), x="ab") == ["ab"]
    assert value(spark, text.char_ngrams(F.col("x")), x="") == []
    assert sorted(value(spark, text.char_ngrams(F.col("x")), x="a bcd")) == ["abc", "bcd"]
    a, b = F.split("x", ","), F.split("y", ",")
    assert value(spark, text.jaccard(a, b), x="1,2,3", y="2,3,4") == 0.5
    assert value(spark, text.containment(a, b), x="1,2,3", y="2,3") == 1.0


def test_ids(spark):
    code = text.encode_id(F.col("x"))
    assert value(spark, code, x="S2-17") == 2_000_000_017 and value(spark, text.decode_id(code), x="S3-999999999") == "S3-999999999"


def test_unicode_forms(spark):
    assert unicode.normalize_text("Brándś Ltd") == "brands ltd"
    assert unicode.romanize("शिव") == "shiva" and unicode.romanize("abc") == "abc"
    a, b = (value(spark, text.skeleton(F.lit(t))) if False else t for t in (unicode.romanize("प्रोडक्ट्स"), "products"))
    assert value(spark, text.skeleton(F.col("x")), x=a) == value(spark, text.skeleton(F.col("x")), x=b) == "prtkts"
    df = spark.createDataFrame([("Straße Ä",), ("शिव प्रोडक्ट्स",), (None,)], "x string")
    got = {r["x"]: r["n"] for r in unicode.with_normalized(df, "x", "n").collect()}
    assert got["Straße Ä"] == "straße a" and got[None] == "" and " " in got["शिव प्रोडक्ट्स"]


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abxd") == 0.75 and fuzzy.ratio("", "") == 1.0
    assert fuzzy.token_set_ratio("blue oak", "oak blue ltd") == 1.0 and fuzzy.token_set_ratio("", "a") == 0.0
    assert fuzzy.partial_ratio("oak", "blue oak ltd") == 1.0


@pytest.mark.parametrize("seed", range(3))
def test_lcs_brute_force(seed):
    import random

    r = random.Random(seed)
    for _ in range(50):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert fuzzy.lcs(a, b) == d[-1][-1]
