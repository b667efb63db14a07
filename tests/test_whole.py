"""Queries without SQL against brute force on a small fixture of whole texts."""

import pytest

from kinweave.functions import fuzzy
from kinweave.plans.queries import QUERIES
from kinweave.sources import er_view

HEAD = "Blue Harbour Trading Company. " + "Old Mill Lane stands beside the quiet northern river bank. " * 4
TEXTS = [HEAD + "tail alpha 7001", HEAD + "tail omega 9002", HEAD + "tail alpha 7001", None, "", "\n\nno first line", "one line", "Ends. Here\nand there"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_record_view_keeps_whole_texts(spark, small):
    got = {r["code"] % 10**9: (r["name"], r["address"]) for r in er_view.records(spark, small).collect()}
    assert all(a + b == (TEXTS[i] or "") for i, (a, b) in got.items()) and len(got) == len(TEXTS)
    assert got[0][0] == "Blue Harbour Trading Company." and got[5][0] == "\n\nno first line" and got[6] == ("one line", "") and got[7][0] == "Ends."


def test_unicode_queries_read_whole_texts(spark, small):
    toks = {r["code"] % 10**9: r["toks"] for r in QUERIES["normalize_unicode"](spark, small).collect()}
    assert toks[1].endswith("tail omega 9002")
    assert {"omega", "alpha", "9002"} <= {r["token"] for r in QUERIES["romanized"](spark, small).collect()}


def test_fuzzy_reads_whole_texts(spark, small):
    """The two targets differ from the entity, or don't, only behind the 180th character."""
    got = {r["cand"] % 10**9: r["addr_token_set"] for r in QUERIES["fuzzy_features"](spark, small).where("s1 = 1000000000").collect()}
    words = lambda i: " ".join(sorted(set(TEXTS[i].split(". ", 1)[1].lower().replace(".", "").split())))
    assert got[2] == 1.0 and got[1] == round(fuzzy.token_set_ratio(words(0), words(1)), 6) < 1.0


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """One entity with 30 candidates, and 40 more entities of other words with one each."""
    path = tmp_path_factory.mktemp("wide")
    rows = [(3, "Shared alpha words. beta gamma", "en")] + [(3 * i + 1, f"Shared alpha words. beta gamma own{i}", "en") for i in range(30)]
    rows += [(300 + 3 * i + k, f"Firm x{i} y{i}. z{i}", "en") for i in range(40) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def candidates(spark, path):
    from kinweave.operators import blocking

    r = er_view.records(spark, path)
    return blocking.block(blocking.record_views(r)), er_view.true_links(r)


@pytest.mark.parametrize("name", ["fuzzy_features", "coherence_features", "joint_features"])
def test_features_of_all_candidates(spark, wide, name):
    got = [(r["s1"], r["cand"]) for r in QUERIES[name](spark, wide).collect()]
    assert sum(s1 == 1000000003 for s1, _ in got) == 30
    assert sorted(got) == sorted((r["s1"], r["cand"]) for r in candidates(spark, wide)[0].collect())


def test_demo_scores_both_halves(spark, wide):
    from kinweave.operators import models

    pairs, truth = candidates(spark, wide)
    got = [(r["s1"], r["cand"]) for r in models.demo(pairs, truth, trees=2, depth=2).collect()]
    assert sorted(got) == sorted((r["s1"], r["cand"]) for r in pairs.collect())
