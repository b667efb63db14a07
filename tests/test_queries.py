"""Every registered record query against its SQL, and the contract of the entry module."""

import pytest

from kinweave.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])


#: Without SQL; tests of values are in test_workflow.py and test_whole.py, those of models with small ones.
LEARNED = {"classifier_pairs", "out_of_fold_scores", "calibrated_scores", "trained_links", "refitted_links", "second_stage_scores", "expansion_links"}


@pytest.mark.parametrize("name", ["coherence_features", "joint_features", "fuzzy_features"])
def test_features_of_every_candidate(name, spark, sf_dir):
    want = {(r["s1"], r["cand"]) for r in QUERIES["block_union"](spark, sf_dir).collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert {(r["s1"], r["cand"]) for r in rows} == want and len(rows) == len(want)
    assert all(v is not None and v >= -1 for r in rows for v in r)


def test_bootstrap_interval(spark, sf_dir):
    r = QUERIES["bootstrap_interval"](spark, sf_dir).first()
    assert 0 <= r["low"] <= r["mean"] <= r["high"] <= 1


def test_rate_grid(spark, sf_dir):
    rows = QUERIES["rate_grid"](spark, sf_dir).collect()
    assert len(rows) == len({(r["country"], r["rate"]) for r in rows}) == 6 * len({r["country"] for r in rows}) and all(0 <= r["macro_f05"] <= 1 for r in rows)


def test_alias_bootstrap(spark, sf_dir):
    rows = QUERIES["alias_bootstrap"](spark, sf_dir).collect()
    assert len({r["variant"] for r in rows}) == len(rows) and {"la", "der", "inge"} <= {r["variant"] for r in rows}


def test_expansion_features(spark, sf_dir):
    want = {(r["s1"], r["cand"]) for r in QUERIES["key_expand"](spark, sf_dir).collect()}
    assert {(r["s1"], r["cand"]) for r in QUERIES["expansion_features"](spark, sf_dir).collect()} == want


def test_nothing_is_left_out():
    tested = {"coherence_features", "joint_features", "fuzzy_features", "bootstrap_interval", "rate_grid", "alias_bootstrap", "expansion_features", "best_k_decode"}
    assert set(QUERIES) - set(ORACLE) <= LEARNED | tested | {"normalize_unicode", "romanized", "em_prior"}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert e.entry(spark).columns[:3] == ["country", "s1", "cand"]


def test_core_imports_no_llm():
    from pathlib import Path

    for f in (Path(__file__).parent.parent / "kinweave").rglob("*.py"):
        if "llm" not in f.parts:
            assert "kinweave.llm" not in f.read_text() and "from kinweave import llm" not in f.read_text(), f
