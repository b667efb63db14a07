"""Decisions, metrics, models, sources and streams on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import aliases, decide, expand, features, metrics, models, validate
from kinweave.sources import tsv
from kinweave.streaming import incremental

PAIRS = "s1 long, cand long, p double"


def test_filter_before_assign_frees_the_runner_up(spark):
    p = spark.createDataFrame([(1, 3, 0.9, 0.95), (2, 3, 0.8, 0.5)], "s1 long, cand long, p double, t double")
    assert [tuple(r)[:2] for r in decide.assign(p, F.col("t")).collect()] == [(2, 3)]


def test_ties_go_to_the_least_entity(spark):
    p = spark.createDataFrame([(2, 9, 0.9), (1, 9, 0.9)], PAIRS)
    assert decide.assign(p, 0.5).first()["s1"] == 1


def brute(q, rate):
    n, miss = len(q), decide.poisson(rate)
    values = []
    for k in range(n + 1):
        v = 0.0
        for truth in itertools.product((0, 1), repeat=n):
            w = 1.0
            for x, y in zip(q, truth, strict=True):
                w *= x if y else 1 - x
            for m, pm in enumerate(miss):
                t, u = sum(truth[:k]), sum(truth[k:]) + m
                v += w * pm * ((1.0 if t + u == 0 else 0.0) if k == 0 else 1.25 * t / (0.25 * (t + u) + k))
        values.append(v)
    return values


@pytest.mark.parametrize("rate", [0, 0.1, 0.4])
def test_best_k(rate):
    r = random.Random(int(rate * 10))
    for _ in range(8):
        q = sorted((r.random() for _ in range(r.randint(1, 5))), reverse=True)
        k, v = decide.best_k(q, rate)
        values = brute(q, rate)
        assert abs(v - max(values)) < 1e-6 and abs(values[k] - max(values)) < 1e-9
    assert decide.best_k([0.1, 0.05], 0)[0] == 0 and decide.best_k([0.99, 0.97, 0.02], 0)[0] == 2


def test_lists_are_decoded_whole(spark):
    p = [(1, 100 + i, 0.99 - i / 1e4) for i in range(40)] + [(2, 200 + i, 0.9) for i in range(3)]
    got = decide.decode_expected(spark.createDataFrame(p, PAIRS), 0.1).collect()
    assert sum(r["s1"] == 1 for r in got) == 40 and sum(r["s1"] == 2 for r in got) == 3
    grid = decide.decode_grid(spark.createDataFrame(p, PAIRS), (0.0, 0.1)).collect()
    assert sum(r["s1"] == 1 and r["rate"] == 0.1 for r in grid) == 40


@pytest.mark.parametrize("rate", [0.35, 9.0, 400.0])
def test_all_unseen_links_count(rate):
    law = decide.poisson(rate)
    assert abs(law.sum() - 1) < 1e-9 and abs((law * range(len(law))).sum() - rate) < 1e-6
    assert decide.poisson(0).tolist() == [1] and decide.poisson([0, 0.5])[0, 0] == 1


def test_decode_is_one_to_one(spark):
    got = decide.decode_expected(spark.createDataFrame([(1, 9, 0.9), (2, 9, 0.95), (2, 8, 0.9)], PAIRS), 0.0).collect()
    assert {(r["s1"], r["cand"]) for r in got} == {(2, 9), (2, 8)}


def test_list_features(spark):
    p = spark.createDataFrame([(5, 2000000001, 0.2), (3, 3000000001, 0.9), (5, 3000000002, 0.8), (3, 2000000002, 0.4)], PAIRS)
    got = {(r["s1"], r["cand"]): r for r in features.list_features(p).collect()}
    assert got[3, 3000000001]["p1_rank"] == 0 and abs(got[3, 3000000001]["p1_gap"] - 0.5) < 1e-9
    assert all(r["best_in_source"] == 1 for r in got.values()) and got[5, 2000000001]["ent_n50"] == 1


def test_macro_f05_and_empty(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    links, truth = spark.createDataFrame([(1, 9)], "s1 long, cand long"), spark.createDataFrame([(1, 9), (2, 8)], "s1 long, cand long")
    assert abs(metrics.macro_f05(e, links, truth).first()["macro_f05"] - 2 / 3) < 1e-9
    assert metrics.macro_f05(e.limit(0), links, truth).first()["macro_f05"] == 0


def test_sweep_takes_the_first_of_equal(spark):
    e, truth = spark.createDataFrame([(1,)], "s1 long"), spark.createDataFrame([(1, 9)], "s1 long, cand long")
    best = metrics.best_threshold(metrics.sweep(spark.createDataFrame([(1, 9, 0.7)], PAIRS), e, truth)).first()
    assert best["threshold"] == 0.05 and best["macro_f05"] == 1.0


def test_bootstrap_repeats(spark):
    d = spark.range(200).select(F.col("id").alias("s1"), (F.col("id") % 3).cast("double").alias("delta"))
    a, b = metrics.bootstrap(d, resamples=50).first(), metrics.bootstrap(d, resamples=50).first()
    assert a == b and a["low"] <= a["mean"] <= a["high"]


def test_em_prior_falls_with_the_data(spark):
    p = spark.createDataFrame([(1, i, 0.9 if i % 10 == 0 else 0.05) for i in range(100)], PAIRS)
    assert metrics.em_prior(p, 0.5) < 0.2


def test_out_of_fold_scores_every_row_once(spark):
    r = random.Random(1)
    rows = [(e, t, (x := r.random()), int(x > 0.5)) for e in range(40) for t in range(3)]
    data = spark.createDataFrame(rows, "s1 long, cand long, x double, y int")
    got = models.out_of_fold(data.withColumnRenamed("x", "v"), ["v"], folds=2, trees=2, depth=2)
    assert got.count() == len(rows) and got.groupBy("s1").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_bundle_round_trip_and_guards(spark, tmp_path):
    data = spark.createDataFrame([(i, i, float(i % 2), i % 2, "en") for i in range(60)], "s1 long, cand long, v double, y int, country string")
    b = models.Bundle(models.fit(data, ["v"], trees=2, depth=2), ["v"], thresholds={"en": 0.5}, prefilter_digest="x")
    b.save(str(tmp_path / "b"))
    again = models.Bundle.load(str(tmp_path / "b"))
    assert again.thresholds == {"en": 0.5} and models.predict(again, data).count() == 30
    with pytest.raises(ValueError):
        models.score(b.model, data.drop("v"), ["v"])
    with pytest.raises(ValueError):
        models.check_prefilter(b, "y")


def test_ablation_and_projection(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "s1 long, cand long, a double")
    assert features.ablated(df, ["a"]).first()["a"] == 0.0
    with pytest.raises(ValueError):
        features.ablated(df, ["b"])
    with pytest.raises(ValueError):
        features.projected(df, ["b"])


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p_source1.tsv").write_text('entity_id\tname\taddress\tcountry\nS1-1\tA "b\tx\ten\textra\nS1-2\tB\n')
    got = {r["entity_id"]: r for r in tsv.read_source(spark, str(tmp_path / "p_source1.tsv")).collect()}
    assert got["S1-1"]["name"] == 'A "b' and got["S1-2"]["country"] == "" and got["S1-2"]["code"] == 1_000_000_002
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    links, entities = tsv.read_links(spark, str(tmp_path / "gt.tsv"))
    assert {tuple(r) for r in links.collect()} == {(1_000_000_001, 2_000_000_001), (1_000_000_001, 3_000_000_002)} and entities.count() == 2
    lists = {tuple(r) for r in tsv.matching_lists(entities, links).collect()}
    assert lists == {("S1-1", "S2-1,S3-2"), ("S1-2", "")}
    (tmp_path / "al.tsv").write_text("variant\tcanonical\tscore\tcount\nrd\troad\t1.00\t3\nrd\troute\t2.00\t4\n")
    assert [tuple(r)[:2] for r in tsv.read_aliases(spark, str(tmp_path / "al.tsv")).collect()] == [("rd", "route")]
    assert tsv.read_aliases(spark, "").count() == 0
    tsv.write_tsv(tsv.matching_lists(entities, links), str(tmp_path / "out"), 1)
    assert len(tsv.file_digest(spark, str(tmp_path / "gt.tsv"))) == 64


def test_expansion_finds_rare_and_skips_common(spark):
    v = "source int, country string, code long, core array<string>, skstr string, compact string"
    rows = [(1, "A", 1_000_000_001, ["blue", "oak"], "", "blueoak"), (2, "A", 2_000_000_001, ["blue", "oak"], "", "blueoak"), (1, "A", 1_000_000_002, ["star"], "", "star")]
    rows += [(2, "A", 2_000_000_100 + i, ["star"], "", "star") for i in range(25)]
    none = spark.createDataFrame([], "s1 long, cand long")
    got = expand.generate(spark.createDataFrame(rows, v), spark.createDataFrame([], "s1 long, member long, p double"), none).collect()
    assert [(r["s1"], r["cand"]) for r in got] == [(1_000_000_001, 2_000_000_001)]


def test_alias_merge_is_by_variant_and_canonical(spark):
    s = "variant string, canonical string"
    base, new = spark.createDataFrame([("a", "b")], s), spark.createDataFrame([("a", "z"), ("c", "a"), ("d", "e")], s)
    assert {tuple(r) for r in aliases.merge(base, new).collect()} == {("a", "b"), ("d", "e")}


def test_headers():
    want = ("source1_entity_id", "matched_entity_ids")
    assert validate.header_findings(None, want) == ["missing_file"] and validate.header_findings("", want) == ["empty_file"]
    assert validate.header_findings("a,b", want) == ["comma_separated"] and validate.header_findings("a\tb", want) == ["wrong_header"] and validate.header_findings("\t".join(want), want) == []


def test_stream_top_two(spark, tmp_path):
    rows = [(1, 9, 5.0), (2, 9, 7.0), (3, 9, 7.0), (1, 8, 1.0)]
    spark.createDataFrame(rows, "s1 long, cand long, score double").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s1 long, cand long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = incremental.run_to_memory(incremental.top_two(stream), "update").groupBy("cand").agg(F.max_by(F.struct("t_best", "t_second"), "t_claims").alias("v"), F.max("t_claims").alias("n")).collect()
    assert {r["cand"]: (r["v"][0], r["v"][1], r["n"]) for r in got} == {9: (7.0, 7.0, 3), 8: (1.0, 0.0, 1)}
