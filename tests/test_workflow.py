"""The learned workflow, tables between the steps, and plans, on small inputs."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import fuzzy, unicode
from kinweave.operators import blocking, decide, expand, metrics, models, workflow
from kinweave.plans.queries import QUERIES
from kinweave.sources import er_view
from kinweave.sources import pairs as pair_files

CODE = 1_000_000_000


@pytest.fixture(scope="module", autouse=True)
def small_models():
    """Plumbing is what is tested here, so models are small."""
    kept = models.TREES, models.DEPTH
    models.TREES, models.DEPTH = 3, 3
    yield
    models.TREES, models.DEPTH = kept


@pytest.fixture(scope="module")
def labelled(spark):
    """300 entities with five candidates each; y follows x1, and x2 is noise."""
    r = random.Random(3)
    rows = [("ab"[i % 2], CODE + i, 2 * CODE + 5 * i + j, float(y := int(j == 0 or r.random() < 0.1)) * 0.6 + r.random() * 0.5, r.random(), y) for i in range(300) for j in range(5)]
    return spark.createDataFrame(rows, "country string, s1 long, cand long, x1 double, x2 double, y int").persist()


@pytest.fixture(scope="module")
def world(labelled):
    entities = labelled.select("s1", "country").distinct()
    return labelled, entities, labelled.where("y = 1").select("s1", "cand")


def test_predict_rejects_wrong_prefilter_before_scoring(spark, world, tmp_path, monkeypatch):
    data, entities, truth = world
    bundle = models.train(data, entities, truth, ["x1", "x2"], context=["x1"])
    assert bundle.prefilter_digest == bundle.prefilter.digest() and bundle.prefilter_threshold > 0
    bundle.save(str(tmp_path / "b"))
    again = models.Bundle.load(str(tmp_path / "b"))
    assert again.prefilter.digest() == bundle.prefilter_digest and again.thresholds == bundle.thresholds
    monkeypatch.setattr(models, "score", lambda *a, **k: pytest.fail("scored"))
    with pytest.raises(ValueError, match="prefilter"):
        models.predict(again, data, manifest_digest="another")
    with pytest.raises(ValueError, match="prefilter"):
        workflow.refit(again, data, "another")


def test_prefilter_cuts_before_the_model(world):
    data, entities, truth = world
    bundle = models.train(data, entities, truth, ["x1", "x2"], context=["x1"])
    kept = models.prefiltered(data, bundle.prefilter)
    assert 0 < kept.count() < data.count()
    links = models.predict(bundle, data)
    assert links.count() == links.select("cand").distinct().count() > 0
    assert links.join(kept, ["s1", "cand"], "left_anti").count() == 0
    refitted = workflow.refit(bundle, data, bundle.prefilter_digest)
    assert refitted.thresholds == bundle.thresholds and refitted.prefilter_digest == bundle.prefilter_digest


def test_oof_never_scores_own_fold(world, monkeypatch):
    data, seen = world[0], []
    real = models.fit
    monkeypatch.setattr(models, "fit", lambda d, names, **k: (m := real(d, names, **k), seen.append((id(m), {r[0] for r in d.select("s1").distinct().collect()})))[0])
    scored = []
    real_score = models.score
    monkeypatch.setattr(models, "score", lambda m, d, names, *a: (scored.append((id(m), {r[0] for r in d.select("s1").distinct().collect()})), real_score(m, d, names, *a))[1])
    out = models.out_of_fold(data, ["x1", "x2"], folds=3)
    fitted = dict(seen)
    assert len(scored) == 3 and all(not fitted[m] & s for m, s in scored) and out.count() == data.count()


def test_rates_by_country_against_decoding_each(spark, world):
    data, entities, truth = world
    scored = data.select("country", "s1", "cand", F.least(F.col("x1"), F.lit(1.0)).alias("p"))
    got = {(r["country"], r["rate"]): r["macro_f05"] for r in metrics.rate_sweep(scored, entities, truth).collect()}
    for country, rate in itertools.product("ab", (0.0, 0.35)):
        own = entities.where(F.col("country") == country)
        links = decide.decode_expected(scored.join(own.select("s1"), "s1"), rate)
        assert got[country, rate] == pytest.approx(metrics.macro_f05(own, links.select("s1", "cand"), truth).first()["macro_f05"])
    best = {r["country"]: r["rate"] for r in metrics.best_rate(metrics.rate_sweep(scored, entities, truth)).collect()}
    assert all(got[c, best[c]] == pytest.approx(max(v for (k, _), v in got.items() if k == c), abs=1e-9) for c in "ab")


def test_audit(spark):
    scored = spark.createDataFrame([(1, 21, 0.9, True, 0), (1, 22, 0.8, False, 1), (2, 23, 0.7, True, 0), (3, 23, 0.6, True, 0)], "s1 long, cand long, p double, keep boolean, addr_empty_cand int")
    entities, truth = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s1 long"), spark.createDataFrame([(1, 21), (1, 22), (3, 23)], "s1 long, cand long")
    got = {r["variant"]: r.asDict() for r in workflow.audit(scored, 0.5, entities, truth).collect()}
    assert got["unfiltered"]["missed_links"] == 1 and got["unfiltered"]["false_links"] == 1 and got["unfiltered"]["false_singleton_merges"] == 1
    assert got["prefiltered"]["missed_links"] == 2 and got["unfiltered"]["empty_entities"] == 1 and got["unfiltered"]["empty_f05"] == 1.0
    assert got["prefiltered"]["empty_f05"] == pytest.approx(1.25 * 0.5 / (0.25 + 0.5))


def test_matrix_files(spark, world, tmp_path):
    data, entities, _ = world
    a, b = str(tmp_path / "a.npz"), str(tmp_path / "b.npz")
    pair_files.save_matrix(data, entities, ["x2", "x1"], a, "digest")
    assert pair_files.load_matrix(spark, a).columns == ["country", "s1", "cand", "y", "x2", "x1"] and pair_files.load_manifest(spark, a)[1] == {"names": ["x2", "x1"], "prefilter": "digest"}
    plan = pair_files.load_matrix(spark, a, features=False)._jdf.queryExecution().executedPlan().toString()
    assert "x1" not in plan and pair_files.folder_of("d/c.tsv", "scores") == pair_files.folder_of("d/c_scores/", "scores") == "d/c_scores"
    some = entities.where(F.col("s1") < CODE + 10)
    pair_files.save_matrix(data.where(F.col("s1") < CODE + 5).withColumn("x1", F.lit(9.0)), some, ["x2", "x1"], b)
    latest = pair_files.load_latest(spark, [a, b])
    assert latest.where("x1 = 9").count() == 25 and latest.where(F.col("s1").between(CODE + 5, CODE + 9)).count() == 0 and latest.count() == data.count() - 25
    pair_files.save_matrix(data.drop("x2"), entities, ["x2"], b)
    with pytest.raises(ValueError, match="x2"):
        pair_files.load_matrix(spark, b)
    first = pair_files.sampled(entities, 20, 1).collect()
    assert first == pair_files.sampled(entities.repartition(7), 20, 1).collect() and len(first) == 20


# ---- blocking


def brute_blocks(records, topk, name_topk, cap):
    """The candidate table from token sets, pair by pair; records: code -> (source, all tokens, name tokens)."""
    targets = {c: t for c, (s, *t) in records.items() if s > 1}
    df = [{}, {}]
    for t in targets.values():
        for d, toks in zip(df, t, strict=True):
            for x in toks:
                d[x] = d.get(x, 0) + 1
    w = [{x: np.log1p(len(targets) / n) ** 2 for x, n in d.items()} for d in df]
    out = {}
    for s1, (source, *mine) in records.items():
        if source > 1:
            continue
        rows = {}
        for cand, theirs in targets.items():
            both = [a & b for a, b in zip(mine, theirs, strict=True)]
            score = [round(sum(wi[x] for x in t), 6) for wi, t in zip(w, both, strict=True)]
            made = [any(d[x] <= cap for x in t) and (len(t) >= 2 or s >= 6) for d, t, s in zip(df, both, score, strict=True)]
            rows[cand] = (score, [len(t) for t in both], made)
        best = [sorted((c for c, r in rows.items() if r[2][k]), key=lambda c: (-rows[c][0][k], c))[:top] for k, top in ((0, topk), (1, name_topk))]
        table = sorted({*best[0], *best[1]}, key=lambda c: (-rows[c][0][0], -rows[c][0][1], c))
        for rank, c in enumerate(table):
            (score, nscore), (shared, nshared), _ = rows[c]
            out[s1, c] = (score, shared, rank, nscore, nshared, best[1].index(c) if c in best[1] else blocking.NO_RANK)
    return out


@pytest.mark.parametrize("cap", [200_000, 8, 3])
def test_block_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(blocking, "CHUNK", 5)
    r = random.Random(cap)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows = [((i % 3 + 1) * CODE + i, i % 3 + 1, "en", " ".join(r.choice(words[:12]) for _ in range(3)), " ".join(r.choice(words) for _ in range(6))) for i in range(90)]
    views = blocking.record_views(spark.createDataFrame(rows, "code long, source int, country string, name string, address string")).persist()
    all_, name = (blocking.channel_tokens(views, c) for c in ("all", "name"))
    toks = {x["code"]: [set(x["toks"])] for x in all_.collect()}
    for x in name.collect():
        toks[x["code"]].append(set(x["toks"]))
    records = {c: (c // CODE, *t) for c, t in toks.items()}
    want = brute_blocks(records, 6, 4, cap)
    got = {(x["s1"], x["cand"]): (x["score"], x["shared"], x["rank"], x["nscore"], x["nshared"], x["nrank"]) for x in blocking.block(views, 6, 4, gen_cap=cap, name_gen_cap=cap).collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k], abs=1e-5) for k, v in got.items())
    w = blocking.weighted(blocking.token_weights(all_), gen_cap=cap)
    one = {(x["s1"], x["cand"]) for x in blocking.channel_pairs(all_, w, 6).collect()}
    assert one == set(brute_blocks({c: (s, a, set()) for c, (s, a, _) in records.items()}, 6, 4, cap))


def test_plans(spark, sf_dir):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = blocking.channel_pairs(*(lambda c: (c, blocking.weighted(blocking.token_weights(c))))(blocking.channel_tokens(blocking.record_views(spark.createDataFrame([], "code long, source int, country string, name string, address string")), "all")), 50, common=False)
    assert "WindowGroupLimit" in plan(top)
    leaves = blocking.block(blocking.record_views(er_view.records(spark, sf_dir)))._jdf.queryExecution().sparkPlan().collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    assert kinds == {"InMemoryTableScanExec"}  # the tokens are read from the files once, for what is kept


# ---- learned queries


def keys(df):
    return {(r["s1"], r["cand"]) for r in df.select("s1", "cand").collect()}


@pytest.fixture(scope="module")
def firms(spark, tmp_path_factory):
    """Forty firms with a record in each source; most targets have the entity's name, the others a changed one."""
    r = random.Random(9)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = []
    for i in range(40):
        name, street = r.sample(words, 3), r.sample(words, 3)
        for k in range(3):
            own = list(name) if k == 0 or r.random() < 0.7 else [name[0], r.choice(words), name[2]]
            rows.append((3 * i + k, f"{' '.join(own)}. {r.randint(1, 30)} {' '.join(street)}", "ab"[i % 2]))
    path = tmp_path_factory.mktemp("firms")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["classifier_pairs", "out_of_fold_scores", "calibrated_scores", "second_stage_scores"])
def test_every_pair_is_scored(name, spark, firms):
    df, table = QUERIES[name](spark, firms).persist(), keys(QUERIES["block_union"](spark, firms))
    assert keys(df) == table and df.count() == len(table) > 100
    for c in {"p", "q", "p1"} & set(df.columns):
        assert df.where(~F.col(c).between(0, 1) | F.col(c).isNull()).count() == 0


@pytest.mark.parametrize("name", ["trained_links", "refitted_links", "expansion_links", "best_k_decode"])
def test_links_are_one_to_one(name, spark, firms):
    rows, table = QUERIES[name](spark, firms).collect(), keys(QUERIES["block_union"](spark, firms))
    assert len({r["cand"] for r in rows}) == len(rows) > 0
    assert {(r["s1"], r["cand"]) for r in rows if "new" not in r or not r["new"]} <= table


def test_second_stage_decides(spark, firms):
    """Both methods give one-to-one links, and an unseen country the cautious parameters."""
    from kinweave.plans import queries

    data, v = queries._oof(spark, firms)
    second = workflow.train_second(data, v, queries._entities(spark, firms), queries._truth(spark, firms), queries._BASE_FEATURES)
    first = models.Bundle(models.fit(data, queries._BASE_FEATURES), queries._BASE_FEATURES)
    assert set(second.thresholds) <= {"a", "b"} and second.default_threshold == max(second.thresholds.values()) and second.default_rate == min(second.rates.values())
    assert (second.method == "size") == (second.report["size_b"] > second.report["threshold_b"])
    for method in ("threshold", "size"):
        links, _ = workflow.predict_second(first, second, data.drop("p"), v, method=method)
        assert links.count() == links.select("cand").distinct().count()
    with pytest.raises(ValueError, match="prefilter"):
        workflow.predict_second(models.Bundle(first.model, first.features, prefilter_digest="x"), second, data, v, manifest_digest="y")


def test_decoding_list_by_list(spark, firms):
    pairs = QUERIES["block_union"](spark, firms).toPandas()
    pairs["p"] = (pairs["score"] / (pairs["score"] + 50)).round(6)
    chosen = {}
    for s1, own in pairs.groupby("s1"):
        own = own.sort_values(["p", "cand"], ascending=[False, True]).head(decide.MAX_DECODE)
        q = own["p"].tolist()
        if q[0] >= decide.LEAST_TOP:
            for c, p in list(zip(own["cand"], q, strict=True))[: decide.best_k(q, 0.1)[0]]:
                if c not in chosen or (-p, s1) < chosen[c]:
                    chosen[c] = (-p, s1)
    got = {r["cand"]: (-r["p"], r["s1"]) for r in QUERIES["best_k_decode"](spark, firms).collect()}
    assert got == chosen


def test_bootstrap_of_plain_weights(spark):
    d = spark.createDataFrame([(i, float(i % 7) / 7) for i in range(200)], "s1 long, delta double")
    got = metrics.bootstrap(d, resamples=300).first()
    rng, x = np.random.default_rng(0), np.array([i % 7 / 7 for i in range(200)])
    w = rng.poisson(1, (300, 200))
    low, high = np.quantile((w * x).sum(axis=1) / w.sum(axis=1), [0.025, 0.975])
    assert got["mean"] == pytest.approx(x.mean()) and abs(got["low"] - low) < 0.02 and abs(got["high"] - high) < 0.02


def test_expansion_without_anything_new(spark):
    views = blocking.record_views(spark.createDataFrame([(CODE, 1, "a", "alpha beta", ""), (2 * CODE, 2, "a", "gamma delta", "")], "code long, source int, country string, name string, address string"))
    scored = spark.createDataFrame([(CODE, 2 * CODE, 0.9)], "s1 long, cand long, p double")
    assert expand.generate(views, scored.select("s1", F.col("cand").alias("member"), "p"), scored).count() == 0
    entities = spark.createDataFrame([(CODE, "a")], "s1 long, country string")
    assert workflow.train_expansion(scored, views, entities, scored.select("s1", "cand")) is None


# ---- text


def test_windows_against_every_window():
    r = random.Random(4)

    def plain(a, b):
        if not a or not b:
            return float(a == b)
        a, b = sorted((a, b), key=len)
        best = lambda s, x: max(fuzzy.ratio(s, x[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(x)))
        return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)

    text = lambda n: "".join(r.choice("abcdé😀") for _ in range(r.randint(0, n)))
    cases = [(text(25), text(40)) for _ in range(1500)] + [("", ""), ("", "a"), ("ab", "ab")]
    assert np.allclose(fuzzy.partial_ratios(cases), [plain(*c) for c in cases], atol=1e-12)


def test_accents_of_ascii_letters_go():
    r = random.Random(5)
    pool = list("aEzé1") + [chr(c) for c in (0x301, 0x327, 0x947, 0x94D, 0x3B1, 0x1E69, 0xFB01)]
    for _ in range(3000):
        s, out, latin = "".join(r.choice(pool) for _ in range(9)), "", False
        for c in unicodedata.normalize("NFKD", s):
            if unicodedata.combining(c) == 0:
                latin = "a" <= c.lower() <= "z" and c.isascii()
            if unicodedata.combining(c) == 0 or not latin:
                out += c
        assert unicode.strip_accents(s) == out


@pytest.mark.parametrize(("token", "roman"), [("शिव", "shiva"), ("प्रोडक्ट्स", "proddakttsa"), ("१२", "12"), ("राम", "raama"), ("abc", "abc"), ("क‍ि", "kai"), ("ಕನ್ನಡ", "kannadda")])
def test_romanize(token, roman):
    assert unicode.romanize(token) == roman
