"""Pairs of records compared within blocks: values, counts and ratios by brute force, and what the plans exchange."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import fuzzy
from kinweave.operators import blocking, features

CODE = 1_000_000_000


@pytest.fixture(scope="module")
def records(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "12", "0450", "delta7", "inc", "söder", "la"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.choice(n)))
    rows = [((i % 3 + 1) * CODE + i, i % 3 + 1, "en" if i % 5 else "de", text([0, 1, 3]), text([0, 2, 6])) for i in range(90)]
    rows += [(2 * CODE + 1, 2, "en", "alpha twice", "beta 12")]  # two records of one id
    return spark.createDataFrame(rows, "code long, source int, country string, name string, address string")


@pytest.fixture
def views(records, monkeypatch):
    monkeypatch.setattr(features, "CHUNK", 7)  # several blocks on both sides
    return blocking.record_views(records)


def pairs_of(records):
    a, b = (records.where(c).select("country", F.col("code").alias(n)).distinct() for c, n in (("source = 1", "s1"), ("source > 1", "cand")))
    return a.join(b, "country").where("(s1 + cand) % 3 < 2").select("country", "s1", "cand")


def test_brute_force(records, views):
    pairs = pairs_of(records)
    got = features.compared(pairs, views, ("atok", "atri"), ("name", "core"), (("likeness", "nstr", "token_set"),)).collect()
    known = {}
    for v in views.collect():
        known.setdefault(v["code"], []).append(v)
    want = []
    for p in pairs.collect():
        for a in known[p["s1"]]:
            for b in known[p["cand"]]:
                sets = [n for c in ("atok", "atri") for n in (len(a[c]), len(b[c]), len(set(a[c]) & set(b[c])))]
                want.append((p["country"], p["s1"], p["cand"], *sets, a["name"], b["name"], a["core"], b["core"], fuzzy.token_set_ratio(a["nstr"], b["nstr"])))
    assert len(want) > 500 and sorted(map(repr, want)) == sorted(map(repr, map(tuple, got)))


def test_pairs_without_country(records, views):
    pairs = pairs_of(records)
    rows = lambda df: sorted(map(repr, map(tuple, df.select("s1", "cand", "n_atok").collect())))
    assert rows(features.compared(pairs, views, ("atok",))) == rows(features.compared(pairs.drop("country"), views, ("atok",)))


def test_no_pair_carries_views(records, views):
    """The views of two records meet in a task; no join or exchange has them once for each pair."""
    pairs = pairs_of(records).localCheckpoint()
    for out in (features.text_sets(pairs, views), features.text_sets(pairs, views, fuzzy_too=True), features.text_fuzzy(pairs, views), features.ambiguity(pairs, views, features.name_counts(views))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "a_atok" not in plan and "a_astr" not in plan and "a_atri" not in plan and "FlatMapGroupsInArrow" in plan


def test_no_records_and_no_pairs(records, views):
    pairs = pairs_of(records)
    assert features.text_sets(pairs.limit(0), views).count() == 0 and features.text_sets(pairs, views.limit(0)).count() == 0


def test_candidates_of_many_blocks(records, monkeypatch):
    """Packed blocks of a few records give the candidates that one block gives, tokens over their caps included."""
    views = blocking.record_views(records.where("code != 2000000001"))
    rows = lambda **caps: sorted(map(repr, map(tuple, blocking.block(views, topk=4, name_topk=3, **caps).collect())))
    one = [rows(), rows(gen_cap=12, name_gen_cap=5), rows(df_cap=9)]
    monkeypatch.setattr(blocking, "CHUNK", 6)
    assert one[0] and [rows(), rows(gen_cap=12, name_gen_cap=5), rows(df_cap=9)] == one


def test_weights_come_once_for_a_block(records):
    """No row of an entity's token is collected again, and blocks go to their tasks packed."""
    plan = blocking.block(blocking.record_views(records))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "payload" in plan


def test_supporters_are_compared_in_blocks(records, monkeypatch):
    """Support is that of one block, country or not, and the likeness of two records comes from packed blocks."""
    views = blocking.record_views(records.where("code != 2000000001"))
    scored = blocking.block(views, topk=6, name_topk=3).withColumn("p", F.round(F.col("score") / (F.col("score") + 3), 6)).localCheckpoint()
    rows = lambda s: sorted(repr([round(x, 9) for x in r]) for r in features.coherence(s, views).collect())
    one = rows(scored)
    monkeypatch.setattr(features, "CHUNK", 6)
    assert any(r["coh_n_strong"] > 0 for r in features.coherence(scored, views).collect())
    assert rows(scored) == one == rows(scored.drop("country"))
    assert "payload" in features.coherence(scored, views)._jdf.queryExecution().optimizedPlan().toString()


def test_name_counts_of_records_in_blocks(records, views):
    """Each record has the count of its own name, with two records of one id too, and no compared pair is joined again."""
    from math import log1p

    pairs = pairs_of(records)
    known, times = {}, {}
    for v in views.collect():
        name = " ".join(sorted(set(v["core"])))
        known.setdefault(v["code"], []).append((v, name))
        if v["source"] == 1 and name:
            times[v["country"], name] = times.get((v["country"], name), 0) + 1
    want = []
    for p in pairs.collect():
        for a, x in known[p["s1"]]:
            for b, y in known[p["cand"]]:
                na, nb = times.get((a["country"], x), 0), times.get((b["country"], y), 0)
                alpha = [set(v["atok"]) - set(v["num"]) for v in (a, b)]
                apart = float(bool(alpha[0]) and bool(alpha[1]) and not alpha[0] & alpha[1])
                want.append((p["s1"], p["cand"], round(log1p(na), 9), round(log1p(nb), 9), len(a["num"]), len(set(b["num"]) - set(a["num"])), apart))
    out = features.ambiguity(pairs, views, features.name_counts(views))
    columns = ["s1", "cand", "s1_core_name_frequency", "cand_core_name_frequency", "addr_numbers_s1", "addr_numbers_unshared_cand", "addr_alpha_disjoint"]
    got = [(r[0], r[1], round(r[2], 9), round(r[3], 9), *r[4:]) for r in out.select(columns).collect()]
    assert any(w[3] > 0 for w in want) and any(w[-1] for w in want) and sorted(got) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_stored_candidates_leave_nothing_behind(spark, sf_dir):
    """Once the candidate table is written, neither the tokens that it is made of nor their shuffle files are kept."""
    import gc
    import time

    from kinweave.plans import queries

    there = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    gc.collect()
    files, tables = there(), kept()
    queries.clear_tables()
    rows = queries.QUERIES["block_union"](spark, sf_dir).count()
    ends = time.time() + 30
    while (left := sorted(f for f in there() - files if f.startswith("shuffle") and f.endswith(".data"))) and time.time() < ends:
        time.sleep(0.5)
        spark._jvm.System.gc()
    assert rows and len(kept() - tables) <= 1 and not left


def test_memory_of_a_channel():
    """A block's postings take a few numbers for a token at a time, and are those of each token in order."""
    import tracemalloc

    import numpy as np

    from kinweave.functions import overlap

    r = np.random.default_rng(5)
    rows, size, words = 4000, 250, 3000
    tokens = np.sort(r.integers(0, 1 << 60, words))
    theirs = np.concatenate([r.choice(tokens, size, replace=False) for _ in range(rows)])
    mine = np.concatenate([r.choice(tokens, 500, replace=False) for _ in range(40)])
    tracemalloc.start()
    c = overlap.Channel((np.arange(41) * 500, mine), np.ones(len(mine)), (np.arange(rows + 1) * size, theirs), np.arange(rows))
    most = tracemalloc.get_traced_memory()[1] - sum(m.nbytes for m in c.matrices.values())
    tracemalloc.stop()
    assert most < 24 * len(theirs)
    sums, _ = c.sums(0, 3)
    assert [list(x) for x in sums] == [[len(np.intersect1d(mine[i * 500 : i * 500 + 500], theirs[j * size : j * size + size])) for j in range(rows)] for i in range(3)]
