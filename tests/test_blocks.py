"""Sums of token weights over pairs of blocks, and rounding as SQL does it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.functions import overlap
from kinweave.operators import blocking
from kinweave.plans import queries

CODE = 1_000_000_000


def table(ids, id_name, **columns):
    return pa.table({id_name: pa.array(ids, pa.int64()), **{n: pa.array(v, pa.list_(pa.float64() if n[0] == "w" else pa.int64())) for n, v in columns.items()}})


@pytest.mark.parametrize(("share", "common"), [(0.012, False), (0.012, True), (9.0, True), (0.0, True)])
def test_best_pairs_brute_force(share, common, monkeypatch):
    monkeypatch.setattr(overlap, "SHARE", share)
    monkeypatch.setattr(overlap, "MATCHES", 200)
    r = random.Random(7)
    weight = {t: round(r.uniform(0.5, 4), 3) for t in range(60)}
    often = {t for t in weight if common and t % 4 == 0}
    draw = lambda: sorted(r.sample(range(60), r.choice([0, 1, 2, 5, 9])))
    mine, theirs = {i: (draw(), draw()) for i in range(40)}, {i: (draw(), draw()) for i in range(100, 190)}
    theirs |= {i: theirs[100] for i in range(190, 260)}  # many equal ones
    e = table(list(mine), "s1", **{f"t{c}": [m[c] for m in mine.values()] for c in (0, 1)}, **{f"w{c}": [[-weight[x] if x in often else weight[x] for x in m[c]] for m in mine.values()] for c in (0, 1)})
    t = table(list(theirs), "cand", **{f"t{c}": [m[c] for m in theirs.values()] for c in (0, 1)})
    found = {(x["s1"], x["cand"]): x for x in overlap.best_pairs(e, t, (5, 3), 2, 6.0).to_pylist()}
    for i, m in mine.items():
        for c, most in ((0, 5), (1, 3)):
            rows = []
            for j, o in theirs.items():
                both = set(m[c]) & set(o[c])
                score = sum(weight[x] for x in both)
                if both - often and (len(both) >= 2 or round(score, 6) >= 6):
                    rows.append((-round(score, 6), j, len(both)))
            for score, j, shared in sorted(rows)[:most]:
                x = found[i, j]
                assert x[f"score{c}"] == pytest.approx(-score, abs=1e-9) and x[f"shared{c}"] == shared and x[f"made{c}"]


@pytest.mark.parametrize("many", [0.05, 0.0])
def test_bounds_leave_no_best_pair_out(many, monkeypatch):
    """Targets beyond the groups of bounds, in one block and in several: the best of both channels, and few besides."""
    monkeypatch.setattr(overlap, "MANY", many)
    r = np.random.default_rng(3)
    df = 1 / np.arange(1, 401) ** 0.8
    draw = lambda n: np.sort(r.choice(400, n, replace=False, p=df / df.sum())).tolist()
    mine, theirs = [(draw(60), draw(4)) for _ in range(12)], [(draw(60), draw(4)) for _ in range(900)]
    weight = np.log1p(1 / df / 2) ** 2
    e = table(range(12), "s1", **{f"t{c}": [m[c] for m in mine] for c in (0, 1)}, **{f"w{c}": [weight[m[c]].tolist() for m in mine] for c in (0, 1)})
    t = table(range(100, 1000), "cand", **{f"t{c}": [o[c] for o in theirs] for c in (0, 1)})
    seen = []
    monkeypatch.setattr(overlap.Channel, "_ranked", lambda self, i, found, *a, f=overlap.Channel._ranked: seen.append(len(found)) or f(self, i, found, *a))
    for blocks in (t, [t.slice(0, 300), t.slice(300, 450), t.slice(750)]):
        found = {(x["s1"], x["cand"]): x for x in overlap.best_pairs(e, blocks, (10, 5), 2, 6.0).to_pylist()}
        for i, m in enumerate(mine):
            for c, most in ((0, 10), (1, 5)):
                rows = [(-round(float(weight[both].sum()), 6), 100 + j, len(both)) for j, o in enumerate(theirs) if (both := sorted(set(m[c]) & set(o[c])))]
                for score, j, shared in sorted(x for x in rows if x[2] >= 2 or x[0] <= -6)[:most]:
                    assert found[i, j][f"score{c}"] == pytest.approx(-score, abs=2e-6) and found[i, j][f"shared{c}"] == shared and found[i, j][f"made{c}"]
        assert len(found) <= 12 * 15 * 2
    assert np.median(seen[:24:2]) < 450


def test_rows_of_one_id_count_together():
    t = table([9, 9], "cand", t0=[[1, 2], [2, 3]])
    found = overlap.best_pairs(table([1], "s1", t0=[[1, 2, 3]], w0=[[1.0, 2.0, 4.0]]), t, (5,), 2, 6.0).to_pylist()
    assert [(x["cand"], x["score0"], x["shared0"]) for x in found] == [(9, 9.0, 4)]


def test_no_match_is_stored(spark):
    """What the candidate table exchanges are records and best pairs: no row of it stands for matches of a token."""
    rows = [((i % 3 + 1) * CODE + i, i % 3 + 1, "en", "alpha beta", "gamma delta") for i in range(30)]
    views = blocking.record_views(spark.createDataFrame(rows, "code long, source int, country string, name string, address string"))
    plan = blocking.block(views)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "cands" not in plan


def test_rounds_as_sql(spark, duck):
    values = [323 / 640, 0.0, -323 / 640, 0.0078125, 1e-9, 123456.0000005, 2.5e12, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(queries._six(queries.F.col("x"))).collect()]
    want = [duck.execute("select round(cast(? as double), 6)", [v]).fetchone()[0] for v in values]
    assert got == want and np.isclose(got, values, atol=1e-6).all()


def test_capped_tokens_have_no_weight(spark, tmp_path, monkeypatch):
    """A token in more than DF_CAP targets is in neither result."""
    n = 3 * blocking.DF_CAP // 2 + 3000
    spark.range(n).selectExpr("id as doc_id", "if(id % 300 < 3, 'common rare', 'common') as text", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"] for r in queries.QUERIES["token_df_idf"](spark, str(tmp_path)).collect()}
    assert got == {"rare"}
