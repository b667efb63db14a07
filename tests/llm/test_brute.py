"""Learned operators against plain versions of their definitions, and cases beyond former limits."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import decontaminate, langid, media, near_dup, pii, queries, shared, toxicity
from kinweave.llm.common import mod_crc, table
from test_search import brute_components


# ---- toxicity


def test_solve_meets_the_gradient():
    """At the solution the gradient of the plain loss, from dense matrices, is nothing."""
    r = np.random.default_rng(3)
    rows = [sorted(r.choice(12, r.integers(0, 6), replace=False).tolist()) for _ in range(80)]
    x = np.zeros((80, 13))
    for i, f in enumerate(rows):
        x[i, f] = 1
    x[:, 12] = 1
    y, weight = (r.random(80) < 0.4).astype(float), r.random(80) + 0.1
    changes, times = [((0, 1), (2,)), ((3,), ()), ((), (4, 5))], np.array([3.0, 1.0, 2.0])
    c = np.zeros((3, 13))
    for i, (more, less) in enumerate(changes):
        c[i, list(more)] += 1
        c[i, list(less)] -= 1
    w = toxicity.solve(rows, 12, y, weight, changes, times, 0.7, 0.05)
    p = 1 / (1 + np.exp(-x @ w))
    ridge = np.append(np.full(12, 0.05), 0.0)
    gradient = x.T @ (weight * (p - y)) / weight.sum() + 2 * ridge * w + 2 * 0.7 * c.T @ (times * (c @ w)) / times.sum()
    assert np.abs(gradient).max() < 1e-4


def test_counterfactuals_come_from_the_data():
    """The penalty acts on the registered query's own fit: swaps are found and the weights change."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    d = "/root/testdata/sf0.01"
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels").where(mod_crc("doc_id", 5) != 0)
    with_, without = (toxicity.fit(documents, labels, counterfactual=c) for c in (toxicity.COUNTERFACTUAL, 0.0))
    assert with_.counterfactuals > 0 and with_.groups == without.groups and len(with_.groups) > 0
    assert np.abs(with_.weights - without.weights).max() > 1e-3


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


def test_scores_are_the_plain_sum():
    m = toxicity.Model(["bad$", "ba", "bad"], frozenset([0]), np.array([*[0.5, 0.25, 0.125] * 3, *[1.0, 0, 0, 0, 0], -2.0]))
    words = toxicity.words_of(b"Bad bad bar")
    # bad$ at the levels 1 and 2 (no stem, as the word has three letters); one and two lexicon words
    want = -2 + (0.5 + 0.25) + (1.0 + 0)
    assert m.score(words, m.reader()) == pytest.approx(1 / (1 + np.exp(-want)))


def test_neutral_pairs():
    x = np.array([[9, 0, 1, 0], [8, 0, 1, 0], [0, 7, 0, 3], [0, 6, 0, 3], [2, 2, 9, 9]])
    assert toxicity.neutral_pairs(list("abcde"), x, 0.8, 1) == (("a", "b"), ("c", "d")) and toxicity.neutral_pairs(["a"], x[:1]) == ()


# ---- language


def plain_infer(bins, log_p):
    """All nested sets of languages by plain EM for one document."""
    k, n = len(log_p), len(bins)
    p = np.exp(log_p[:, bins])

    def em(pi):
        for _ in range(langid.ROUNDS):
            joint = p * pi[:, None]
            pi = (joint / joint.sum(axis=0)).sum(axis=1) / n
        return pi, float(np.log((p * pi[:, None]).sum(axis=0)).sum())

    single = log_p[:, bins].sum(axis=1)
    top, cost = int(single.argmax()), langid.PENALTY * np.log(n + 1)
    pi, _ = em(np.full(k, 1 / k))
    order = [top, *(x for x in np.argsort(-pi, kind="stable") if x != top)]
    best = (single[top], pi, [top])
    for m in range(2, k + 1):
        start = np.zeros(k)
        start[order[:m]] = 1 / m
        q, like = em(start)
        if like - cost * (m - 1) > best[0]:
            best = (like - cost * (m - 1), q, order[:m])
    return best[1], sorted(best[2])


@pytest.mark.parametrize("seed", range(3))
def test_mixture_against_plain_em(seed):
    r = np.random.default_rng(seed)
    log_p = np.full((4, langid.BINS), np.log(1e-7))
    for i in range(4):
        own = r.choice(langid.BINS, 300, replace=False)
        log_p[i, own] = np.log(r.dirichlet(np.ones(300)) + 1e-6)
    docs = []
    for d in range(12):
        langs = r.choice(4, r.integers(1, 4), replace=False)
        docs.append(np.concatenate([r.choice(np.flatnonzero(log_p[x] > -15), r.integers(20, 120)) for x in langs]))
    docs.append(np.zeros(0, np.int64))
    bins, doc = np.concatenate(docs).astype(np.uint32), np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    best, share, chosen = langid.infer(bins, doc, len(docs), 4, lambda g: log_p[:, g])
    for i, x in enumerate(docs[:-1]):
        q, langs = plain_infer(x, log_p)
        assert np.flatnonzero(chosen[i]).tolist() == langs and np.allclose(share[i], q, atol=1e-6) and best[i] == (q.argmax() if len(langs) > 1 else langs[0])
    assert best[-1] == -1


def test_six_hundred_languages(spark):
    r = random.Random(2)
    alphabet = [chr(c) for c in (*range(97, 123), *range(0x430, 0x450), *range(0x3B1, 0x3C9))]
    words = {f"l{i:03}": ["".join(r.choice(alphabet) for _ in range(7)) for _ in range(6)] for i in range(600)}
    train = spark.createDataFrame([(" ".join(w * 3), x) for x, w in words.items()], "text string, lang string")
    names, log_p = langid.train(train)
    test = spark.createDataFrame([(i, " ".join(words[f"l{i:03}"][:5])) for i in range(0, 600, 29)], "doc_id long, text string")
    got = langid.predict(test, names, log_p).collect()
    assert len(names) == 600 and all(x["lang_pred"] == f"l{x['doc_id']:03}" for x in got)


def test_no_training_rows(spark):
    names, log_p = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert names == [] and log_p.shape == (0, langid.BINS)


# ---- media


def test_log_mel_against_a_direct_transform():
    x = np.random.default_rng(1).normal(size=media.FRAME + 3 * media.HOP).astype(np.float32)
    bank, energy = media.log_mel(x)
    t, f = np.arange(media.FRAME), np.arange(media.FRAME // 2 + 1)
    for i in range(4):
        frame = x[i * media.HOP : i * media.HOP + media.FRAME].astype(np.float64)
        spectrum = np.abs((frame * np.hanning(media.FRAME)) @ np.exp(-2j * np.pi * np.outer(t, f) / media.FRAME)) ** 2
        assert np.allclose(bank[i], np.log(spectrum @ media._mel() + 1e-6), atol=1e-3)
        assert np.isclose(energy[i], 10 * np.log10((frame**2).mean() + 1e-9), atol=1e-3)


def test_stored_form_carries_segments(spark, documents):
    rows = media.describe(documents, with_media=True, with_segments=True).collect()
    assert any(r["segments"] for r in rows)
    for r in rows:
        found = media.segments_of(bytes(r["media"]))
        assert found.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float32(), media.SHAPE)
        assert found.column("start").to_pylist() == [s["start"] for s in r["segments"]]
        if r["segments"]:
            assert np.array_equal(found.column("logmel").combine_chunks().to_numpy_ndarray().reshape(len(found), -1), np.array([s["logmel"] for s in r["segments"]], np.float32))
    assert media.segments_of(media.to_wave(b"\0" * 64)).num_rows == 0


def test_no_segments(spark, documents):
    rows = media.segment_rows(media.describe(documents.limit(0), with_segments=True)).toPandas()
    empty = pa.table({"start": pa.array([], pa.float64()), "end": pa.array([], pa.float64()), "logmel": pa.array([], pa.list_(pa.float32()))})
    assert len(rows) == 0 and media.tensor_table(empty).num_rows == 0


# ---- decontamination


def test_twenty_blocks_in_one_node(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    size = sum(len(r["text"] or "") + 16 for r in bench.collect())
    many = decontaminate.find(documents, bench, block_bytes=size // 40)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(decontaminate._blocks(bench, "item_id", "text", 10, size // 40)) >= 20
    assert sorted(decontaminate.digest(many).collect()) == sorted(decontaminate.digest(decontaminate.find(documents, bench)).collect())


def test_a_window_is_small_in_memory():
    r = random.Random(0)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(60))) for i in range(4000)]
    p = decontaminate.Phrases(items, 10)
    arrays = [p.vocabulary, p.tokens, p.word_off, *(x for g in p.groups for x in g[1:])]
    windows = sum(len(g[1]) for g in p.groups)
    assert (sum(x.nbytes for x in arrays) + len(p.word_bytes)) / windows < 100


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """A word that has the hash of another is no match."""
    real = decontaminate.word_hashes
    phrases = decontaminate.Phrases([("1", "aa bb cc dd")], 4)
    other = real(np.frombuffer(b"zz", np.uint8), np.array([0, 2]), ~decontaminate._WORD)[0][0]
    first = real(np.frombuffer(b"aa", np.uint8), np.array([0, 2]), ~decontaminate._WORD)[0][0]
    monkeypatch.setattr(decontaminate, "word_hashes", lambda *a: (lambda w, c: (np.where(w == other, first, w), c))(*real(*a)))
    counts, spans, items = decontaminate.search_shard([b"zz bb cc dd", b"aa bb cc dd"], phrases)
    assert spans == [[], [(0, 4)]] and items == [[], ["1"]]


# ---- personal data


def test_ten_thousand_characters_of_secret():
    secret = "aB3" * 3400
    found = pii.scan(f"X-Api-Key: {secret} end", pii.automaton())
    assert found["secret"] == [(11, 11 + len(secret))]


def test_counts_of_further_kinds(spark):
    d = spark.createDataFrame([(1, 'token = "abcdefgh12345" ftp://u:p@h.org IBAN: DE89370400440532013000 1.2.3.4')], "doc_id long, text string")
    r = pii.find(d).first()
    assert (r["n_secret"], r["n_account"], r["n_login"], r["n_ip"]) == (1, 1, 1, 1)


# ---- near-duplicates


@pytest.mark.parametrize("block", [7, 1000])
def test_many_near_copies_of_one_text(spark, block, monkeypatch):
    """Copies that each differ from the first by a different share; some are linked over others alone."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "MANY_BLOCKS", 2)
    monkeypatch.setattr(shared, "HOT_ROWS", 20)
    r = random.Random(block)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for j in r.sample(range(120), r.choice([1, 2, 4, 6, 8])):
            words[j] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows, k=4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.find(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


def test_scratch_tables_go(spark, tmp_path):
    with shared.scratch(spark):
        a = shared.stored(spark.range(3))
        b = shared.stored(spark.range(4), keep=True)
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a._kinweave_path).count()
    shared.forget(b)
    with pytest.raises(Exception):
        spark.read.parquet(b._kinweave_path).count()


def test_all_queries_keep_their_contract(spark, sf_dir):
    first = {"op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]}
    for name, columns in first.items():
        assert queries.QUERIES[name](spark, sf_dir).columns[: len(columns)] == columns
