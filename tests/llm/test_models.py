"""Classifiers, language identification, media, licences and main texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import html_text, langid, licenses, media, quality, queries, toxicity


# ---- toxicity


def test_toxicity_held_out(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op1_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    toxic, got = got["toxic"] == 1, got["predicted"]
    assert got[toxic].mean() >= 0.5 and got[~toxic].mean() <= 0.05  # which no constant meets
    assert queries.op1_toxicity(spark, sf_dir).columns == ["doc_id", "held_out", "score", "predicted"]


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """A term that only toxic documents mention loses its weight when its counterfactuals are penalised."""
    r = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [f"w{r.randrange(400)}" for _ in range(14)]
        if toxic:
            words += ["idiot"] * r.randint(0, 2) + (["muslim"] if r.random() < 0.8 else [])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = ["my muslim friend"]
    with_, without = (toxicity.fit(d, lab, counterfactual=c) for c in (50.0, 0.0))
    score = lambda m: m.score(toxicity.words_of(neutral[0].encode()), m.reader())
    plain = lambda m: m.score([b"friend"], m.reader())
    assert score(with_) - plain(with_) < 0.5 * (score(without) - plain(without))


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (99, 1), (6, 1), (6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    out = toxicity.score(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.fit(edge, labels.limit(0)) is None and toxicity.score(edge, None).where("predicted = 1").count() == 0
    assert toxicity.reject(edge, None).columns == edge.columns and toxicity.reject(edge, None).count() == edge.count()
    assert toxicity.score(edge.limit(0), model).count() == 0


# ---- quality


def test_quality_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op7_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.75 and got["score"].between(0, 1).all()


def test_isotonic():
    r = np.random.default_rng(0)
    y, w = r.random(40), r.random(40) + 0.1
    f = quality.isotonic(y, w)
    assert (np.diff(f) >= -1e-12).all() and abs((f * w).sum() - (y * w).sum()) < 1e-9
    # the least squares solution by min-max of weighted means
    mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    assert np.allclose(f, [max(min(mean(a, b) for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)])


def test_normal_equations_equal_one_pass(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = quality.fit(documents.repartition(1), labels), quality.fit(documents.repartition(5), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-4)


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (6, 1), (10, 0)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    out = quality.score(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.fit(edge, labels.limit(0)) is None and quality.score(edge, None).where("score = 0.5").count() == edge.count()


# ---- language


def test_language_held_out(spark, documents, sf_dir):
    got = queries.op4_language(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.95


def test_mixture_of_two_languages(spark):
    r = random.Random(1)
    words = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "qwz xkv jjq zzx wqy kxj".split(), "cc": "één twee drie vier vijf zes".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(x, 40), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)] + [(99, "x", None)], "doc_id long, text string, lang string")
    names, log_p = langid.train(train)
    test = spark.createDataFrame([(1, text("aa", 60)), (2, text("aa", 60) + " " + text("bb", 30)), (3, text("bb", 50))], "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.predict(test, names, log_p, with_mixture=True).collect()}
    assert set(got[1]["mixture"]) == {"aa"} and set(got[2]["mixture"]) == {"aa", "bb"} and set(got[3]["mixture"]) == {"bb"}
    assert got[2]["lang_pred"] == "aa" and 0.5 < got[2]["score"] < 0.85


def test_em_raises_the_likelihood():
    r = np.random.default_rng(0)
    log_p = np.log(r.dirichlet(np.ones(langid.BINS), 3))
    g = r.integers(0, langid.BINS, 500)
    p, t, one = np.exp(log_p)[:, g], np.ones(500), np.zeros(1, np.int64)
    like = [langid._em(p, t, one, np.zeros(500, np.int64), np.array([500.0]), np.array([x]))[1][0] for x in ([1 / 3, 1 / 3, 1 / 3], langid._em(p, t, one, np.zeros(500, np.int64), np.array([500.0]), np.full((1, 3), 1 / 3))[0][0])]
    assert like[1] >= like[0] - 1e-9


def test_language_edges(spark, edge):
    names, log_p = langid.train(edge)
    out = {r["doc_id"]: r for r in langid.predict(edge, names, log_p).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[12]["lang_pred"] == "und" and out[4]["lang_pred"] in names
    assert langid.predict(edge, [], np.zeros((0, langid.BINS))).where("lang_pred != 'und'").count() == 0
    assert langid.predict(edge.limit(0), names, log_p).count() == 0


# ---- media


def test_wave_round_trip_and_digests(spark, documents):
    got = {r["doc_id"]: r for r in media.describe(documents, with_media=True, with_segments=True).collect()}
    for r in documents.limit(50).collect():
        raw, g = r["text"].encode(), got[r["doc_id"]]
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.from_wave(bytes(g["media"])) == (want, media.RATE)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(g["media"]), hashlib.sha256(g["media"]).hexdigest())
        assert all(len(s["logmel"]) == media.STEPS * media.MELS and s["start"] < s["end"] for s in g["segments"])


def test_resample_against_direct_filter():
    x = np.random.default_rng(0).normal(size=501).astype(np.float32)
    up = np.zeros(501 * media.UP)
    up[:: media.UP] = x
    full = np.convolve(up, media._filter())[: len(up)]
    assert media.UP > 1 and np.allclose(media.resample(x), full[:: media.DOWN], atol=1e-4)


def test_segments_have_hysteresis():
    e = np.array([0, 0, 10, 5, 5, 10, 0, 0, 5, 5, 0, 0.0])
    assert media.segments(e).tolist() == [[2, 6]]


def test_tensors(spark, documents):
    rows = media.segment_rows(media.describe(documents.limit(20), with_segments=True)).toPandas()
    table = media.tensor_table(pa.table({"doc_id": rows["doc_id"], "start": rows["start"], "end": rows["end"], "logmel": pa.array([list(x) for x in rows["logmel"]], pa.list_(pa.float32()))}))
    assert table.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float32(), media.SHAPE)
    assert table.column("logmel").combine_chunks().to_numpy_ndarray().shape[1:] == media.SHAPE


def test_media_edges(spark, edge):
    out = media.describe(edge).collect()
    assert len(out) == edge.count() and next(r for r in out if r["doc_id"] == 0)["payload_bytes"] == 64
    assert len({r["feature"] for r in out if r["doc_id"] in (6, 11)}) == 1 and media.describe(edge.limit(0)).count() == 0


# ---- licences


def test_licenses_sql(same_rows):
    same_rows(queries.QUERIES["op3_licenses"], queries.ORACLE["op3_licenses"])


def test_license_rules(spark):
    mit = "The MIT License (MIT)\n\nCopyright 2020 x\n\n" + licenses.SENTENCES["mit-grant"].replace("to deal in", "to\ndeal in") + "\n\n" + licenses.SENTENCES["mit-notice"]
    rows = [(1, mit), (2, "Some text.\nReleased under the MIT License.\nAll rights reserved."), (3, "license of nothing"), (4, None), (5, "LICENSED UNDER CC BY-SA 4.0"), (6, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["sentence_ids"] == "mit-title,mit-grant,mit-notice" and got[1]["first_rule"] == 0
    assert got[2]["licenses"] == "MIT,Proprietary" and got[3]["n_sentences"] == 0 and got[4]["first_rule"] == -1
    assert got[5]["licenses"] == "CC-BY-SA-4.0" and got[6]["first_rule"] == 3


def test_licenses_plan_is_native(spark, edge):
    out = licenses.scan(edge)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert out.count() == edge.count() and licenses.scan(edge.limit(0)).count() == 0


# ---- main text

PAGE = """<html><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content" class="post-{n}"><h1>Title &amp; more</h1><p>First&nbsp; <b>para</b>graph of the text, long enough.<p>Second one<br>with a break, also long enough to count.
<div class="ad">Buy now</div><aside>Side</aside><form><input>Search</form><script>if (a < b) {{}}</script><section class="comments"><p>A reader says</section></div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph of the text, long enough.\nSecond one with a break, also long enough to count."


def test_page():
    assert html_text.extract_page(PAGE.format(n=1)) == TEXT
    assert html_text.extract_page("") == "" and html_text.extract_page("just text & more") == "just text & more"
    assert html_text.extract_page("<article><p>x</p></article><article><p>y</p></article>") == "x\ny"


def test_consensus_beats_a_misleading_page(spark):
    odd = PAGE.format(n=9).replace("</div><footer>", "</div><div class='teaser-box'>" + "A long block of other words that is not the article. " * 30 + "</div><footer>")
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=i)) for i in range(5)] + [(9, "http://u@H.example:80/9", odd), (10, None, PAGE.format(n=3)), (11, "https://x.example", None)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9]["text"] == TEXT and got[10]["text"] == TEXT and got[11]["text"] == "" and got[9]["n_chars"] == len(TEXT)
    assert html_text.extract_page(odd) != TEXT


def test_pages_table(spark, sf_dir):
    """The articles of the test pages by a plain reading of their one template."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("source", ["<" * 20000, "<a " * 20000, "<p>" * 5000, "<div>" * 1500 + "x", "<nav>" * 3000 + "x", "<!--" * 5000, "<a href='" * 5000 + ">", "</div>" * 5000])
def test_hostile_pages(source):
    html_text.extract_page(source)


def test_html_edges(spark):
    rows = [(1, "https://a.b/c", "<p>x</p>", "h", "p"), (1, "https://a.b/c", "<p>x</p>", "h", "p"), (None, "", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    assert sorted(r["text"] for r in html_text.extract(pages).collect()) == ["", "x", "x"]
    assert html_text.extract(pages.limit(0)).count() == 0
    assert pages.where(F.col("html") == "<p>x</p>").count() == 2
