"""The pipeline against a brute-force version of what each stage decides."""

import public_tokenizers as P
import pytest
import tiktoken
from test_search import brute_components, brute_hits

import corpus_pipeline
from kinweave.llm import bpe, pii


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas()) if stage is corpus_pipeline.STAGES[-1][1] else stage(spark, docs, sf_dir).persist()
        out.append((before, docs.collect(), docs.columns))
    return out


def test_columns_stay(spark, sf_dir, staged):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(c == want for _, _, c in staged[:-1])


def test_toxic_ones_go(spark, sf_dir, staged):
    before, after, _ = staged[0]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.03 * sum(v == 0 for v in labels.values())


def test_one_of_each_group_stays(staged):
    before, after, _ = staged[1]
    want = brute_components([(r["doc_id"], r["text"]) for r in before], k=5)
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if i == c}


def test_passages_are_cut(spark, sf_dir, staged):
    before, after, _ = staged[2]
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits([r["text"] for r in before], bench)
    texts = {r["doc_id"]: r["text"] for r in after}
    for r, (n, hit, _) in zip(before, hits, strict=True):
        assert (texts.get(r["doc_id"]) == r["text"]) if not hit else (r["doc_id"] in texts) == (n > hit)
    assert not any(h for _, h, _ in brute_hits([r["text"] for r in after], bench))
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_personal_data_is_masked(staged):
    before, after, _ = staged[3]
    anchors, texts = pii.automaton(), {r["doc_id"]: r["text"] for r in after}
    for r in before:
        found = pii.scan(r["text"], anchors)
        assert (texts[r["doc_id"]] == r["text"]) == (not any(found.values()))


def test_tokens(staged):
    before, after, _ = staged[4]
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(list(r["ids"]) == enc.encode_ordinary(texts[r["doc_id"]]) for r in after) and len(after) == len(before)


def test_run_equals_stages(spark, sf_dir, staged):
    got = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {(r["doc_id"], r["ids_sha256"]) for r in staged[-1][1]}
