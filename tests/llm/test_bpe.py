"""Byte-level BPE against the tiktoken library, and its round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from kinweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ranks, library):
    codec, r = bpe.Codec(ranks, P.PATTERN), random.Random(3)
    alphabet = "abcdefgh ABC 0123 .,'!\n\té ü ß日本 \x1c\x85👩‍"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["", "a" * 3000, "ab" * 700, "é" * 400, "<|endoftext|>", "zq" * 128, "x" * 257, "it's we'll I'd", " " * 900]
    got = codec.encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]


def test_long_and_matrix_merges_agree(ranks):
    codec, r = bpe.Codec(ranks, P.PATTERN), random.Random(5)
    for _ in range(60):
        piece = bytes(r.randrange(256) for _ in range(r.randint(2, 200)))
        if piece not in ranks:
            assert codec.merge([piece])[0] == codec.merge_long(piece)


def test_query(spark, documents, library):
    got = {r["doc_id"]: r for r in bpe.encode(documents, PATH, P.PATTERN).collect()}
    for r in documents.limit(40).collect():
        ids = library.encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and g["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_edges(spark, edge):
    out = bpe.encode(edge, PATH, P.PATTERN)
    assert out.count() == edge.count()
    back = bpe.decode(out, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in back)
    assert bpe.encode(edge.limit(0), PATH, P.PATTERN).count() == 0
