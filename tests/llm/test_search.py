"""Decontamination, personal data and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kinweave.llm import decontaminate, near_dup, pii, queries

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window=10):
    phrases = defaultdict(set)
    for item, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases[tuple(w[i : i + window])].add(item)
    out = []
    for t in texts:
        w = WORD.findall(t.translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if own := phrases.get(tuple(w[i : i + n])):
                    found |= own
                    hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_brute_force(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcdé") * r.randint(1, 2) for _ in range(n))
    items = [(str(i), text(r.randint(0, 14))) for i in range(12)] + [("0", "x"), ("z", None)]
    texts = [text(r.randint(0, 60)) + r.choice([" ", " x ", " q "]) + (items[3][1] or "") for _ in range(30)] + ["", "A-B"]
    counts, spans, found = decontaminate.search_shard([t.encode() for t in texts], decontaminate.Phrases(items, 5))
    assert [(c, sum(e - s for s, e in x), f) for c, x, f in zip(counts, spans, found, strict=True)] == brute_hits(texts, items, 5)


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    x = r.integers(0, 13, 300)
    tree = decontaminate.WaveletTree(x, 13)
    s, at = r.integers(0, 13, 500), r.integers(0, 301, 500)
    assert tree.rank(s, at).tolist() == [int((x[:b] == a).sum()) for a, b in zip(s.tolist(), at.tolist(), strict=True)]


def test_blocks_give_the_same(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = decontaminate.digest(decontaminate.find(documents, bench))
    many = decontaminate.digest(decontaminate.find(documents, bench, block_bytes=3000))
    assert sorted(one.collect()) == sorted(many.collect())


def test_decontamination_sql(same_rows):
    same_rows(queries.QUERIES["op5_decontamination"], queries.ORACLE["op5_decontamination"])


def test_remove(spark, edge):
    bench = spark.createDataFrame([(1, "sat on the mat and then it ran away from the dog"), (2, None), (None, "the cat")], "item_id long, text string")
    out = decontaminate.remove(edge, bench)
    assert out.columns == edge.columns and out.count() == edge.count()
    assert "The cat  today again" in [r["text"] for r in out.collect()]
    assert decontaminate.remove(edge, bench.limit(0)).count() == edge.count() and decontaminate.remove(edge.limit(0), bench).count() == 0
    whole = spark.createDataFrame([(1, "Sat on the MAT and then it ran away from the dog!")], "doc_id long, text string")
    assert decontaminate.remove(whole, bench).count() == 0


def brute_spans(t):
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15],
    }


def test_pii_brute_force(documents):
    anchors, r = pii.automaton(), random.Random(1)
    texts = [x["text"] for x in documents.collect()] + ["".join(r.choice("a@@..--+ 1239%é()0") for _ in range(r.randint(0, 40))) for _ in range(8000)]
    texts += ["4785380592391139 4785-3805-9239-1139", "1.2.3.4.5.6.7.8", "0001.0002.0003.0004"]
    for t in texts:
        found = pii.scan(t, anchors)
        assert {k: found[k] for k in pii.BASE} == brute_spans(t), t


def test_pii_kinds():
    anchors = pii.automaton()
    mask = lambda t: pii.masked(t, pii.scan(t, anchors))
    assert mask('my token = "abcdef0123456789" ok') == 'my token = "<SECRET>" ok'
    assert mask("IBAN: DE89 3704 0044 0532 0130 00 and") == "IBAN: <ACCOUNT> and"
    assert mask("account no. 12345678.") == "account no. <ACCOUNT>." and mask("on account of 2") == "on account of 2"
    assert mask("see https://bob:pw@host/x") != "see https://bob:pw@host/x"
    assert mask("mail a.b@c.de, call +1 (017) 555-7713") == "mail <EMAIL>, call <PHONE>"


def test_pii_query(spark, edge):
    out = pii.find(edge, with_masked=True).collect()
    assert len(out) == edge.count()
    one = next(r for r in out if r["n_email"])
    assert one["base_sha256"] == hashlib.sha256(b"email:0:8,phone:9:26").hexdigest() and one["spans"] == "email:0:8,phone:9:26"
    assert pii.mask(edge).columns == edge.columns and pii.mask(edge).where("text is null").count() == 1 and pii.mask(edge.limit(0)).count() == 0


def brute_components(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    least = {i: i for i in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for p in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        a, b = sets[p[0]], sets[p[1]]
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = top(p[0]), top(p[1])
            least[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_dup_brute_force(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.find(documents).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_near_dup_families(spark):
    """A large group of near copies, many of them just under the threshold of its centre."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for j in r.sample(range(120), r.randint(0, 12)):
            w[j] = f"x{r.randrange(6)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    got = near_dup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 1 << 63, 4000, dtype=np.uint64))
    r.shuffle(x)
    a, b, c = x[:3000], x[1000:], x
    ra, rb, rc = (near_dup.registers(s, np.array([len(s)]))[0] for s in (a, b, c))
    assert (np.maximum(ra, rb) == rc).all()
    assert abs(near_dup.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([3000.0]), np.array([3000.0]))[0] - 0.5) < 0.15


def test_near_dup_edges(spark, edge):
    got = near_dup.find(edge).collect()
    assert len(got) == edge.count() and all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 11)} == {6}
    kept = near_dup.dedup(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 11").count() == 0
    assert near_dup.find(edge.limit(0)).count() == 0
