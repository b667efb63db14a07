"""Toxicity scores by a counterfactually regularised classifier.

A logistic regression on words and stems of words, and on how many words of the lexicon it learns a text has. Identity
terms in labelled sentences are swapped for other terms of their group, and the fit pays for the squared change of score
between a sentence and its counterfactual, so that a neutral mention of a group does not raise a score.

Groups come from a list of identity terms and from the labelled texts themselves, in whatever language: pairs of words
that stand in like contexts and that the labels don't tell apart from chance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinweave.llm.common import buffers, id_text, labels_of, map_arrow, row_chunks, shingle_sets, ship, slices

#: Labelled documents that a fit uses at most, about: those of least hash, where there are more.
MAX_FIT_ROWS = 24_000
#: The labelled texts that a mark must be in, and the deviations by which these must be more, or less, toxic than chance.
LEAST_TEXTS, LEAST_Z = 8, 4.0
#: A word of a learned group is in this share of the labelled texts at least, so that such words are no more than a text's
#: distinct words over that share, whatever the texts are, and its texts are at most so many deviations from chance; both words of a pair are among the other's NEAR next neighbours by the cosine of their contexts, and as near
#: as ALIKE.
COMMON, NEUTRAL_Z, NEAR, ALIKE = 0.01, 1.0, 3, 0.4
#: Hashed neighbours on either side that describe a word's contexts.
CONTEXT = 64
RIDGE, COUNTERFACTUAL = 1e-4, 4.0
#: Weight at which a mark joins the lexicon.
LEXICON_WEIGHT = 0.5
ROUNDS = 400

#: Groups of identity terms whose members can stand for each other.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("mexican", "american", "chinese", "indian", "german", "french", "russian", "nigerian", "turkish", "polish"),
    ("deaf", "blind", "disabled", "autistic", "old", "young"),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_SENTENCE = bytes(10 if c in b".!?\n" else b for c, b in enumerate(_FOLD))
#: A word's marks: itself with END behind it, and its first 3 to 7 letters. Invented and inflected forms share a stem.
STEMS, END = range(3, 8), "$"
#: A mark counts when it occurs at least once, twice and three times; so do the words of the lexicon together, up to five.
LEVELS, LEXICON_LEVELS = 3, 5
#: Words whose marks a task remembers.
CACHE_WORDS = 60_000


def words_of(text: bytes) -> list[bytes]:
    """Words (letters, digits and whatever is not ASCII) with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def marks_of(word: str) -> list[str]:
    return [word + END, *(word[:k] for k in STEMS if len(word) > k)]


def partners(groups=IDENTITY_GROUPS) -> dict[bytes, tuple[bytes, ...]]:
    out: dict[bytes, tuple[bytes, ...]] = {}
    for g in groups:
        for w in g:
            out[w.encode()] = tuple(sorted({*out.get(w.encode(), ()), *(x.encode() for x in g if x != w)}))
    return out


def swaps(sentence: list[bytes], partner: dict[bytes, tuple[bytes, ...]]) -> list[list[bytes]]:
    """The counterfactuals of a sentence: for each identity term in it, each other term of its group in its place."""
    return [[other if x == w else x for x in sentence] for w in sorted(set(sentence)) for other in partner.get(w, ())]


class Reader:
    """Feature numbers of texts. A mark m at level k has the number m * LEVELS + k, the lexicon's follow after those."""

    def __init__(self, vocabulary: list[str], lexicon: frozenset[int] = frozenset()):
        self.number = {m: i for i, m in enumerate(vocabulary)}
        self.lexicon, self.size = lexicon, len(vocabulary)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def features(self, words: list[bytes]) -> list[int]:
        cache = self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = tuple(i for m in marks_of(w.decode("utf-8", "replace")) if (i := self.number.get(m)) is not None)
        times: dict[int, int] = {}
        in_lexicon = 0
        for marks in filter(None, map(cache.__getitem__, words)):
            for i in marks:
                times[i] = times.get(i, 0) + 1
            in_lexicon += not self.lexicon.isdisjoint(marks)
        out = [i * LEVELS + k for i, n in times.items() for k in range(min(n, LEVELS))]
        return sorted(out) + [self.size * LEVELS + k for k in range(min(in_lexicon, LEXICON_LEVELS))]

    @property
    def width(self) -> int:
        return self.size * LEVELS + LEXICON_LEVELS


@dataclass
class Model:
    vocabulary: list[str]
    lexicon: frozenset[int]
    weights: np.ndarray  # the bias last
    groups: tuple = ()  # learned groups of terms
    counterfactuals: int = 0  # swaps in labelled sentences that change a feature, which the fit was penalised for

    def reader(self) -> Reader:
        return Reader(self.vocabulary, self.lexicon)

    def score(self, words: list[bytes], reader: Reader) -> float:
        s = float(self.weights[-1]) + float(self.weights[reader.features(words)].sum())
        return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))


def solve(rows: list, width: int, y: np.ndarray, weight: np.ndarray, changes: list[tuple[tuple[int, ...], tuple[int, ...]]], times: np.ndarray, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE) -> np.ndarray:
    """Weights w, the bias last: weighted mean log loss + ridge * |w|^2 + counterfactual * weighted mean(change^2).

    rows: the features that each text has. changes: the features that a swap adds and takes away, and how often; the
    change of a score is the sum of w over the first less that over the others. By Nesterov's method.
    """
    n = float(weight.sum())
    sizes = np.array([len(r) + 1 for r in rows])
    at = np.concatenate([np.append(np.asarray(r, np.int64), width) for r in rows])  # each text has the bias
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 0
    c_at = np.array([i for more, less in changes for i in (*more, *less)], np.int64)
    c_sign = np.array([x for more, less in changes for x in (*[1.0] * len(more), *[-1.0] * len(less))])
    c_of = np.repeat(np.arange(len(changes)), [len(more) + len(less) for more, less in changes]) if changes else np.zeros(0, np.int64)
    c_weight = 2 * counterfactual * times / times.sum() if len(times) else np.zeros(0)

    def forward(w):
        return np.add.reduceat(w[at], starts)

    def back(g):
        return np.bincount(at, g[of], width + 1)

    def swapped(w):  # gradient of the penalty
        if not len(changes):
            return 0.0
        change = np.bincount(c_of, c_sign * w[c_at], len(changes))
        return np.bincount(c_at, c_sign * (c_weight * change)[c_of], width + 1)

    v = np.ones(width + 1)
    for _ in range(30):  # largest curvature, by the power method
        v = back(weight * forward(v)) / n / 4 + 2 * penalty * v + swapped(v)
        curve = float(np.linalg.norm(v))
        v /= curve
    step = 1 / (1.2 * curve)
    w = np.zeros(width + 1)
    v = w.copy()
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(forward(v), -30, 30)))
        new = v - step * (back(weight * (p - y) / n) + 2 * penalty * v + swapped(v))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def neutral_pairs(words: list[str], contexts: np.ndarray, alike: float = ALIKE, near: int = NEAR) -> tuple[tuple[str, str], ...]:
    """Pairs of words that are among each other's `near` next neighbours, by the cosine of their shares of contexts.

    Contexts that all words share say nothing, so the mean of the words goes first.
    """
    if len(words) < 2:
        return ()
    x = np.log1p(contexts.astype(np.float32))
    x = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-9)
    x = x - x.mean(axis=0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    found, k = [], min(near, len(words) - 1)
    for a in range(0, len(x), 256):
        same = x[a : a + 256] @ x.T
        same[np.arange(len(same)), np.arange(a, a + len(same))] = -2
        best = np.argsort(-same, axis=1, kind="stable")[:, :k] if len(x) < 4096 else np.argpartition(-same, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(same, best, 1)
        found += [(a + i, int(j)) for i in range(len(same)) for j in best[i][value[i] >= alike]]
    both = set(found)
    return tuple((words[i], words[j]) for i, j in sorted(both) if i < j and (j, i) in both)


def _contexts(texts: DataFrame, words: list[str]) -> np.ndarray:
    """Of each word (words x 2 * CONTEXT): how often each hash of a left and of a right neighbour stands beside it."""
    sent = texts.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words)})

    def count(batches):
        number, total = sent.value, np.zeros((len(words), 2 * CONTEXT), np.int64)
        for b in batches:
            for t in b.column(0):
                found = words_of(t.as_py().encode())
                side = [zlib.crc32(w) % CONTEXT for w in found]
                at = [(i, number[w]) for i, w in enumerate(found) if w in number]
                for shift, more in ((-1, 0), (1, CONTEXT)):
                    both = [(k, side[i + shift] + more) for i, k in at if 0 <= i + shift < len(found)]
                    if both:
                        np.add.at(total, tuple(np.array(both).T), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(total.ravel()[at[k : k + 50_000]])], ["at", "n"])

    sums = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(words) * 2 * CONTEXT, np.int64)
    out[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy()
    return out.reshape(len(words), 2 * CONTEXT)


def _changes(texts: DataFrame, terms: dict, reader: Reader) -> tuple[list, np.ndarray]:
    """What the swaps in all labelled sentences do to the features, each different change once, and how often it occurs."""
    sent = texts.sparkSession.sparkContext.broadcast((list(reader.number), reader.lexicon, terms))

    def count(batches):
        vocabulary, lexicon, terms = sent.value
        own, total = Reader(vocabulary, lexicon), Counter()
        for b in batches:
            for t in b.column(0):
                for s in t.as_py().encode().translate(_SENTENCE).split(b"\n"):
                    words = s.split()
                    if terms.keys().isdisjoint(words):
                        continue
                    now = set(own.features(words))
                    for other in swaps(words, terms):
                        then = set(own.features(other))
                        if now != then:
                            total[tuple(sorted(then - now)), tuple(sorted(now - then))] += 1
        if total:
            keys = list(total)
            lists = [pa.array([list(k[i]) for k in keys], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(list(total.values()), pa.int64())], ["more", "less", "n"])

    # as many different changes as pairs of terms have contexts in the rows of a fit, which max_rows bounds
    found = texts.select("text").mapInArrow(count, "more array<int>, less array<int>, n long").groupBy("more", "less").agg(F.sum("n").alias("n")).toPandas()
    rows = sorted((tuple(m), tuple(x), int(n)) for m, x, n in found.itertuples(index=False))
    return [(m, x) for m, x, _ in rows], np.array([n for _, _, n in rows], np.float64)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", groups=IDENTITY_GROUPS, max_rows: int = MAX_FIT_ROWS, counterfactual: float = COUNTERFACTUAL, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z, learn_groups: bool = True) -> Model | None:
    """None if no document has a label. Texts that share their least shingle hash share the weight of one text, so that a
    group of copies is one piece of evidence; null labels and labels of ids that no document has are ignored.

    max_rows bounds the labelled rows of a fit, about. All marks that least_texts and least_z admit are in the model, and
    all labelled sentences with a term of a group are swapped; both are bounded by the rows alone.
    """
    ship(documents.sparkSession)
    own = labels_of(labels, id_col, label_col)
    n = own.count()
    if n > max_rows:
        own = own.where(F.expr(f"pmod(xxhash64(label_id), 1000000) < {int(1_000_000 * max_rows / n)}"))
    # at most about max_rows ids and labels, so that no text is shuffled for them
    joined = id_text(documents, id_col, text_col).join(F.broadcast(own), F.col("id") == F.col("label_id")).select("text", "y")

    def prepare(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in row_chunks(off):
                sets, sizes = shingle_sets(data, off[i : j + 1], 5)
                ends = np.cumsum(sizes)
                least = [int(sets[e - s].astype(np.int64)) if s else 0 for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), *(c.slice(i, j - i) for c in b.columns)], ["least", "text", "y"])

    def words(batches):
        for b in batches:
            for part in slices(b, 0, 64):
                found = [sorted({w.decode("utf-8", "replace") for w in words_of(t.encode())}) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *part.columns[1:]], ["words", "y", "w"])

    rows = joined.mapInArrow(prepare, "least long, text string, y double").persist(StorageLevel.DISK_ONLY)
    shares = rows.groupBy("least").agg((1 / F.count("*")).alias("w"))  # no more rows than the fit has
    texts = rows.join(F.broadcast(shares), "least").select("text", "y", "w").persist(StorageLevel.DISK_ONLY)
    try:
        totals = texts.agg(F.count("*").alias("rows"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
        if not totals["rows"]:
            return None
        count, base = totals["n"], totals["y"] / totals["n"]
        spread = max(base * (1 - base), 1e-9)
        by_word = texts.mapInArrow(words, "words array<string>, y double, w double").select(F.explode("words").alias("word"), "w", (F.col("w") * F.col("y")).alias("t")).groupBy("word").agg(F.sum("w").alias("n"), F.sum("t").alias("toxic")).persist(StorageLevel.DISK_ONLY)
        marks = F.array_union(F.array(F.concat("word", F.lit(END))), F.transform(F.filter(F.array(*[F.lit(k) for k in STEMS]), lambda k: F.length("word") > k), lambda k: F.col("word").substr(F.lit(1), k)))
        z = (F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * spread)
        by_mark = by_word.select(F.explode(marks).alias("mark"), "n", "toxic").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        picked = by_mark.where(F.col("n") >= min(least_texts, max(1, count // 50))).where(F.abs(z) >= least_z).select("mark").collect()
        learned: tuple = ()
        if learn_groups:
            neutral = sorted(r["word"] for r in by_word.where((F.col("n") >= max(least_texts, COMMON * count)) & (F.abs(z) <= NEUTRAL_Z)).select("word").collect())
            learned = neutral_pairs(neutral, _contexts(texts, neutral)) if neutral else ()
        by_word.unpersist()
        terms = partners((*groups, *learned))
        vocabulary = sorted({r["mark"] for r in picked} | {m for g in groups for w in g for m in marks_of(w)[:1]})
        reader = Reader(vocabulary)

        def features(batches, reader=reader):
            own = Reader(list(reader.number), reader.lexicon)
            for b in batches:
                for part in slices(b, 0):
                    found = [own.features(words_of(t.encode())) for t in part.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *part.columns[1:]], ["x", "y", "w"])

        for last in (False, True):
            found = texts.mapInArrow(lambda b, r=reader: features(b, r), "x array<int>, y double, w double").toPandas()
            changes, times = _changes(texts, terms, reader)
            weights = solve(list(found["x"]), reader.width, found["y"].to_numpy(np.float64), found["w"].to_numpy(np.float64), changes, times, counterfactual)
            if not last:  # the marks that the first fit finds toxic become the lexicon of the second
                top = weights[: reader.size * LEVELS].reshape(-1, LEVELS).sum(axis=1)
                reader = Reader(vocabulary, frozenset(np.flatnonzero(top > LEXICON_WEIGHT).tolist()))
        return Model(vocabulary, reader.lexicon, weights, learned, int(times.sum()))
    finally:
        texts.unpersist()
        rows.unpersist()


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """id, score and predicted (1 if score >= cut) of every whole text.

    Null is empty; the empty text has the score of the bias; without a model scores are 0. One row in, one row out.
    """
    return _scored(id_text(documents, id_col, text_col), model, cut).select(F.col("id").alias(id_col), "score", "predicted")


def _scored(base: DataFrame, model: Model | None, cut: float) -> DataFrame:
    """base with score and predicted in the place of `text`, which has no nulls and comes last."""
    sent = base.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        reader = model.reader() if model else None

        def step(batch):
            for part in slices(batch, batch.num_columns - 1):
                s = np.array([model.score(words_of(t.as_py().encode()), reader) if model else 0.0 for t in part.columns[-1]], np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= cut).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

        return step

    schema = StructType(base.schema.fields[:-1]).add("score", "double").add("predicted", "integer")
    return map_arrow(base, make, schema)


def reject(documents: DataFrame, model: Model | None, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """documents without those of a score of at least cut. Null and empty texts have the score of the bias."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    base = documents.toDF(*names).withColumn("text", F.coalesce(names[documents.columns.index(text_col)], F.lit("")))
    return _scored(base, model, cut).where("predicted = 0").select(*names).toDF(*documents.columns)
