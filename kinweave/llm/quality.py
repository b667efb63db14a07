"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Random Fourier features approximate a Gaussian kernel. Tasks sum normal equations over their rows, Spark sums those of
the tasks, the driver solves one system of a fixed size. Calibration: rows that the fit didn't see are counted in a fixed
number of score bins, and pooling adjacent violators makes the rates of the bins rise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import buffers, id_text, labels_of, map_arrow, row_chunks, ship, word_hashes

FEATURES = 192
#: Width of the kernel in deviations of a statistic.
WIDTH = 3.0
RIDGE = 1e-3
BINS = 400
#: Labelled rows that the statistics of one task of the fit cover, about.
FIT_ROWS = 20_000
#: Labelled rows that a fit uses at most, about: the rows of least hash, where there are more.
MAX_FIT_ROWS = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_GROUPS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "blank": np.isin(np.arange(256), [32, 9, 10, 11, 12, 13]),
    "stop": np.isin(np.arange(256), [ord(c) for c in ".,;:?"]),
    "shout": np.isin(np.arange(256), [ord("!")]),
    "bar": np.isin(np.arange(256), [ord(c) for c in "|/\\<>{}[]"]),
    "symbol": np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~_=+`"]),
    "line": np.isin(np.arange(256), [10]),
    "further": np.arange(256) >= 128,
}
_GROUP_TABLE = np.array([g for g in _GROUPS.values()]).T.astype(np.float64)
_BREAK = np.isin(np.arange(256), [10])
STATISTICS = ("length", "letter", *_GROUPS, "entropy", "word_length", "words", "distinct_words", "distinct_lines", "line_words", "repeats")


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of distinct hashes of each text."""
    if not len(hashes):
        return np.zeros(len(counts))
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc)) if len(counts) > 1 else np.argsort(hashes)
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return np.bincount(d[new], minlength=len(counts)).astype(np.float64)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """STATISTICS of each text of a run; all defined for the empty text."""
    n = len(off) - 1
    raw, size = data[int(off[0]) : int(off[-1])], np.diff(off).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64)
    bytes_ = np.maximum(size, 1)
    groups = hist @ _GROUP_TABLE / bytes_[:, None]
    letters = hist @ _LETTER
    upper = groups[:, 0] * bytes_ / np.maximum(letters, 1)
    share = hist / bytes_[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    words, n_words = word_hashes(data, off)
    lines, n_lines = word_hashes(data, off, _BREAK)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    repeats = np.bincount(np.repeat(np.arange(n), n_words), same, n)
    solid = bytes_ * (1 - groups[:, 2])
    return np.column_stack([
        np.log1p(size), letters / bytes_, upper, groups[:, 1:], entropy, np.minimum(solid / np.maximum(n_words, 1), 40), np.log1p(n_words),
        _distinct(words, n_words) / np.maximum(n_words, 1), _distinct(lines, n_lines) / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)), repeats / np.maximum(n_words, 1),
    ])


def _batch_statistics(column: pa.Array) -> np.ndarray:
    data, off = buffers(column)
    return np.concatenate([statistics(data, off[i : j + 1]) for i, j in row_chunks(off)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    rate: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(x)), z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated rate, with a hundredth of the raw score to tell rows of one pooled block apart."""
        raw = self.raw(x)
        return np.clip(0.99 * np.interp(raw, self.at, self.rate) + 0.01 * np.clip(raw / 2 + 0.25, 0, 1), 0, 1)


def isotonic(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising sequence nearest to rate."""
    blocks: list[list[float]] = []
    for r, w in zip(rate.tolist(), weight.tolist(), strict=True):
        blocks.append([r, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            r2, w2, n2 = blocks.pop()
            r1, w1, n1 = blocks.pop()
            blocks.append([(r1 * w1 + r2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), r) for r, _, n in blocks]) if blocks else rate


def _sums(rows: DataFrame, matrix) -> dict[int, float]:
    """Sums over all rows of what matrix(x, y) gives, a vector of a fixed length for each batch."""

    def part(batches):
        total = None
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), np.float64), b.column(1).to_numpy(zero_copy_only=False)
            if len(y):
                v = matrix(x, y)
                total = v if total is None else total + v
        if total is not None:
            for k in range(0, len(total), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, min(len(total), k + 50_000))), pa.array(total[k : k + 50_000])], ["at", "v"])

    found = rows.mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(found["at"].max()) + 1 if len(found) else 0)
    out[found["at"].to_numpy(np.int64)] = found["v"].to_numpy()
    return out


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS, seed: int = 7) -> Model | None:
    """None if no document has a label. Null labels and labels of ids that no document has are ignored."""
    spark = documents.sparkSession
    ship(spark)
    own = labels_of(labels, id_col, label_col)
    n = own.count()
    if n > max_rows:
        own = own.where(F.expr(f"pmod(xxhash64(label_id), 1000000) < {int(1_000_000 * max_rows / n)}"))
    # at most about max_rows ids and labels, so that no text is shuffled
    joined = id_text(documents, id_col, text_col).join(F.broadcast(own), F.col("id") == F.col("label_id")).select(F.col("text"), F.col("y"), F.expr("pmod(xxhash64(id, 1), 5) = 0").alias("held"))

    def measure(batches):
        for b in batches:
            if b.num_rows:
                x = _batch_statistics(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "y", "held"])

    # the scan keeps its tasks; what it leaves, some 200 bytes for each labelled row of the fit, goes to a few that sum it
    table = joined.mapInArrow(measure, "x array<double>, y double, held boolean").repartition(max(1, -(-min(n, max_rows) // FIT_ROWS) * 2)).persist()
    try:
        k = len(STATISTICS)
        moments = _sums(table.select("x", "y"), lambda x, y: np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0)]))
        if not len(moments) or moments[0] == 0:
            return None
        mean = moments[1 : k + 1] / moments[0]
        spread = np.sqrt(np.maximum(moments[k + 1 :] / moments[0] - mean**2, 0))
        rng = np.random.default_rng(seed)
        model = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(k, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
        d = FEATURES + 1

        def normal(x, y):
            z = model.features(x)
            return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

        part = table.where("not held").select("x", "y")
        sums = _sums(part, normal)
        if not len(sums):
            part = table.select("x", "y")
            sums = _sums(part, normal)
        gram = sums[: d * d].reshape(d, d) + RIDGE * sums[-1] * np.diag([0.0, *[1.0 / FEATURES] * FEATURES]) + 1e-9 * np.eye(d)
        model.weights = np.linalg.solve(gram, sums[d * d : d * d + d])

        def counts(x, y):
            at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

        seen = _sums(table.where("held").select("x", "y"), counts)
        if not len(seen) or seen[:BINS].sum() == 0:
            seen = _sums(table.select("x", "y"), counts)
        full = np.flatnonzero(seen[:BINS])
        model.at = (full + 0.5) / BINS * 2 - 0.5
        model.rate = isotonic(seen[BINS:][full] / seen[:BINS][full], seen[:BINS][full])
        return model
    finally:
        table.unpersist()


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, with_statistics: bool = False) -> DataFrame:
    """id, score and predicted (1 if score >= cut) of every whole text; null is empty; without a model scores are 0.5."""
    kind = documents.schema[id_col].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch):
            x = _batch_statistics(batch.column(1))
            s = sent.value.score(x) if sent.value is not None else np.full(len(x), 0.5)
            cols = [batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))]
            if with_statistics:
                cols.append(pa.array(x.tolist(), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, ["id", "score", "predicted", "statistics"][: len(cols)])

        return step

    schema = f"id {kind}, score double, predicted int" + ", statistics array<double>" * with_statistics
    return map_arrow(id_text(documents, id_col, text_col), make, schema).withColumnRenamed("id", id_col)
