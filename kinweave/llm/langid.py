"""Language identification as a mixture of languages.

Byte trigrams, hashed to 2**16 bins, have one distribution for each language. A document is a mixture: expectation-
maximisation estimates the proportions of all languages; then the set of languages is chosen by penalised likelihood
among the nested sets that start with the likeliest single language and grow in order of proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import CHUNK_BYTES, buffers, id_text, map_arrow, row_chunks

BITS = 16
BINS = 1 << BITS
#: Languages of a block of the model (a quarter of a MB each). A task keeps one block in memory; of more blocks it reads one
#: after another, for the bins of a few documents at a time.
BLOCK_LANGUAGES = 128
#: Cells (bins of a run of documents x languages) that inference works on at once, or those of one document.
CELLS = 1 << 22
#: Added to every count.
SMOOTH = 0.1
ROUNDS = 12
#: A further language must raise the log-likelihood by PENALTY * ln(number of trigrams).
PENALTY = 8.0

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}").search


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of a run of texts, none over a border or of blanks only, and the index of each one's text."""
    base = int(off[0])
    b = _FOLD[data[base : int(off[-1])]]
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (code != 0x202020) & (doc[:-2] == doc[2:])
    return (code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BITS), doc[:-2][keep]


def train(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (languages x BINS), from all rows of a non-null language.

    Each task sums its counts for each language, Spark sums those; the driver gets at most languages * BINS sums.
    """
    known = documents.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not names:
        return [], np.zeros((0, BINS), np.float32)
    number = {x: i for i, x in enumerate(names)}

    def count(batches):
        def packed(at, n):
            for k in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(n[k : k + 50_000])], ["at", "n"])

        dense = len(names) <= BLOCK_LANGUAGES
        total = np.zeros(len(names) * BINS if dense else 0, np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            data, off = buffers(batch.column(1))
            for i, j in row_chunks(off):
                bins, doc = trigrams(data, off[i : j + 1])
                key = lang[i:j][doc] * BINS + bins
                if dense:
                    total += np.bincount(key, minlength=len(total))
                else:
                    yield from packed(*np.unique(key, return_counts=True))
        at = np.flatnonzero(total)
        yield from packed(at, total[at])

    from kinweave.llm.common import ship

    ship(documents.sparkSession)
    sums = known.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(len(names) * BINS, SMOOTH, np.float32)
    table[sums["at"].to_numpy(np.int64)] += sums["n"].to_numpy(np.float32)
    table = table.reshape(len(names), BINS)
    np.log(table / table.sum(axis=1, keepdims=True, dtype=np.float64), out=table, casting="same_kind")
    return names, table


def _em(p: np.ndarray, times: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) after ROUNDS rounds from pi, and the log-likelihoods."""
    for _ in range(ROUNDS):
        joint = p * pi.T[:, doc]
        joint *= times / joint.sum(axis=0)
        pi = (np.add.reduceat(joint, starts, axis=1) / total).T
    mix = np.einsum("kg,gk->g", p, pi[doc])
    return pi, np.add.reduceat(times * np.log(mix), starts)


def infer(bins: np.ndarray, doc: np.ndarray, n_docs: int, k: int, columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: the main language (-1: no trigram), the proportions of all, the chosen set (as booleans).

    columns(bins): log-probabilities of the k languages (languages x bins). Where one language is chosen, the proportions
    are those of the mixture of all.
    """
    best, share, chosen = np.full(n_docs, -1), np.zeros((n_docs, k)), np.zeros((n_docs, k), bool)
    if not len(bins) or not k:
        return best, share, chosen
    key, times = np.unique(doc * np.int64(BINS) + bins, return_counts=True)
    g, d = key & (BINS - 1), key >> BITS
    starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    docs = d[starts]
    local = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(d))))
    times = times.astype(np.float64)
    total = np.add.reduceat(times, starts)
    log_p = columns(g)
    single = np.add.reduceat(log_p * times, starts, axis=1).T
    p = np.exp(log_p)
    del log_p
    pi, full = _em(p, times, starts, local, total, np.full((len(docs), k), 1 / k))
    top = single.argmax(axis=1)
    share[docs] = pi
    chosen[docs, top] = True
    best[docs] = top
    cost = PENALTY * np.log(total + 1)
    # no set is likelier than all languages together, so only these documents can gain by a second language
    for i in np.flatnonzero(full - single[np.arange(len(docs)), top] > cost).tolist():
        s, e = starts[i], starts[i + 1] if i + 1 < len(docs) else len(d)
        order = [top[i], *(x for x in np.argsort(-pi[i], kind="stable") if x != top[i])]
        score, own, mine = single[i, top[i]], pi[i], 1
        for m in range(2, k + 1):
            part = np.zeros((1, k))
            part[0, order[:m]] = 1 / m
            q, like = _em(p[:, s:e], times[s:e], np.zeros(1, np.int64), np.zeros(e - s, np.int64), total[i : i + 1], part)
            if like[0] - cost[i] * (m - 1) > score:
                score, own, mine = like[0] - cost[i] * (m - 1), q[0], m
        chosen[docs[i]] = False
        chosen[docs[i], order[:mine]] = True
        share[docs[i]] = own
        best[docs[i]] = int(own.argmax()) if mine > 1 else top[i]
    return best, share, chosen


def predict(documents: DataFrame, names: list[str], log_p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", with_mixture: bool = False) -> DataFrame:
    """id, lang_pred and score (the share of lang_pred); with_mixture adds the chosen languages with their shares.

    `und` with score 0 where the text is null, has no letter or there is no model; a text too short for a trigram gets
    the first language with score 1 / number of languages. Any number of languages will do.
    """
    sc = documents.sparkSession.sparkContext
    blocks = [sc.broadcast(log_p[i : i + BLOCK_LANGUAGES].astype(np.float32)) for i in range(0, len(names), BLOCK_LANGUAGES)]
    sent = sc.broadcast(list(names))
    kind = documents.schema[id_col].dataType.simpleString()

    def make():
        langs = sent.value
        kept = blocks[0].value if len(blocks) == 1 else None

        def columns(g):
            if kept is not None:
                return kept[:, g].astype(np.float64)
            parts = []
            for b in blocks:
                parts.append(b.value[:, g].astype(np.float64))
                b.__dict__.pop("_value", None)  # read again from its file when next needed
            return np.concatenate(parts)

        def step(batch):
            data, off = buffers(batch.column(1))
            for i, j in row_chunks(off, min(CHUNK_BYTES, max(1, CELLS // max(1, len(langs))))):
                bins, doc = trigrams(data, off[i : j + 1])
                best, share, chosen = infer(bins, doc, j - i, len(langs), columns)
                letter = [bool(langs) and _LETTER(t) is not None for t in batch.column(1).slice(i, j - i).to_pylist()]
                pred = [langs[max(b, 0)] if ok else "und" for b, ok in zip(best.tolist(), letter, strict=True)]
                score = [(min(1.0, float(s[b])) if b >= 0 else 1 / len(langs)) if ok else 0.0 for b, s, ok in zip(best.tolist(), share, letter, strict=True)]
                cols = [batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if with_mixture:
                    mix = [[(langs[x], float(s[x])) for x in np.flatnonzero(c)] if ok else [] for s, c, ok in zip(share, chosen, letter, strict=True)]
                    cols.append(pa.array(mix, pa.map_(pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays(cols, ["id", "lang_pred", "score", "mixture"][: len(cols)])

        return step

    schema = f"id {kind}, lang_pred string, score double" + ", mixture map<string,double>" * with_mixture
    return map_arrow(id_text(documents, id_col, text_col), make, schema).withColumnRenamed("id", id_col)
