"""Benchmark decontamination through an FM-index of each shard of the documents.

A shard is a run of documents of about SHARD_BYTES. Words that no benchmark text has cannot be part of a match, so the index covers
the runs of other words, as numbers, each run ended by a mark. Test phrases (windows of `window` consecutive words, or
all words of a shorter text) are searched backwards, all at once, with ranks from a wavelet tree of the
Burrows-Wheeler transform; occurrences are located by walking to the nearest sampled suffix position; what they cover is
merged into spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import id_text, map_arrow, slices, word_hashes

#: Suffix positions that are multiples of this are kept.
SAMPLE = 8
#: Rows and bytes of a shard at most, or one row; phrases that are searched for at once.
SHARD_ROWS, SHARD_BYTES, PHRASES = 2000, 1 << 20, 1 << 16
#: Words are runs of these bytes once A-Z are lower-cased: digits, a-z and whatever is not ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if _WORD[c] else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletTree:
    """Level by level: the bits of the symbols from the highest on, each level sorted stably by the bit above."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for b in self.bits:
            bit = symbols >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(before), before
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            one = (symbol >> b & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Symbol 0 ends a run and the whole; each 0 is a symbol of its own, less than all words."""
    ends = symbols == 0
    n, n_ends = len(symbols), int(ends.sum())
    rank = symbols.astype(np.int64) + n_ends
    rank[ends] = np.arange(n_ends)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        """symbols: runs of 1 .. sigma - 1, each run ended by 0."""
        sa = suffix_array(symbols)
        self.n = len(symbols)
        self.bwt = symbols[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.tree = WaveletTree(self.bwt, sigma)
        # the start of a run is sampled too, so that no walk passes an end
        self.sampled = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.positions = np.where(self.sampled, sa, -1)[self.sampled]
        self.order = np.cumsum(self.sampled) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase; phrases: one in a row, of equal lengths."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live], high[live] = self.step(c, low[live]), self.step(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            there = self.sampled[rows[live]]
            hit = live[there]
            out[hit] = self.positions[self.order[rows[hit]]] + walked[hit]
            live = live[~there]
            rows[live] = self.step(self.bwt[rows[live]], rows[live])
            walked[live] += 1
        return out


class Phrases:
    """The windows of a block of benchmark texts, as places in one array of word numbers, with the items that have them.

    A window takes under 50 bytes here: its words are gathered from the array when it is searched for.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [(text or "").encode() for _, text in items]
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, counts = word_hashes(np.frombuffer(b"".join(texts), np.uint8), off, ~_WORD)
        self.vocabulary, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.tokens = (number + 1).astype(np.int32)
        words = [w for t in texts for w in words_of(t)]
        own = [words[i] for i in first.tolist()]
        self.word_bytes, self.word_off = b"".join(own), np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int64)
        self.names = sorted({item for (item, _), c in zip(items, counts.tolist(), strict=True) if c})
        at = {x: i for i, x in enumerate(self.names)}
        item_of = np.array([at.get(item, -1) for item, _ in items], np.int64)
        begin = np.cumsum(counts) - counts
        length = np.minimum(counts, window)
        each = np.where(counts > 0, counts - length + 1, 0)  # windows of each text
        start = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin, each)
        of, size = np.repeat(item_of, each), np.repeat(length, each)
        self.groups = []  # (length, starts of distinct phrases, borders of their items, their items)
        for n in np.unique(size).tolist():
            mine = size == n
            places, owners = start[mine], of[mine]
            rank = self._same(places, n)
            pairs = np.unique(rank * np.int64(max(1, len(self.names))) + owners)
            phrase, member = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))
            k = int(rank.max()) + 1
            one = np.zeros(k, np.int32)
            one[rank] = places
            self.groups.append((n, one, np.searchsorted(phrase, np.arange(k + 1)).astype(np.int32), member.astype(np.int32)))
        self.least = self.groups[0][0] if self.groups else 0

    def _same(self, places: np.ndarray, n: int) -> np.ndarray:
        """A number for each phrase that starts at a place, the same for equal phrases: ranks of halves, joined."""
        rank = self.tokens[places].astype(np.int64)
        for k in range(1, n):
            key = rank * np.int64(len(self.vocabulary) + 1) + self.tokens[places + k]
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        return np.unique(rank, return_inverse=True)[1] if n == 1 else rank

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for a word that no text of the block has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def word(self, number: int) -> bytes:
        return self.word_bytes[self.word_off[number - 1] : self.word_off[number]]


def _runs(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of known words within a text that are long enough for a phrase."""
    known = ids > 0
    new = np.ones(len(ids), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = known.copy()
    first[1:] &= ~known[:-1] | new[1:]
    last = known.copy()
    last[:-1] &= ~known[1:] | new[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= least
    return a[long], b[long]


def _found(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word lies in an occurrence of a phrase, and the distinct pairs doc * number of names + item."""
    hit, none = np.zeros(len(ids), bool), np.zeros(0, np.int64)
    a, b = _runs(ids, doc, phrases.least)
    if not len(a):
        return hit, none
    lengths = b - a + 1
    starts = np.cumsum(lengths) - lengths
    source = np.arange(int(lengths.sum())) - np.repeat(starts - a, lengths)  # the word that each symbol stands for
    symbols = ids[np.minimum(source, len(ids) - 1)]
    symbols[starts + lengths - 1] = 0
    index = FMIndex(symbols, len(phrases.vocabulary) + 1)
    here = np.bincount(symbols, minlength=len(phrases.vocabulary) + 1) > 0
    cover = np.zeros(len(symbols) + 1, np.int64)
    pairs, names = [none], len(phrases.names)
    for length, places, borders, members in phrases.groups:
        for k in range(0, len(places), PHRASES):
            which = np.arange(k, min(len(places), k + PHRASES))
            for j in range(length):  # phrases with a word that the shard lacks need no search
                which = which[here[phrases.tokens[places[which] + j]]]
            if not len(which):
                continue
            low, high = index.search(phrases.tokens[places[which][:, None] + np.arange(length)].astype(np.int64))
            times = high - low
            which = np.repeat(which, times)
            if not len(which):
                continue
            at = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times))
            cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + length, minlength=len(cover))
            both = np.unique(doc[source[at]] * np.int64(len(places)) + which)
            of, which = both // len(places), both % len(places)
            own = (borders[which + 1] - borders[which]).astype(np.int64)
            member = members[np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(borders[which], own)]
            pairs.append(np.unique(np.repeat(of, own) * np.int64(names) + member))
    covered = np.cumsum(cover[:-1]) > 0
    hit[source[covered]] = True
    return hit, np.unique(np.concatenate(pairs))


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its number of words, the merged spans of words that phrases cover, the items found.

    Words are compared by 64-bit hashes; those within a match are then compared themselves, so that the result is exact.
    """
    n = len(texts)
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes, counts = word_hashes(np.frombuffer(b"".join(texts), np.uint8), off, ~_WORD)
    doc = np.repeat(np.arange(n), counts)
    if not phrases.groups or not len(hashes):
        return counts.tolist(), spans, items
    ids = phrases.numbers(hashes)
    begin = np.cumsum(counts) - counts
    while True:
        hit, pairs = _found(ids, doc, phrases)
        wrong = []
        for d in np.unique(doc[hit]).tolist():
            words, a = words_of(texts[d]), int(begin[d])
            wrong += [a + i for i in np.flatnonzero(hit[a : a + len(words)]).tolist() if words[i] != phrases.word(int(ids[a + i]))]
        if not wrong:
            break
        ids[wrong] = 0  # another word of the same hash
    for x in pairs.tolist():
        items[x // len(phrases.names)].append(phrases.names[x % len(phrases.names)])
    first = hit.copy()
    first[1:] &= ~hit[:-1] | (doc[1:] != doc[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (doc[1:] != doc[:-1])
    for s, e in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
        d = int(doc[s])
        spans[d].append((s - int(begin[d]), e - int(begin[d])))
    return counts.tolist(), spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, and without what stands between the words of a span."""
    word = _WORD[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))).reshape(-1, 2)
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : edge[s, 0]])
        at = int(edge[e - 1, 1])
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast phrases of the benchmark, which is read once; the driver holds one partition and one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    known = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null")
    out, block, size = [], [], 0
    for row in known.toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"]) + 16
        if size >= block_bytes:
            out.append(sc.broadcast(Phrases(block, window)))
            block, size = [], 0
    return [*out, sc.broadcast(Phrases(block, window))] if block or not out else out


def _searcher(blocks: list):
    """Search of a shard in every block; of several blocks a task has one in memory at a time."""
    kept = blocks[0].value if len(blocks) == 1 else None

    def search(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        if kept is not None:
            return search_shard(texts, kept)
        counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for b in blocks:
            counts, more, new = search_shard(texts, b.value)
            b.__dict__.pop("_value", None)  # read again from its file for the next shard
            spans = [merged(x + y) for x, y in zip(spans, more, strict=True)]
            for x, y in zip(items, new, strict=True):
                x.update(y)
        return counts, spans, [sorted(x) for x in items]

    return search


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """id, n_words, spans (array of start and end in words, end exclusive) and items (sorted) of every document.

    The benchmark goes to the executors in blocks of about `block_bytes` of text; every shard is searched for one block
    after another in the same task, so a larger benchmark needs more time, not more memory. Documents and items without
    words match nothing; null is empty; items of null id are ignored; the rows of a repeated item_id make one item.
    """
    base = id_text(documents, id_col, text_col)
    kind = documents.schema[id_col].dataType.simpleString()
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def make():
        search = _searcher(blocks)

        def step(batch):
            for part in slices(batch, 1, SHARD_ROWS, SHARD_BYTES):
                counts, spans, items = search([x.encode() for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(counts, pa.int64()), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span_type),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ], ["id", "n_words", "spans", "items"])

        return step

    return map_arrow(base, make, f"id {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>").withColumnRenamed("id", id_col)


def remove(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """documents with the benchmark passages cut out of their texts; texts of which no word is left go.

    Documents without a passage stay as they are, empty and null ones too. Search and cut are one step of a task.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    i = documents.columns.index(text_col)
    base = documents.toDF(*names)
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)

    def make():
        search = _searcher(blocks)

        def step(batch):
            for part in slices(batch, i, SHARD_ROWS, SHARD_BYTES):
                old = part.column(i).to_pylist()
                raw = [(x or "").encode() for x in old]
                spans = search(raw)[1]
                new = [without(r, s).decode() if s else t for t, r, s in zip(old, raw, spans, strict=True)]
                keep = pa.array([not s or bool(words_of(t.encode())) for t, s in zip(new, spans, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([(pa.array(new, pa.string()) if k == i else c).filter(keep) for k, c in enumerate(part.columns)], names)

        return step

    return map_arrow(base, make, base.schema).toDF(*documents.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What op5 returns of find()'s result."""
    return found.select(
        id_col,
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])), F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
