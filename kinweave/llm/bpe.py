"""Byte-level BPE encoding and decoding by the ranks of a tokenizer file.

Each match of the pattern is encoded separately. Distinct pieces go into padded matrices, one for each length class;
in every round each row merges its leftmost pair of least rank, pairs are looked up in an open-addressed hash table,
and rows that have no pair left leave the matrix. Pieces of over LONG_PIECE bytes, for which rounds over a matrix
would take quadratic time, merge in the same order through a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinweave.llm.common import id_text, map_arrow, slices

NONE = np.int32(2**31 - 1)
#: The letters, numbers and white space below U+0250, where `re` with these classes splits as `regex` does, but faster.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
FURTHER = re.compile("[^\x00-ɏ]").search
#: Bytes from which a piece goes through the heap.
LONG_PIECE = 256
#: Pieces whose ids a task remembers.
CACHE_PIECES = 60_000
#: Cells of one matrix at most.
CELLS = 1 << 18


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines() if isinstance(lines, bytes) else lines)}


class PairTable:
    """(left id, right id) -> id of the merged token, with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(k)
        while len(k):  # of those that want a free slot the first gets it, the others probe on
            free = self.keys[slot] == -1
            _, one = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.values[slot[won]] = k[won], v[won]
            left = np.ones(len(k), bool)
            left[won] = False
            k, v, slot = k[left], v[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge; a negative id is padding."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        out = np.full(len(key), NONE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(key[at])
        while len(at):
            found = self.keys[slot]
            hit = found == key[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs, self.split_any = PairTable(ranks), regex.compile(pattern).findall
        classes = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{S}{L}{N}]").replace(r"\p{L}", f"[{L}]").replace(r"\p{N}", f"[{N}]").replace(r"\s", f"[{S}]").replace(r"\S", f"[^{S}]")
        self.split_latin = re.compile(classes).findall if r"\p" not in classes else self.split_any
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ranks = ranks
        self.cache: dict[str, tuple] = {}

    def split(self, text: str) -> list[str]:
        return (self.split_any if FURTHER(text) else self.split_latin)(text)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > LONG_PIECE:
                out[i] = self.merge_long(p)
            elif p:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()) if len(p) > 12 else len(p), []).append(i)
        for width, rows in classes.items():
            for k in range(0, len(rows), step := max(1, CELLS // width)):
                self._merge_class([pieces[i] for i in rows[k : k + step]], rows[k : k + step], width, out)
        return out

    def _merge_class(self, pieces: list[bytes], rows: list[int], width: int, out: list[list[int]]) -> None:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], np.int32(-1))
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        row = np.array(rows)
        while True:
            best = rank.argmin(axis=1)  # the first, that is the leftmost, of equal ranks
            new = np.take_along_axis(rank, best[:, None], 1)[:, 0]
            done = new == NONE
            if done.any():
                for i, x in zip(row[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = [t for t in x if t >= 0]
                on = ~done
                ids, rank, row, best, new = ids[on], rank[on], row[on], best[on], new[on]
            if not len(row):
                return
            at = np.arange(len(row))
            ids[at, best] = new
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)  # the right half of the pair goes
            if ids.shape[1] == 1:
                for i, x in zip(row.tolist(), ids[:, 0].tolist(), strict=True):
                    out[i] = [x]
                return
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            left = best > 0
            rank[at[left], best[left] - 1] = self.pairs(ids[at[left], best[left] - 1], new[left])
            right = best < ids.shape[1] - 1
            rank[at[right], best[right]] = self.pairs(new[right], ids[at[right], best[right] + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        ids, after, before = ids.tolist(), list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        bytes_of, ranks = self.bytes_of, self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (m := ranks.get(bytes_of[ids[x]] + bytes_of[ids[y]])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(cache))
        cache.update(zip(new, map(tuple, self.merge([p.encode() for p in new])), strict=True))
        get = cache.__getitem__
        return [list(chain.from_iterable(map(get, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(documents: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>, if with_ids), ids_sha256 and decoded_sha256 of every whole text.

    `tokenizer` is the path of a rank file; the driver reads it (under 1 MB) and sends it with the tasks. Null and empty
    texts have no ids and the digests of no bytes. One row in, one row out.
    """
    with open(tokenizer, "rb") as f:
        lines = f.read()
    sent = documents.sparkSession.sparkContext.broadcast(lines)
    kind = documents.schema[id_col].dataType.simpleString()

    def make():
        codec = Codec(parse_ranks(sent.value), pattern)

        def step(batch):
            for part in slices(batch, 1):
                coded = codec.encode(part.column(1).to_pylist())
                text_of = codec.text_of
                cols = [
                    part.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(",".join([text_of[t] for t in x]).encode()).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(coded, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

        return step

    return map_arrow(id_text(documents, id_col, text_col), make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The bytes of each row's ids as a binary column beside the others; null ids give null."""
    with open(tokenizer, "rb") as f:
        lines = f.read()
    sent = encoded.sparkSession.sparkContext.broadcast(lines)
    from pyspark.sql import functions as F

    from kinweave.llm.common import ship

    ship(encoded.sparkSession)
    state: dict[str, list[bytes]] = {}

    @F.pandas_udf("binary")
    def back(ids):
        if "t" not in state:
            ranks = parse_ranks(sent.value)
            state["t"] = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                state["t"][rank] = token
        get = state["t"].__getitem__
        return ids.map(lambda x: None if x is None else b"".join(map(get, x)))

    back.__annotations__ = {}
    return encoded.withColumn(out_col, back(F.col(ids_col)))
