"""Records packed by the hundred for blocks, and pairs of records compared within two blocks.

A list column keeps each distinct element once for a pack, so a record takes a fraction of its views' bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from kinweave.functions.overlap import ranges

#: Bytes and rows of a batch of compared pairs, about.
BATCH_BYTES, BATCH_ROWS = 1 << 23, 1 << 14


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def pack(table: pa.Table) -> bytes:
    columns = []
    for column in map(_whole, table.columns):
        if pa.types.is_list(column.type):
            off = np.asarray(column.offsets)
            column = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), column.values.slice(off[0], off[-1] - off[0]).dictionary_encode())
        columns.append(column)
    batch = pa.RecordBatch.from_arrays(columns, names=table.column_names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def packer(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch, the keys and the packed rest of the rows that share them."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            at = rows.select(keys).append_column("at", pa.array(np.arange(len(rows)))).group_by(keys).aggregate([("at", "list")])
            for i in range(len(at)):
                payload = pack(rows.drop_columns(keys).take(at.column("at_list")[i].values))
                yield pa.RecordBatch.from_arrays([*[_whole(at.column(k).slice(i, 1)) for k in keys], pa.array([payload], pa.binary())], names=[*keys, "payload"])

    return packs


class Side:
    """The records of a block."""

    def __init__(self, payloads: list[pa.Scalar], notes: list[pa.Scalar] | tuple = (), noted: dict[str, pa.DataType] | None = None):
        """notes: packed tables of code, key and the columns `noted`, which the records of that code and key get."""
        parts = [unpack(p) for p in payloads]
        tables = [unpack(n) for n in notes]
        for c, kind in (noted or {}).items():
            known = {(x, k): v for t in tables for x, k, v in zip(*[t.column(n).to_pylist() for n in ("code", "key", c)], strict=True)}
            parts = [p.append_column(c, pa.array([known.get(x) for x in zip(p.column("code").to_pylist(), p.column("key").to_pylist(), strict=True)], kind)) for p in parts]
        self.parts = parts
        codes = np.concatenate([p.column("code").to_numpy() for p in parts]) if parts else np.zeros(0, np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the records of each code begin in `order`, and how many there are."""
        first = np.searchsorted(self.codes, codes)
        return first, np.searchsorted(self.codes, codes, "right") - first

    def lists(self, column: str, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(sizes of the lists, offsets and places in the vocabulary of their elements, the vocabulary).

        known: the vocabulary; elements that it lacks are left out. Without it, that of these records.
        """
        cols = [_whole(p.column(column)) for p in self.parts]
        words = [c.values.dictionary for c in cols]
        if known is None:
            known = pa.concat_arrays(words).unique()
        narrow = np.uint16 if len(known) < 1 << 16 else np.int32
        sizes, left, ids = [], [], []
        for c, w in zip(cols, words, strict=True):
            place = pa.compute.index_in(w, known).fill_null(-1).to_numpy(zero_copy_only=False)
            off = np.asarray(c.offsets).astype(np.int64)
            at = place[c.values.indices.to_numpy(zero_copy_only=False)[off[0] : off[-1]]] if len(w) else np.zeros(0, np.int32)
            there = at >= 0
            sizes.append(np.diff(off))
            left.append(np.diff(np.concatenate([[0], np.cumsum(there)])[off - off[0]]))
            ids.append(at[there].astype(narrow))
        return np.concatenate(sizes), np.concatenate([[0], np.cumsum(np.concatenate(left))]), np.concatenate(ids), known

    def values(self, column: str) -> Callable[[np.ndarray], pa.Array]:
        """What gives the column of the records at some places."""
        kind = self.parts[0].schema.field(column).type
        if pa.types.is_list(kind):
            _, off, ids, known = self.lists(column)

            def taken(rows: np.ndarray) -> pa.Array:
                sizes = off[rows + 1] - off[rows]
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), known.take(pa.array(ids[ranges(off[rows], sizes)])))

            return taken
        whole = pa.concat_arrays([_whole(p.column(column)) for p in self.parts])
        return lambda rows: whole.take(pa.array(rows))

    def width(self, column: str) -> float:
        """Bytes of the column in a record, about."""
        whole = sum(len(p) for p in self.parts)
        kinds = [p.column(column) for p in self.parts]
        lists = pa.types.is_list(kinds[0].type)
        return sum(len(_whole(k).values) * 12 if lists else k.nbytes for k in kinds) / max(whole, 1)


class Shared:
    """How many elements the sets of two records share, for one kind of sets."""

    def __init__(self, a: Side, b: Side, column: str):
        self.a_size, self.a_off, self.a_ids, known = a.lists(column)
        self.b_size, self.b_off, self.b_ids, _ = b.lists(column, known)
        self.mark = np.zeros(len(known) + 1, bool)

    def counts(self, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
        """ra: records of a, equal ones side by side."""
        out = np.zeros(len(ra), np.int32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ra)) + 1, [len(ra)]])
        sizes = self.b_off[rb + 1] - self.b_off[rb]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            mine = self.a_ids[self.a_off[ra[lo]] : self.a_off[ra[lo] + 1]]
            self.mark[mine] = True
            size = sizes[lo:hi]
            found = np.concatenate([[0], np.cumsum(self.mark[self.b_ids[ranges(self.b_off[rb[lo:hi]], size)]])])
            ends = np.cumsum(size)
            out[lo:hi] = found[ends] - found[ends - size]
            self.mark[mine] = False
        return out


def compare(asked: pa.Table, a: Side, b: Side, sets: list[str], values: list[str], ratios: list[tuple[str, str, Callable]]) -> Iterator[list[tuple[str, pa.Array]]]:
    """Named columns for the pairs (s1, cand) whose records are there, a batch at a time; a pair of several records comes as often."""
    s1, cand = asked.column("s1").to_numpy(), asked.column("cand").to_numpy()
    (fa, na), (fb, nb) = a.places(s1), b.places(cand)
    n = na * nb
    pair = np.repeat(np.arange(len(s1)), n)
    if not len(pair):
        return
    k = ranges(np.zeros(len(n), np.int64), n)
    ra, rb = a.order[fa[pair] + k // nb[pair]], b.order[fb[pair] + k % nb[pair]]
    order = np.argsort(ra, kind="stable")
    pair, ra, rb = pair[order], ra[order], rb[order]
    # one kind of sets is in memory at a time, but for its counts
    counted = []
    for s in sets:
        kind = Shared(a, b, s)
        counted += [(f"a_n_{s}", kind.a_size.astype(np.int32), ra), (f"b_n_{s}", kind.b_size.astype(np.int32), rb), (f"n_{s}", kind.counts(ra, rb), None)]
    texts = dict.fromkeys([*values, *[c for _, c, _ in ratios]])
    wide = sum(a.width(c) + b.width(c) for c in texts)
    step = int(max(1, min(BATCH_ROWS, BATCH_BYTES // max(wide, 1))))
    get = {c: (a.values(c), b.values(c)) for c in texts}
    for lo in range(0, len(pair), step):
        at = slice(lo, lo + step)
        out = [("s1", pa.array(s1[pair[at]])), ("cand", pa.array(cand[pair[at]]))]
        out += [(name, pa.array(x[at] if rows is None else x[rows[at]])) for name, x, rows in counted]
        for c in values:
            out += [(f"a_{c}", get[c][0](ra[at])), (f"b_{c}", get[c][1](rb[at]))]
        for name, c, f in ratios:
            both = list(zip(*[get[c][i](r[at]).fill_null("").to_pylist() for i, r in ((0, ra), (1, rb))], strict=True))
            distinct = list(dict.fromkeys(both))  # repeated pairs of a batch are compared once
            known = dict(zip(distinct, f(distinct), strict=True))
            out.append((name, pa.array([known[p] for p in both], pa.float64())))
        yield out
