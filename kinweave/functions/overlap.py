"""Weighted overlaps of many token sets at once: the best partners of each entity within two blocks of records.

Tokens are 64-bit codes. An entity's rare tokens are counted over their postings. The tokens that many records have stand in
0-1 matrices and weigh little, so most targets can't reach the last of the best even with all of them; those that can are
summed whole. What is left out by this bound is no best pair, and the sums that come out are exact.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Bytes of a matrix; matches that are counted at once.
DENSE, MATCHES = 1 << 25, 1 << 20
#: Share of the pairs that have a token from which it stands in a matrix.
SHARE = 0.003
#: Width of the scores' last place, twice and half as much again: what is this near the last place is kept for the ranking.
NEAR = 3e-6
#: Share of the targets from which on more tokens are counted before the rest is summed whole.
MANY = 0.05


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, each from its start on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists without nulls."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    off = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return off - off[0], values


def plain(parts: list[pa.Table]) -> pa.Table:
    """The rows of all parts, lists without dictionaries; no parts give no rows."""
    out = []
    for part in parts:
        columns = []
        for column in part.columns:
            if pa.types.is_list(column.type):
                column = column.combine_chunks()
                column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
                column = pa.ListArray.from_arrays(column.offsets, column.values.dictionary_decode())
            columns.append(column)
        out.append(pa.Table.from_arrays(columns, names=part.column_names))
    return pa.concat_tables(out) if out else pa.table({})


def weighed(parts: list[pa.Table], weights: list[list[pa.Table]]) -> pa.Table:
    """s1 and for each channel c t<c> and w<c>, of parts with s1 and t<c>: tokens without a weight go, rows of one s1 are one.

    weights: for each channel parts with token and w.
    """
    rows = plain(parts)
    if not len(rows):
        return rows
    rows = rows.sort_by("s1")
    s1, first = np.unique(rows.column("s1").to_numpy(), return_index=True)
    columns = {"s1": pa.array(s1)}
    for c, known in enumerate(weights):
        tokens, w = (np.concatenate([k.column(n).to_numpy() for k in known]) if known else np.zeros(0, t) for n, t in (("token", np.int64), ("w", np.float64)))
        order = np.argsort(tokens)
        tokens, w = tokens[order], w[order]
        off, values = _lists(rows.column(f"t{c}"))
        at = np.minimum(np.searchsorted(tokens, values), max(len(tokens) - 1, 0)).astype(np.int32)
        there = tokens[at] == values if len(tokens) else np.zeros(len(values), bool)
        ends = np.concatenate([[0], np.cumsum(there)])[off]
        ends = pa.array(np.concatenate([ends[first], ends[-1:]]), pa.int32())
        columns |= {f"t{c}": pa.ListArray.from_arrays(ends, pa.array(values[there])), f"w{c}": pa.ListArray.from_arrays(ends, pa.array(w[at[there]]) if len(tokens) else pa.array([], pa.float64()))}
    return pa.table(columns)


class Own:
    """One kind of tokens of a block of entities: its vocabulary in order, and the place there of each entity's tokens."""

    def __init__(self, off: np.ndarray, tokens: np.ndarray, weights: np.ndarray):
        """weights: of each token, negative for common ones."""
        self.off = off
        self.vocab, first, ids = np.unique(tokens, return_index=True, return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.weight, self.common = np.abs(weights[first]), weights[first] < 0
        self.uses = np.bincount(self.ids, minlength=len(self.vocab))


class Channel:
    """One kind of tokens of a block of entities (with weights, negative for common tokens) and of a block of targets."""

    def __init__(self, entities: tuple[np.ndarray, np.ndarray] | Own, weights: np.ndarray | None, targets: tuple[np.ndarray, np.ndarray], place: np.ndarray):
        """entities, targets: (offsets, tokens) of each row; place: the target of each row, as one may have several rows."""
        own = entities if isinstance(entities, Own) else Own(*entities, weights)
        self.off, self.ids, self.weight, self.common, vocab = own.off, own.ids, own.weight, own.common, own.vocab
        toff, ttokens = targets
        self.width, rows = int(place[-1]) + 1, len(self.off) - 1
        at, known = np.zeros(len(ttokens), np.int32), np.zeros(len(ttokens), bool)
        for lo in range(0, len(ttokens) if len(vocab) else 0, MATCHES):
            piece = slice(lo, lo + MATCHES)
            at[piece] = np.minimum(np.searchsorted(vocab, ttokens[piece]), len(vocab) - 1)
            known[piece] = vocab[at[piece]] == ttokens[piece]
        ends, upto, some = np.cumsum(known), np.zeros(len(toff), np.int64), toff > 0
        upto[some] = ends[toff[some] - 1]
        del ends
        owner = np.repeat(place.astype(np.int32), np.diff(upto))
        #: ids of the targets' tokens, row by row
        self.their_ids = at[known]
        self.their_off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.width))]).astype(np.int64)
        # by token, then by target; these have as many numbers as the targets have tokens, so few are in memory at a time
        del at, known
        order = self.their_ids.astype(np.int64)
        order *= self.width
        order += owner
        del owner
        order.sort()
        order %= self.width
        self.postings = order.astype(np.int32)
        del order
        self.times = np.bincount(self.their_ids, minlength=len(vocab)).astype(np.int64)
        self.starts = np.cumsum(self.times) - self.times
        # the tokens that most pairs have are columns of a matrix, a row for each target
        share = self.times.astype(np.float64) * own.uses / max(self.width * rows, 1)
        dense = np.argsort(-share)[: DENSE // max(self.width, 1)]
        dense = dense[share[dense] > SHARE]
        self.column = np.full(len(vocab), -1, np.int32)
        self.matrices = {}
        for tier in (False, True):
            mine = dense[self.common[dense] == tier]
            self.column[mine] = np.arange(len(mine))
            matrix = np.zeros((self.width, len(mine)), np.uint8 if len(toff) - 1 == self.width else np.int32)
            for lo in range(0, len(mine), 64):
                some = mine[lo : lo + 64]
                matrix[:, lo : lo + 64] = np.stack([np.bincount(self.postings[x : x + n], minlength=self.width) for x, n in zip(self.starts[some].tolist(), self.times[some].tolist(), strict=True)], axis=1)
            self.matrices[tier] = matrix
        self.kept: tuple[int, dict[bool, np.ndarray]] = (-1, {})

    def _counted(self, ids: np.ndarray, count: bool = False) -> np.ndarray:
        """Weights (or tokens) of these that each target has, counted over the postings."""
        out = np.zeros(self.width)
        starts, times = self.starts[ids], self.times[ids]
        upto, lo = np.cumsum(times), 0
        while lo < len(ids):  # some tokens at a time, so that a long text's matches don't take much memory
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MATCHES, "right")))
            where = np.concatenate([self.postings[x : x + n] for x, n in zip(starts[lo:hi].tolist(), times[lo:hi].tolist(), strict=True)])
            out += np.bincount(where, None if count else np.repeat(self.weight[ids[lo:hi]], times[lo:hi]), self.width)
            lo = hi
        return out

    def _added(self, ids: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, tokens) of these, which stand in the matrices, that each of the targets has."""
        out = np.zeros((len(targets), 2))
        for tier, matrix in self.matrices.items():
            mine = ids[self.common[ids] == tier]
            if len(mine):
                column, w = self.column[mine], np.stack([self.weight[mine], np.ones(len(mine))], axis=1)
                for lo in range(0, len(targets), step := max(1, MATCHES // matrix.shape[1])):
                    out[lo : lo + step] += matrix[targets[lo : lo + step]][:, column] @ w
        return out[:, 0], out[:, 1]

    def _split(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of entity i that are counted, those that stand in the matrices)"""
        ids = self.ids[self.off[i] : self.off[i + 1]]
        dense = self.column[ids] >= 0
        return ids[~dense], ids[dense]

    def _counts(self, i: int, count: bool) -> np.ndarray:
        """_counted() of entity i's counted tokens, kept until another entity is asked for."""
        if self.kept[0] != i:
            self.kept = (i, {})
        known = self.kept[1]
        if count not in known:
            known[count] = self._counted(self._split(i)[0], count)
        return known[count]

    def look_at(self, i: int, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights shared with each of the targets, tokens shared, whether one of these isn't common) of entity i."""
        value, count = self._added(self._split(i)[1], targets)
        value, count = value + self._counts(i, False)[targets], count + self._counts(i, True)[targets]
        made = count > 0
        if self.common.any():
            rare, often = (x[~self.common[x]] for x in self._split(i))
            made = self._counted(rare, True)[targets] + self._added(often, targets)[1] > 0
        return value, count.astype(np.int64), made

    def sums(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights shared with each target, whether a token that isn't common is shared) of entities a to b."""
        found = [self.look_at(i, np.arange(self.width)) for i in range(a, b)]
        return np.stack([f[0] for f in found]), np.stack([f[2] for f in found])

    def best(self, i: int, most: int, least: int, rare: float, floor: float = -np.inf) -> tuple[np.ndarray, ...]:
        """Targets that may be among entity i's `most` best by sum, then place, of those kept, with their look_at().

        floor: a sum that as many targets of other blocks have at least.

        The sums of counted tokens, with all of a few targets' other tokens, give a sum that `most` targets have at least.
        A target that can't reach it with all of the entity's other tokens is out.
        """
        none = np.zeros(0, np.int64)
        if most <= 0:
            return none, np.zeros(0), none, none > 0
        often = self._split(i)[1]
        order = np.argsort(self.times[often], kind="stable")
        often, value = often[order], self._counts(i, False)
        groups, found, last = max(256, 4 * most), None, floor - 2 * NEAR
        # the best of each group are some of the best of all
        if last <= rare + NEAR and self.width > groups:
            some = value[: self.width // groups * groups].reshape(-1, groups).argmax(axis=0) * groups + np.arange(groups)
            whole = value[some] + self._added(often, some)[0]
            if self.common.any():
                made = self.look_at(i, some)[2]
                some, whole = some[made], whole[made]
            if len(some) >= most:
                last = max(last, np.partition(whole, len(whole) - most)[len(whole) - most] - 2 * NEAR)
        if last > rare + NEAR:  # no weak one is asked for
            found = np.flatnonzero(value >= last - self.weight[often].sum())
            while len(found) > MANY * self.width and len(often):
                more, often = np.split(often, [len(often) // 2 + 1])
                value = value + self._counted(more)
                found = np.flatnonzero(value >= last - self.weight[often].sum())
            whole = value[found] + self._added(often, found)[0]
            found = found[whole >= last]
        if found is None:
            found = np.arange(self.width)
        return self._ranked(i, found, most, least, rare)

    def _ranked(self, i: int, found: np.ndarray, most: int, least: int, rare: float) -> tuple[np.ndarray, ...]:
        """best() of the targets found; a few more where sums are near."""
        value, count, made = self.look_at(i, found)
        fine = made & (value >= rare - NEAR)
        if np.count_nonzero(made & (value >= rare + NEAR)) < most:  # weak ones count too, if they share enough tokens
            fine |= made & (count >= least)
        kept = np.flatnonzero(fine)
        if len(kept) > most:
            last = np.partition(value[kept], len(kept) - most)[len(kept) - most]
            near = kept[np.abs(value[kept] - last) <= NEAR]
            if len(near) > 2 * most:  # equal sums go by place; a step of the last place either way is left to the ranking
                steps = np.rint(value[near] * 1e6)
                near = np.concatenate([near[steps == s][:most] for s in np.unique(steps)])
            kept = np.sort(np.concatenate([kept[value[kept] > last + NEAR], near]))
        return found[kept], value[kept], count[kept], made[kept]


def best_pairs(entities: pa.Table, targets: pa.Table | Iterable[pa.Table], most: tuple[int, ...], least: int, rare: float) -> pa.Table:
    """s1, cand and for each channel c its score, shared tokens and whether it made the pair.

    entities: s1 and for each channel t<c> (tokens) and w<c>; targets: cand and t<c>, or several blocks of them, of which one
    is in memory at a time; what an entity's best of earlier blocks weigh bounds those of later ones. A pair comes if it may
    be among the best of either channel.
    """
    fields = [("s1", pa.int64()), ("cand", pa.int64()), *[(f"{n}{c}", t) for c in range(len(most)) for n, t in (("score", pa.float64()), ("shared", pa.int64()), ("made", pa.bool_()))]]
    s1, parts = entities.column("s1").to_numpy() if len(entities) else [], []
    mine = [Own(*_lists(entities.column(f"t{c}")), _lists(entities.column(f"w{c}"))[1]) for c in range(len(most))] if len(entities) else []
    del entities
    #: sums of the best so far of each entity and channel
    tops = [np.full((len(s1), max(k, 1)), -np.inf) for k in most]
    for block in [targets] if isinstance(targets, pa.Table) else targets:
        if not len(block) or not len(s1):
            continue
        block = block.sort_by("cand")
        pa.default_memory_pool().release_unused()  # what unpacking took
        cand, place = np.unique(block.column("cand").to_numpy(), return_inverse=True)
        channels = [Channel(own, None, _lists(block.column(f"t{c}")), place) for c, own in enumerate(mine)]
        del block
        for i in range(len(s1)):
            found = [c.best(i, k, least, rare, top[i].min()) for c, k, top in zip(channels, most, tops, strict=True)]
            picks = np.unique(np.concatenate([f[0] for f in found]))
            if not len(picks):
                continue
            columns = []
            for c, top, k, (at, *known) in zip(channels, tops, most, found, strict=True):
                here = np.searchsorted(picks, at)
                rest = np.delete(np.arange(len(picks)), here)
                for x, y in zip(known, c.look_at(i, picks[rest]) if len(rest) else known, strict=True):
                    column = np.empty(len(picks), x.dtype)
                    column[here] = x
                    if len(rest):
                        column[rest] = y
                    columns.append(column)
                if k > 0:
                    both = np.concatenate([top[i], known[0]])
                    top[i] = np.partition(both, len(both) - k)[len(both) - k :]
            parts.append((np.full(len(picks), i), cand[picks], *columns))
        del channels
    at, *columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64), *[[] for _ in fields[1:]]]
    if len(at):  # later blocks may have better ones
        some = np.zeros(len(at), bool)
        for c, (k, top) in enumerate(zip(most, tops, strict=True)):
            value, count, made = columns[3 * c + 1 : 3 * c + 4]
            last = top.min(axis=1)[at]
            good = (k > 0) & made & ((count >= least) | (value >= rare - NEAR)) & (value >= last - NEAR)
            # of equal sums at the last place the first k by target
            near = np.flatnonzero(good & (value <= last + NEAR))
            steps = np.rint(value[near] * 1e6)
            order = np.lexsort((columns[0][near], steps, at[near]))
            new = np.concatenate([[True], (np.diff(at[near][order]) != 0) | (np.diff(steps[order]) != 0)])[: len(order)]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            good[near[order[place >= k]]] = False
            some |= good
        at, columns = at[some], [x[some] for x in columns]
    columns = [np.asarray(s1, np.int64)[at], *columns]
    return pa.table([pa.array(x, t) for x, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))
