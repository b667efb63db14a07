"""Near-duplicates by SetSketch registers, exact in their confirmation.

A document is its set of distinct k-word shingles. A register holds, on an exponentially spaced and truncated scale, the
least of the exponential variates that one hash function gives the shingles; registers of a union are the maxima of the
parts' registers, and those of similar sets are often equal. The steps:

1. documents of equal sets form a class (128-bit digest of the set); each class goes on once;
2. the registers of a class are banded; classes that agree in a band meet in a bucket;
3. every member of a bucket is a candidate with the bucket's least class (its hub), never all pairs;
4. the likelihood of three counts (registers above, below, equal) and the two known sizes estimates the similarity of a
   candidate; those far under the threshold go, the rest are confirmed on their full sets;
5. confirmed links give components; buckets that still hold several components are joined to families. A member can
   link to another component only if that share of its shingles which the threshold asks for is in its family outside its
   own component; the others go, exactly. Those that stay are ordered by size and dealt into blocks, and pairs of blocks
   whose sizes allow the threshold are compared on their full sets.

Hot keys (the hub of a large bucket, the root of a large component) are dealt to several tasks in every join.

So no bucket keeps an unconfirmed pair across components. With 32 bands of 4 registers two sets of similarity 0.8
share no bucket once in 2 * 10^7 times; an estimate that falls short of the slack costs nothing, as step 5 goes without it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinweave.llm.common import buffers, id_text, map_arrow, mix64, release, row_chunks, shingle_sets, slices
from kinweave.llm.shared import dealt_join, forget, hot_keys, hot_of, scratch, small, stored, sweep

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Base of the scale, rate of the variates, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Deviations of the estimate under the threshold up to which a candidate is confirmed.
SLACK = 4.5
#: Shingles that the registers take in at once.
TILE = 1 << 15
#: Members of a block within a family; sets up to which a hash is counted pair by pair; hashes of one matrix product.
BLOCK, FEW, COLUMNS = 1000, 24, 8192
#: Blocks of a family from which copying every set to each of them costs more than first finding the members that can't link.
MANY_BLOCKS = 10

_rng = np.random.default_rng(20_240_601)
_FACTORS = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_LOG_BASE = np.log(BASE)


def registers(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS) of the non-empty sets that stand one after another."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    least = np.full((REGISTERS, len(sizes)), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), TILE):  # a set over a border of tiles is merged from its parts
        part = x[a : a + TILE]
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, a + len(part), "left"))
        at = np.maximum(starts[first:last] - a, 0)
        for i, factor in enumerate(_FACTORS):
            np.minimum(least[i, first:last], np.minimum.reduceat(part * factor, at), out=least[i, first:last])
    variate = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / _LOG_BASE) + TOP // 2, 0, TOP).astype(np.uint16)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set and band."""
    parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48), (len(found), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key ^ (parts[:, :, r] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))))
    return key.astype(np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is above the other's, of the share x that the first has alone."""
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE


def estimate(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Similarity of greatest likelihood of the counts of registers above and below, given the sizes of the sets."""
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.arange(steps + 1) / steps * np.minimum(u / v, v / u)
    up, down = np.maximum(_above(u - v * j), 1e-12), np.maximum(_above(v - u * j), 1e-12)
    like = above[:, None] * np.log(up) + below[:, None] * np.log(down) + (REGISTERS - above - below)[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]


def _cut(threshold: float) -> float:
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _sets(batch, k: int):
    """(first row, row behind the last, sets, sizes) of parts of a batch."""
    data, off = buffers(batch.column(batch.schema.names.index("text")))
    for a, b in row_chunks(off):
        yield a, b, *shingle_sets(data, off[a : b + 1], k)


def _digests(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, whatever its order; None for the empty set."""
    out: list[bytes | None] = [None] * len(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        a = np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts)
        b = np.add.reduceat(mix64(sets + np.uint64(0x632BE59BD9B4E019)), starts)
        for i, x in zip(full.tolist(), np.column_stack([mix64(a), mix64(b)]), strict=True):
            out[i] = x.astype(">u8").tobytes()
    return out


def sketch(documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (size of the set), sig (its digest, null if empty), regs (its registers) and keys (of its bands)."""
    kind = documents.schema[id_col].dataType.simpleString()

    def make():
        def step(batch):
            for a, b, sets, sizes in _sets(batch, k):
                full = sizes > 0
                regs = registers(sets, sizes[full]) if full.any() else np.zeros((0, REGISTERS), np.uint16)
                keys = band_keys(regs)
                place = np.cumsum(full) - 1
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(_digests(sets, sizes), pa.binary()),
                    pa.array([regs[p].tobytes() if f else None for p, f in zip(place.tolist(), full.tolist(), strict=True)], pa.binary()),
                    pa.array([keys[p] if f else None for p, f in zip(place.tolist(), full.tolist(), strict=True)], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "sig", "regs", "keys"])

        return step

    return map_arrow(id_text(documents, id_col, text_col), make, f"id {kind}, n long, sig binary, regs binary, keys array<long>")


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of digests those whose sizes and estimate allow the threshold."""
    own = sketches.select("sig", "n", "regs")
    both = dealt_join(pairs, own.selectExpr("sig as a", "n as n_a", "regs as r_a"), "a", hot_keys(pairs, "a"), "b").join(own.selectExpr("sig as b", "n as n_b", "regs as r_b"), "b")
    both = both.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    cut = _cut(threshold)

    def make():
        def step(batch):
            r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (4, 5)]
            n = [batch.column(c).to_numpy().astype(np.float64) for c in (2, 3)]
            j = estimate((r[0] > r[1]).sum(axis=1), (r[0] < r[1]).sum(axis=1), *n)
            keep = pa.array(j >= cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        return step

    return map_arrow(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), make, "a binary, b binary")


def _full_sets(documents: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """sig and set (sorted hashes, 8 bytes each) of the classes in pairs, from the text of one document of each."""
    wanted = stored(classes.join(pairs.selectExpr("a as sig").union(pairs.selectExpr("b as sig")).distinct(), "sig").select("sig", "id"))
    chosen = small(wanted.select(F.col("id").alias("wanted_id")).distinct())
    texts = id_text(documents, id_col, text_col)
    texts = texts.join(chosen, texts["id"].eqNullSafe(F.col("wanted_id")), "left_semi")

    def make():
        def step(batch):
            for _, _, sets, sizes in _sets(batch, k):
                ends = np.cumsum(sizes)
                rows = [(d, sets[e - s : e].tobytes()) for d, s, e in zip(_digests(sets, sizes), sizes.tolist(), ends.tolist(), strict=True) if s]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], ["sig", "set"])

        return step

    found = map_arrow(texts.select("id", "text"), make, "sig binary, set binary")
    return found.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those with 100 * |intersection| >= percent * |union|."""
    both = dealt_join(pairs, sets.selectExpr("sig as a", "set as set_a"), "a", hot_keys(pairs, "a"), "b").join(sets.selectExpr("sig as b", "set as set_b"), "b")

    def make():
        def step(batch):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        return step

    return map_arrow(both.select("a", "b", "set_a", "set_b"), make, "a binary, b binary")


def components(links: DataFrame, keep: bool = False) -> DataFrame:
    """node and label (the least node of its component) of every node of links (a, b).

    Rounds of least neighbour labels and pointer jumps, each stored in the shared folder, until none changes.
    """
    edges = stored(links.select("a", "b").union(links.selectExpr("b as a", "a as b")).where("a != b").distinct())
    hot = hot_keys(edges, "b")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as label"))
    while True:
        near = dealt_join(edges, labels.selectExpr("node as b", "label as seen"), "b", hot, "a").groupBy("a").agg(F.min("seen").alias("seen"))
        new = stored(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("new")))
        # of each label in use the label that it has itself by now: as many rows as labels, not as nodes
        jumps = new.select("new").distinct().join(new.select(F.col("node").alias("new"), F.col("new").alias("there")), "new").where("new != there")
        jumps = stored(jumps)
        if jumps.limit(1).count():
            far = dealt_join(new, jumps, "new", hot_keys(new, "new"), "node", "left").select("node", "label", F.coalesce("there", "new").alias("new"))
            new = stored(far)
        changed = new.where("label != new").limit(1).count()
        labels = new.selectExpr("node", "new as label")
        if not changed:
            return stored(labels, keep=True) if keep else labels


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes.

    Hashes that few sets have are counted pair by pair, the others by products of 0-1 matrices, COLUMNS hashes at a time.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    _, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.int64)
    many = times[number] > FEW
    few_n, few_o = number[~many], owner[~many]
    for d in range(1, FEW):
        same = few_n[d:] == few_n[:-d]
        if not same.any():
            break
        out += np.bincount(few_o[:-d][same] * n + few_o[d:][same], minlength=n * n).reshape(n, n)
    out += out.T
    _, column = np.unique(number[many], return_inverse=True)
    row = owner[many]
    for c in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        part = (column >= c) & (column < c + COLUMNS)
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[row[part], column[part] - c] = 1
        out += (matrix @ matrix.T).astype(np.int64)
    return out


def spanning(links: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join what is still apart: labels that a link has joined count as one from then on."""
    label, out = label.copy(), []
    for i in range(len(links)):
        for j in np.flatnonzero(links[i] & (label != label[i])).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Of the members (family, sig, label, set, n) those that may link to another component of their family.

    Two sets of the threshold share that part of either; a shingle that no other component of the family has is not
    shared, so a member with too many of those has no link across components. Members, families and labels are 64-bit
    hashes here; one hash for two members, or for shingles of two families, only keeps more.
    """
    schema = "key long, label long, member long"

    def spread(batch):
        for part in slices(batch, 3, 64):
            for family, label, member, s in zip(*(c.to_pylist() for c in part.columns), strict=True):
                key = mix64(np.frombuffer(s, np.uint64) ^ np.uint64(family & (1 << 64) - 1)).view(np.int64)
                for k in range(0, len(key), 50_000):
                    one = key[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.full(len(one), label)), pa.array(np.full(len(one), member))], ["key", "label", "member"])

    numbered = rows.select(F.xxhash64("family").alias("family"), F.xxhash64("label").alias("label"), F.xxhash64("sig").alias("member"), "set")
    words = stored(map_arrow(numbered, lambda: spread, schema))
    across = words.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    shared = dealt_join(words, across, "key", hot_keys(words, "key", least=50_000), "member").groupBy("member").agg(F.count("*").alias("shared"))
    shared = stored(shared)
    forget(words)
    found = rows.withColumn("member", F.xxhash64("sig")).join(shared, "member")
    return found.where(100 * F.col("shared") >= percent * F.col("n")).select(rows.columns)


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) across components within families; members: family, sig, label; sets: sig, set.

    Members that may have such a link (all of a family of few blocks) are dealt into blocks by size within their family. A pair of blocks whose sizes
    allow the threshold is a task of its own: all pairs are compared on their full sets, in memory, and what comes out is
    no more than a forest over its members.
    """
    rows = stored(members.join(sets, "sig").withColumn("n", (F.octet_length("set") / 8).cast("long")))
    large = stored(rows.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > MANY_BLOCKS * BLOCK).select("family"))
    if large.limit(1).count():  # the result is the same without this
        hot = hot_keys(rows, "family")
        inside = dealt_join(rows, large.withColumn("large", F.lit(True)), "family", hot, "sig", "left")
        inside = stored(inside)
        forget(rows)
        sweep(rows.sparkSession)
        rows = inside.where("large is null").drop("large").unionByName(_possible(inside.where("large").drop("large"), percent))
    rows = stored(_blocked(stored(rows)))
    bounds = stored(rows.groupBy("family", "own").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    low, high = bounds.selectExpr("family", "own as low", "most as low_most"), bounds.selectExpr("family", "own as high", "least as high_least")
    pairs = stored(low.join(high, "family").where((F.col("low") <= F.col("high")) & (100 * F.col("low_most") >= percent * F.col("high_least"))).select("family", "low", "high"))
    ends = pairs.selectExpr("family", "low as own", "low", "high").union(pairs.where("low != high").selectExpr("family", "high as own", "low", "high"))
    rows = rows.join(ends, ["family", "own"]).select("family", "low", "high", "own", "sig", "label", "set")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("sig")
        sig, own = table.column("sig").to_pylist(), table.column("own").to_numpy()
        label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        own_sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in own_sets])
        same = intersections(own_sets)
        links = 100 * same >= percent * (size[:, None] + size - same)
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            links &= own[:, None] != own
        found = spanning(links, label)
        del same, links, own_sets
        release()
        return pa.table({"a": pa.array([sig[i] for i, _ in found], pa.binary()), "b": pa.array([sig[j] for _, j in found], pa.binary())})

    return rows.groupBy("family", "low", "high").applyInArrow(search, "a binary, b binary")


def _blocked(rows: DataFrame) -> DataFrame:
    """rows with own, the block of each member by the size of its set; members of one size that spans several blocks are
    dealt among these by hash."""
    sizes = rows.groupBy("family", "n").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, last = F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.col("m") - 1) / BLOCK)
    placed = stored(sizes.withColumn("before", before).select("family", "n", first.alias("first"), (last - first + 1).alias("parts")))
    joined = dealt_join(rows, placed, ["family", "n"], hot_keys(rows.select("family", "n"), "family", "n"), "sig")
    return joined.withColumn("own", (F.col("first") + F.pmod(F.xxhash64("sig"), F.col("parts"))).cast("int")).drop("first", "parts")


def classes_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketches, members): id, n and sig of every row; sig, component (its least id) of every non-empty class.

    Both are stored; what else is stored on the way is deleted at the end.
    """
    threshold, spark = percent / 100, documents.sparkSession
    with scratch(spark):
        rows = stored(sketch(documents, id_col, text_col, shingle))
        found = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
        classes = stored(found)
        thin = stored(rows.select("id", "n", "sig"), keep=True)  # each wide table goes as soon as its last reader is done
        forget(rows)
        banded = stored(classes.select("sig", F.explode("keys").alias("key")))
        sweep(spark)
        hubs = stored(banded.groupBy("key").agg(F.min("sig").alias("hub"), F.count("*").alias("members")).where("members > 1"))
        crowded = hot_of(hubs, "members", "key")
        shared = stored(dealt_join(banded, hubs.select("key", "hub"), "key", crowded, "sig"))
        forget(banded)
        sweep(spark)
        near = stored(shared.where("sig != hub").selectExpr("hub as a", "sig as b").distinct())
        sweep(spark)
        pairs = stored(_estimated(near, classes, threshold))
        forget(near)
        wide, classes = classes, stored(classes.select("sig", "id"))
        forget(wide)
        sweep(spark)
        sets = stored(_full_sets(documents, classes, pairs, id_col, text_col, shingle))
        sweep(spark)
        links = stored(_confirmed(pairs, sets, percent))
        forget(pairs)
        forget(sets)
        sweep(spark)
        labels = components(links)
        labelled = stored(shared.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "hub", F.coalesce("label", "sig").alias("label")))
        forget(shared)
        sweep(spark)
        mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key"))
        members = stored(dealt_join(labelled, mixed, "key", crowded, "sig").groupBy("sig", "hub").agg(F.first("label").alias("label")))
        forget(labelled)
        sweep(spark)
        if members.limit(1).count():
            families = components(members.selectExpr("hub as a", "sig as b"))
            own = stored(members.groupBy("sig").agg(F.first("label").alias("label")).join(families.selectExpr("node as sig", "label as family"), "sig"))
            sets = stored(_full_sets(documents, classes, own.selectExpr("sig as a", "sig as b"), id_col, text_col, shingle))
            sweep(spark)
            further = stored(_across(own, sets, percent))
            if further.limit(1).count():
                labels = components(links.select("a", "b").union(further))
        nodes = stored(labels)
        hot = hot_keys(nodes, "label")
        least = classes.select("sig", "id").join(nodes.withColumnRenamed("node", "sig"), "sig").groupBy("label").agg(F.min("id").alias("component"))
        linked = dealt_join(nodes, least, "label", hot, "node").select(F.col("node").alias("sig"), "component")
        members = stored(classes.select("sig", "id").join(linked, "sig", "left").select("sig", F.coalesce("component", "id").alias("component")), keep=True)
        return thin, members


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable over links) and kept (id = component_id) of every row.

    Null and empty texts have no shingles and are linked with nothing. Rows of equal id and different texts stand for
    themselves. A null id is passed over as the least; a component of null ids alone has a null component_id.
    """
    rows, members = classes_of(documents, id_col, text_col, shingle, percent)
    full = rows.where("sig is not null")
    joined = dealt_join(full, members, "sig", hot_keys(full, "sig"), "id", "left").select("id", "n", "component").union(rows.where("sig is null").select("id", "n", F.lit(None).cast(members.schema["component"].dataType)))
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: the row of the least id. Rows of null id or without words stay."""
    found = find(documents, id_col, text_col, shingle, percent)
    dropped = stored(found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("dropped_id")).distinct())
    gone = small(dropped)
    return documents.join(gone, documents[id_col] == gone["dropped_id"], "left_anti")
