"""What the text operators share: shipping the package, Arrow views, hashing of words and shingles.

Conventions of every operator in this subpackage:

* it selects the columns that it needs by name, so further columns, whatever they are called, cannot clash;
* a null text counts as the empty text; a null id stays null in the result;
* each input row gives one result row, so repeated rows give repeated results;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy operators work on at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 19

_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch at most, which bounds what a task holds of long texts in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def ship(spark: SparkSession) -> None:
    """Give the executors this package through Spark's own file server, once for each application, and bound Arrow batches."""
    sc = spark.sparkContext
    for key, most in BATCH.items():
        now = spark.conf.get(key, None) or ""
        if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= most):
            spark.conf.set(key, str(most))
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(top):  # runs from an archive that was shipped already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kinweave"), "kinweave_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that a task has freed back to the system: Spark keeps Python workers for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a per-task state: make() is called once a task and returns the batch function."""
    ship(df.sparkSession)

    def run(batches):
        step = b = None
        try:
            for b in batches:
                if b.num_rows:
                    step = step or make()
                    yield from step(b)
        finally:
            step = b = None  # noqa: F841  caches and the last batch go before the release
            release()

    return df.mapInArrow(run, schema)


def id_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The id and the text (null: empty) under fixed names, and the further columns named."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls, without a copy of the text."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows and `limit` bytes in the column at `text`, or of one row."""
    column = batch.column(text).cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    for i, j in row_chunks(off, limit):
        for k in range(i, j, rows):
            yield batch.slice(k, min(rows, j - k))


def mod_crc(id_col: str, by: int):
    """crc32 of the id as text, modulo `by`; null where the id is."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def labels_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label for each id: the mean of its non-null labels, 1 where it is at least one half."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("label_id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("double").alias("y"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out, size = np.ones(1, np.uint64), 1
        while size < n:
            out = np.concatenate([out, out * np.uint64(pow(base, size, 1 << 64))])
            size *= 2
        _powers[str(base)] = have = out
    return have[:n]


#: White space of a word's border: space and U+0009 to U+000D.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run of texts (A-Z lower-cased), and the number of words in each text.

    `off` has the borders of the texts in `data`, from off[0] on; a border also ends a word.
    """
    base = int(off[0])
    raw = data[base : int(off[-1])]
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    blank = gap[raw]
    first = ~blank
    last = first.copy()
    cut = np.asarray(off[1:-1] - base)
    cut = cut[(cut > 0) & (cut < n)]
    keep = first[cut]
    first[1:] &= blank[:-1]
    first[cut] = keep
    ends = blank.copy()
    ends[:-1] = blank[1:]
    ends[-1] = True
    ends[cut - 1] = True
    last &= ends
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    part = np.empty(n + 1, np.uint64)
    part[0] = 0
    np.cumsum(_BYTE_KEYS[_LOWER[raw]] * _power(_BASE, n), out=part[1:])
    words = mix64((part[stop] - part[start]) * _power(_BASE_INV, n)[start] + (stop - start).astype(np.uint64))
    return words, np.diff(np.searchsorted(start, np.asarray(off) - base))


_SHINGLE_KEYS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, one after another, and their number in each text.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    words, counts = word_hashes(data, off)
    begin = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= k:
        full[: n - k + 1] = words[: n - k + 1] * _SHINGLE_KEYS[0]
        for i in range(1, k):
            full[: n - k + 1] += words[i : n - k + 1 + i] * _SHINGLE_KEYS[i]
    full = mix64(full)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, c) in enumerate(zip(begin[:-1].tolist(), counts.tolist(), strict=True)):
        if c >= k:
            s = np.sort(full[a : a + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif c:
            s = mix64(np.sum(words[a : a + c] * _SHINGLE_KEYS[:c], keepdims=True) + np.uint64(c))
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
