"""Media columns: texts as 8-bit sound, and features of sound.

A payload is stored without loss as a one-channel 8-bit WAVE file and read back. Its features: polyphase resampling,
log-mel filterbanks over overlapped frames, and segments by energy with hysteresis. Each segment's filterbank, averaged
to a fixed number of steps, is a tensor of one fixed shape with the segment's time span. The stored form carries them: a
chunk `arrw` of the file holds an Arrow stream of start, end and a fixed-shape tensor, which readers of sound pass over.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import id_text, map_arrow, slices

RATE = 16_000
#: Resampling factor UP / DOWN (16 kHz to 12 kHz), and filter taps for each phase.
UP, DOWN, TAPS = 3, 4, 24
FRAME, HOP, MELS, STEPS = 256, 128, 16, 4
#: Shape of a segment's tensor.
SHAPE = (STEPS, MELS)
#: Frames that are transformed at once, so that a long text needs no more memory.
BLOCK = 4096
PAD = 64


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(PAD - len(text) % PAD if len(text) % PAD or not text else 0)


def to_wave(samples: bytes, rate: int = RATE, segments: bytes = b"") -> bytes:
    """An 8-bit one-channel WAVE file; segments: an Arrow stream that goes into a chunk of its own."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    more = struct.pack("<4sI", b"arrw", len(segments)) + segments + b"\0" * (len(segments) % 2) if segments else b""
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data) + len(more), b"WAVE") + fmt + data + more


def _chunks(media: bytes):
    """Name, start and size of each chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit one-channel WAVE file."""
    rate = 0
    for name, at, size in _chunks(media):
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit one-channel PCM")
        elif name == b"data":
            return media[at : at + size], rate
    raise ValueError("no data chunk")


def segments_of(media: bytes) -> pa.Table:
    """start, end (seconds) and logmel (a fixed-shape tensor) of the segments that a stored file carries; none: no rows."""
    for name, at, size in _chunks(media):
        if name == b"arrw":
            return pa.ipc.open_stream(pa.py_buffer(media)[at : at + size]).read_all()
    return _segment_schema().empty_table()


@functools.lru_cache
def _segment_schema() -> pa.Schema:
    return pa.schema([("start", pa.float64()), ("end", pa.float64()), ("logmel", pa.fixed_shape_tensor(pa.float32(), SHAPE))])


def segment_stream(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """The Arrow stream of segments; no bytes for none."""
    if not len(spans):
        return b""
    schema, sink = _segment_schema(), pa.BufferOutputStream()
    logmel = pa.ExtensionArray.from_storage(schema.field("logmel").type, pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), STEPS * MELS))
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans[:, 0])), pa.array(np.ascontiguousarray(spans[:, 1])), logmel], schema=schema))
    return sink.getvalue().to_pybytes()


@functools.lru_cache
def _filter() -> np.ndarray:
    """A windowed-sinc low-pass filter at the lower of both rates, scaled to unit gain in each phase."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * np.hamming(n)
    return (h / h.sum() * UP).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """By UP / DOWN: each output phase has its own part of the filter and reads every DOWN-th input."""
    h, n = _filter(), -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    ends = np.lib.stride_tricks.sliding_window_view(padded, TAPS)  # row i: the inputs up to i
    out = np.empty(n, np.float32)
    for first in range(min(UP, n)):
        at, phase = divmod(first * DOWN, UP)
        taps, count = np.ascontiguousarray(h[phase::UP][::-1]), len(out[first::UP])
        for k in range(0, count, BLOCK):
            out[first + k * UP :: UP][:BLOCK] = ends[at + k * DOWN :: DOWN][: min(BLOCK, count - k)] @ taps
    return out


@functools.lru_cache
def _mel() -> np.ndarray:
    """Triangles over the power spectrum, evenly spaced on the mel scale."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@functools.lru_cache
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log filterbank (frames x MELS) and energy in decibels of each frame; a short end is filled with silence."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, FRAME + HOP * (n - 1) - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    bank, power = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, BLOCK):
        part = frames[i : i + BLOCK]
        spectrum = np.fft.rfft(part * _window(), axis=1)
        spectrum = spectrum.real**2 + spectrum.imag**2
        bank[i : i + BLOCK] = np.log(spectrum @ _mel() + 1e-6)
        power[i : i + BLOCK] = np.einsum("ij,ij->i", part, part)
    return bank, 10 * np.log10(power / FRAME + 1e-9)


def segments(energy: np.ndarray, above: float = 0.5, below: float = 0.5) -> np.ndarray:
    """Frame ranges [start, end): open where the energy passes mean + above * deviation, closed under mean - below * deviation."""
    mean, spread = float(energy.mean()), float(energy.std())
    event = np.where(energy > mean + above * spread, 1, np.where(energy < mean - below * spread, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[last] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def analyse(samples: bytes) -> dict:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    bank, energy = log_mel(resample(x))
    spans = segments(energy)
    tensors = np.empty((len(spans), *SHAPE), np.float32)
    for t, (a, b) in zip(tensors, spans.tolist(), strict=True):
        edges = a + (b - a) * np.arange(STEPS + 1) // STEPS
        for k in range(STEPS):
            t[k] = bank[min(edges[k], b - 1) : max(edges[k] + 1, edges[k + 1])].mean(axis=0)
    seconds = HOP * DOWN / (UP * RATE)
    return {"frames": len(bank), "mean": bank.mean(axis=0), "spans": spans * seconds, "tensors": tensors}


def feature_text(found: dict) -> str:
    spans = found["spans"]
    voiced = float((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0.0
    return f"{found['frames']};{len(spans)};{voiced:.3f};" + ",".join(f"{v + 0.0:.2f}" for v in found["mean"])


def describe(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, with_segments: bool = False) -> DataFrame:
    """One row for each document: sizes and digests of payload and media, and a feature text.

    The media is a WAVE file that carries its segments. with_media adds its bytes, with_segments the segments as a column
    (start, end in seconds; logmel: a tensor of SHAPE, row by row). Null and empty texts are 64 zero bytes. All of a row comes from its own text alone, so equal texts have
    equal values.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * with_media + ", segments array<struct<start:double,end:double,logmel:array<float>>>" * with_segments

    def make():
        def step(batch):
            for part in slices(batch, 1):
                rows = []
                for text in part.column(1):
                    raw = text.as_py().encode()
                    back, _ = from_wave(to_wave(payload(raw)))
                    found = analyse(back)
                    media = to_wave(back, segments=segment_stream(found["spans"], found["tensors"]))
                    back, _ = from_wave(media)
                    row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(found)]
                    row += [media] if with_media else []
                    row += [[{"start": a, "end": b, "logmel": t.ravel().tolist()} for (a, b), t in zip(found["spans"].tolist(), found["tensors"], strict=True)]] if with_segments else []
                    rows.append(row)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                types += [pa.binary()] * with_media + [pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("logmel", pa.list_(pa.float32()))]))] * with_segments
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [*names, *["media"] * with_media, *["segments"] * with_segments])

        return step

    return map_arrow(id_text(documents, id_col, text_col), make, schema).withColumnRenamed("id", id_col)


def segment_rows(described: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each segment of describe(..., with_segments=True)."""
    return described.selectExpr(f"`{id_col}`", "inline(segments)")


def tensor_table(rows: pa.Table) -> pa.Table:
    """An Arrow table of segment_rows() with `logmel` as fixed-shape tensors."""
    flat = rows.column("logmel").combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    values = flat.flatten() if len(flat) else pa.array([], pa.float32())
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, STEPS * MELS))
    return rows.set_column(rows.column_names.index("logmel"), pa.field("logmel", kind), tensors)
