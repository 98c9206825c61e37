"""Audio features of byte payloads.

A payload is kept losslessly as 8-bit mono WAV. Features come from the bytes read back: polyphase resampling from RATE to
OUT_RATE, overlapped log-mel frames, and energy segmentation with hysteresis. Frames are stored in tensors of the fixed
shape (FRAMES, MELS), an Arrow extension array, with a time span for each tensor and those of the active stretches, as an
Arrow stream; the summary is made from the stream read back. A payload's features depend on its bytes alone.

Of one payload the samples, the resampled signal and the frames are held, about 12 bytes a byte of text; spectra are made in
blocks of BLOCK tensors, and rows go out at OUT_BYTES of tensors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import table

UNIT, PAD, RATE, UP, DOWN = 576, 255, 16_000, 3, 4
OUT_RATE = RATE * UP // DOWN
SIZE, HOP, FFT, MELS, FRAMES, BLOCK, OUT_BYTES = 300, 120, 512, 32, 16, 256, 2 << 20


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit unsigned mono PCM file."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _phases(up: int, down: int, half: int = 10) -> list[np.ndarray]:
    """The low-pass filter's taps for each phase of the output."""
    m = max(up, down)
    n = np.arange(-half * m, half * m + 1)
    h = np.sinc(n / m) / m * np.kaiser(len(n), 5.0) * up
    return [h[p::up].astype(np.float32) for p in range(up)]


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, half: int = 10) -> np.ndarray:
    """Polyphase resampling: each output sample takes only the taps of its phase; edges see zeros."""
    taps, m = _phases(up, down, half), half * max(up, down)
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    for r in range(up):  # outputs r, r + up, ... share a phase and step through the input by `down`
        k = np.arange(r, n, up)
        if not len(k):
            continue
        centre = r * down + m
        phase, last = centre % up, centre // up
        h = taps[phase]
        padded = np.concatenate([np.zeros(len(h), np.float32), x, np.zeros(len(h) + down, np.float32)])
        acc = np.zeros(len(k), np.float32)
        for i, c in enumerate(h):
            start = last - i + len(h)
            acc += c * padded[start : start + (len(k) - 1) * down + 1 : down]
        out[r::up] = acc
    return out


@cache
def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) of y, one frame at least; the end is padded with zeros."""
    n = max(1, 1 + -(-max(0, len(y) - SIZE) // HOP))
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + SIZE - len(y)), np.float32)])
    view, window, out = np.lib.stride_tricks.sliding_window_view(y, SIZE)[::HOP], np.hanning(SIZE).astype(np.float32), np.empty((n, MELS), np.float32)
    step = BLOCK * FRAMES
    for i in range(0, n, step):
        power = np.abs(np.fft.rfft(view[i : min(n, i + step)] * window, FFT)) ** 2
        out[i : i + step] = np.log(power.astype(np.float32) @ _mel_bank() + 1e-6)
    return out


def segments(mel: np.ndarray, high: float = 0.5, low: float = 0.0) -> list[tuple[int, int]]:
    """Frames (first, end) of active stretches: they begin where the energy exceeds its mean by `high` deviations and last until it falls under `low`."""
    e = mel.mean(axis=1, dtype=np.float64)
    sd = e.std()
    if sd < 1e-9:
        return []
    z = (e - e.mean()) / sd
    mark = np.where(z > high, 1, np.where(z < low, 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    flips = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[float, float]]]:
    """Tensors (n, FRAMES, MELS), active segments in frames, and each tensor's time span in seconds."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    x -= 128.0
    x /= 128.0
    mel = log_mel(resample(x))
    n = -(-len(mel) // FRAMES)
    full = np.concatenate([mel, np.zeros((n * FRAMES - len(mel), MELS), np.float32)]).reshape(n, FRAMES, MELS)
    spans = [(i * FRAMES * HOP / OUT_RATE, min(len(mel), (i + 1) * FRAMES) * HOP / OUT_RATE) for i in range(n)]
    return full, segments(mel), spans


def tensor_array(tensors: np.ndarray) -> pa.ExtensionArray:
    """Arrow's fixed-shape tensors of (n, FRAMES, MELS)."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


_STORED = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), ("start_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.list_(pa.list_(pa.float64(), 2)))])


def store(tensors: np.ndarray, active: list[tuple[int, int]], spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream: a row for each tensor, its time span, and the spans of the active stretches (cut at its ends), in seconds."""
    parts: list[list] = [[] for _ in spans]
    for a, e in active:
        for i in range(a // FRAMES, (e - 1) // FRAMES + 1):
            parts[i].append([max(a, i * FRAMES) * HOP / OUT_RATE, min(e, (i + 1) * FRAMES) * HOP / OUT_RATE])
    columns = [tensor_array(tensors), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans]), pa.array(parts, _STORED.field("active").type)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=_STORED))
    return sink.getvalue().to_pybytes()


def restore(stored: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[float, float]]]:
    """What store was given; active stretches that meet at a tensor's end are one."""
    rows = pa.ipc.open_stream(stored).read_all().combine_chunks()
    tensors = rows.column("tensor").chunk(0).to_numpy_ndarray()
    active: list[tuple[int, int]] = []
    for part in rows.column("active").to_pylist():
        for a, e in ((round(x * OUT_RATE / HOP) for x in s) for s in part):
            if active and active[-1][1] == a:
                a = active.pop()[0]
            active.append((a, e))
    return tensors, active, list(zip(rows.column("start_s").to_pylist(), rows.column("end_s").to_pylist(), strict=True))


def summary(tensors: np.ndarray, active: list[tuple[int, int]], spans: list[tuple[float, float]]) -> str:
    frames = int(round(spans[-1][1] * OUT_RATE / HOP))
    rows = tensors.reshape(-1, MELS)[:frames].astype(np.float64)
    on = sum(b - a for a, b in active)
    means = ",".join(f"{v:.2f}" for v in rows.reshape(len(rows), 8, -1).mean(axis=(0, 2)))
    return f"frames={frames};tensors={len(spans)};segments={len(active)};active={on};mel={means};sd={rows.std():.2f}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary"
_NAMES = _DIGEST.replace(",", "").split()[::2]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
    for batch in batches:
        rows, size = [], 0
        for d, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or b""
            media = to_wav(payload_of(text))
            back = from_wav(media)
            stored = store(*features(back))
            rows.append((d.as_py(), len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), summary(*restore(stored)), stored))
            size += len(stored)
            if size >= OUT_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)


def audio_digests(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: digests of payload and media, the summary, and the tensors as an Arrow stream (see store).

    Null and empty texts are one unit of padding; null ids stay; repeated rows give equal rows; extra columns are ignored."""
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_digests, _DIGEST)


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, stored in zip(batch.column(0), batch.column(1), strict=True):
            t, active, spans = restore(stored.as_py())
            on = np.zeros(len(t) * FRAMES, bool)
            for a, b in active:
                on[a:b] = True
            n = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans]), pa.array(on.reshape(n, FRAMES).sum(axis=1), pa.int32()), pa.array(list(t.reshape(n, -1)), pa.list_(pa.float32()))], names=["doc_id", "tensor", "start_s", "end_s", "active", "mel"])


def audio_tensors(documents: DataFrame) -> DataFrame:
    """doc_id, tensor, start_s, end_s, active (frames), mel: a row for each stored tensor, as a Spark list of FRAMES * MELS values in row order."""
    return audio_digests(documents).select("doc_id", "tensors").mapInArrow(_tensors, "doc_id long, tensor int, start_s double, end_s double, active int, mel array<float>")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(table(spark, sf_dir, "documents"))
