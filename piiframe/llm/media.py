"""Media columns: 8-bit mono WAV, short-time Fourier transform, spectral-peak fingerprints.

Samples are stored as a WAV by the wave module and read back by it.  Frames of 256 samples
(Hann window, every 128) give magnitudes; peaks are local maxima in time and frequency over
the frame's mean level; each peak is paired with peaks that follow closely, and a pair's
two frequencies, distance and time make one time-coded entry of the fingerprint.

Defined results: null texts count as empty, and the payload is always a positive multiple of
64 bytes; frames of one steady level have no peaks, so a fingerprint can be empty.
Equal payloads give equal values.  A null doc_id is kept.  Only doc_id and the text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes

RATE = 8000
BLOCK = 64
FRAME, HOP = 256, 128
#: A peak tops its neighbours of so many frames and bins, and this many times its frame's mean.
NEAR_FRAMES, NEAR_BINS, OVER_MEAN = 2, 4, 2.0
#: A peak is paired with the next FAN peaks that start 1 to SOON frames later.
FAN, SOON = 3, 16
#: Frames that are transformed at once.
SPAN = 4096


def padded(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def spectrum(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Magnitudes of frames first to last - 1, over zero-centred samples; a frame that the
    samples do not fill is filled with silence."""
    low, high = first * HOP, (last - 1) * HOP + FRAME
    part = np.zeros(high - low, np.float32)
    own = samples[low:high]
    part[: len(own)] = own.astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    frames = frames - frames.mean(1, keepdims=True)
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)


def _top(level: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Running maximum over `reach` places to either side."""
    out = level.copy()
    n = level.shape[axis]
    for d in range(1, min(reach, n - 1) + 1):
        a, b = [slice(None)] * 2, [slice(None)] * 2
        a[axis], b[axis] = slice(d, None), slice(None, n - d)
        np.maximum(out[tuple(a)], level[tuple(b)], out=out[tuple(a)])
        np.maximum(out[tuple(b)], level[tuple(a)], out=out[tuple(b)])
    return out


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak, by frame and then bin; spans of frames overlap, so
    that where they are cut does not matter."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for at in range(0, n, SPAN):
        low, high = max(0, at - NEAR_FRAMES), min(n, at + SPAN + NEAR_FRAMES)
        level = spectrum(samples, low, high)[:, 1:]  # the constant part is gone
        mean = level.mean(1, keepdims=True)
        loud = (level > OVER_MEAN * mean) & (level > 1.0)
        peak = loud & (level == _top(_top(level, NEAR_BINS, 1), NEAR_FRAMES, 0))
        t, f = np.nonzero(peak[at - low : at - low + min(SPAN, n - at)])
        times.append(t + at)
        bins.append(f + 1)
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded pairs: time << 32 | first bin << 16 | second bin << 8 | distance, in order."""
    out = []
    after = np.searchsorted(times, times, side="right")
    for k in range(FAN):
        j = after + k
        ok = np.flatnonzero(j < len(times))
        ok = ok[times[j[ok]] - times[ok] <= SOON]
        gap = times[j[ok]] - times[ok]
        out.append((times[ok] << 32) | (bins[ok] << 16) | (bins[j[ok]] << 8) | gap)
    return np.sort(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def features(payload: bytes) -> np.ndarray:
    return pairs(*peaks(np.frombuffer(payload, np.uint8)))


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long, pairs array<long>, media binary"


def columns(docs: DataFrame, text: str = "text", keep: bool = True) -> DataFrame:
    """One row per document: digests, the fingerprint as the time-coded array `pairs` (its SHA-256
    is `feature`), and the WAV itself as `media` (null unless keep)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = store(padded(data))
                back = read(media)
                found = features(back)
                rows.append((doc, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(found.astype("<i8").tobytes()).hexdigest(), len(found), found, media if keep else None))
            schema = pa.schema([(n, t) for n, t in zip(names, types)])
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], schema=schema)

    small_batches(docs.sparkSession)
    names, kinds = zip(*[x.split() for x in COLUMNS.split(", ")])
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[k] for k in kinds]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, COLUMNS)
