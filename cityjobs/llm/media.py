"""Media columns: WAV files of 8-bit samples and spectral-peak fingerprints.

A payload is stored as mono 8-bit samples in a WAV file and read back by the wave module. Short-time Fourier
transforms of the samples give the strongest local peaks of each frame; a peak is paired with the strongest peaks of
the next frames, and the pairs (two frequencies and their distance) are kept in an array with their times. In payloads
of up to SOME frames of 576 samples, which give few pairs or none, they are joined by those of frames of 64.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import utf8

FRAME, HOP, RATE = 576, 288, 8000
PEAKS, AHEAD, BLOCK = 3, 3, 2048
SHORT, STEP, SPREAD, IS_SHORT, SOME = 64, 32, 576, 128, 8
FLOOR, DIGITS = 1e-3, 4  # far below any peak of whole samples, far above rounding, so that no peak is one of rounding


def store(payload: bytes) -> bytes:
    """A WAV file, one sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def peaks(samples: np.ndarray, frame: int = FRAME, hop: int = HOP, points: int | None = None) -> np.ndarray:
    """Frequency bins of the PEAKS strongest local maxima of each frame, strongest first; -1 where there are fewer."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    window, out = np.hanning(frame), []
    for lo in range(0, len(frames), BLOCK):
        size = np.round(np.abs(np.fft.rfft((frames[lo : lo + BLOCK] - 128.0) * window, points, axis=1)), DIGITS)
        inner = size[:, 1:-1]
        inner = np.where((inner > size[:, :-2]) & (inner >= size[:, 2:]) & (inner > FLOOR), inner, 0.0)
        found = np.zeros((len(inner), PEAKS), np.int32)
        rows = np.arange(len(inner))
        for k in range(PEAKS):
            best = inner.argmax(1)
            found[:, k] = np.where(inner[rows, best] > 0, best + 1, -1)
            inner[rows, best] = 0
        out.append(found)
    return np.concatenate(out)


def pairs(found: np.ndarray, within: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): every peak with the strongest peak of each of the next AHEAD frames, or of its own one too, in order of time."""
    times, codes = [], []
    for d in range(0 if within else 1, AHEAD + 1):
        left, right = found[: max(0, len(found) - d)], np.repeat(found[d:, :1], PEAKS, axis=1)
        good = (left >= 0) & (right >= 0)
        at = np.repeat(np.arange(len(left))[:, None], PEAKS, axis=1)[good]
        times.append(at)
        codes.append((left[good].astype(np.int64) << 20) | (right[good].astype(np.int64) << 8) | d)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order]


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of frames of 576 samples, and of short ones too in a payload of up to SOME of those; times in steps
    of 32 samples; codes of short frames have IS_SHORT set.

    Half a short frame of silence on both sides gives the first and the last samples weight. For short frames the
    samples of 255, which no UTF-8 text has, are silence too: the jump to the padding would outweigh a few letters.
    Their transforms are of SPREAD points, and their peaks are paired with the strongest one of their own frame too.
    """
    times, codes = pairs(peaks(samples))
    if len(samples) > SOME * FRAME:
        return times * (HOP // STEP), codes
    silence = np.full(SHORT // 2, 128, np.uint8)
    text = np.where(samples == 255, np.uint8(128), samples)
    near, fine = pairs(peaks(np.concatenate([silence, text, silence]), SHORT, STEP, SPREAD), within=True)
    t, c = np.concatenate([times * (HOP // STEP), near]), np.concatenate([codes, fine | IS_SHORT])
    order = np.lexsort((c, t))
    return t[order], c[order]


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, wav, pair_times, pair_codes) of every whole text, a row for each row.

    Null texts count as empty: 576 bytes of padding and no pairs. Repeated rows get equal rows, an empty table none;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                wav = store(padded(text))
                times, codes = landmarks(np.frombuffer(read(wav), np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([wav], pa.binary()), pa.array([times], pa.list_(pa.int32())), pa.array([codes], pa.list_(pa.int64()))],
                    names=["doc_id", "n_bytes", "wav", "pair_times", "pair_codes"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, wav binary, pair_times array<int>, pair_codes array<long>")


def digest(text: bytes) -> tuple:
    wav = store(padded(text))
    payload = read(wav)
    times, codes = landmarks(np.frombuffer(payload, np.uint8))
    key = xxhash.xxh64(times.astype("<i4").tobytes())
    key.update(codes.astype("<i8").tobytes())
    feature = f"frames={len(payload) // HOP - 1};pairs={len(times)};xxh64={key.hexdigest()}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, times, codes


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_codes array<long>"
KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def digests(docs: DataFrame) -> DataFrame:
    """What media() makes of each whole text, as sizes, digests and pairs; one pass, nothing kept but the current batch.

    Rows as in media(): one for each row, null texts as empty, equal texts with equal values, none for an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in COLUMNS.split(", ")))
        for batch in batches:
            found = list(zip(*map(digest, utf8(batch.column(1))))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, KINDS[k]) for k, x in zip(kinds, found))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {COLUMNS}")
