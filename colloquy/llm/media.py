"""Media columns: texts stored as WAV, spectra, and fingerprints of spectral-peak pairs.

A payload is the UTF-8 text, filled up with spaces to a positive multiple of 192 bytes, kept as 8-bit
mono samples of a WAV file.  The file is read back by ``wave``; its short-time Fourier transform has
one strongest bin per band and frame; peaks that stand out are paired with the next ones.  Each pair is a code of
(first band bin, second band bin, distance in frames) at the frame of its first peak.

Cases: null text is empty; every payload has samples, so every row has a fingerprint, which may have
no pair; equal texts have equal values whatever batch they come in; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import map_texts

BLOCK, RATE = 192, 8000
FRAME, HOP = 256, 128
BANDS = ((2, 8), (8, 20), (20, 48), (48, 128))
FAN_OUT, MAX_GAP, STANDOUT = 3, 32, 2.0
CHUNK_FRAMES = 4096
COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames long, n_peaks long, times array<int>, codes array<int>"
)


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def whole_frames(samples: np.ndarray) -> np.ndarray:
    """Samples with silence behind them, so that the last ones are in a frame, too."""
    return np.pad(samples, (0, max(FRAME - len(samples), -(len(samples) - FRAME) % HOP)), constant_values=128)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames and bins of spectral peaks, in frame order, and the number of frames.

    Frames are taken in blocks, so that memory stays bounded for long signals.
    """
    x = samples.astype(np.float32) - np.float32(128)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    n_frames = 1 + (len(x) - FRAME) // HOP
    window = np.hanning(FRAME).astype(np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    found_t, found_f = [], []
    for at in range(0, n_frames, CHUNK_FRAMES):
        spectrum = np.abs(np.fft.rfft(view[at : at + CHUNK_FRAMES] * window, axis=1))
        level = spectrum[:, 2:].mean(axis=1) + 1e-9
        for lo, hi in BANDS:
            best = lo + spectrum[:, lo:hi].argmax(axis=1)
            strong = np.flatnonzero(spectrum[np.arange(len(best)), best] >= STANDOUT * level)
            found_t.append(strong + at)
            found_f.append(best[strong])
    t, f = np.concatenate(found_t), np.concatenate(found_f)
    order = np.lexsort((f, t))
    return t[order], f[order], n_frames


def pair_peaks(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of peak pairs and the frames of their first peaks: each peak with the next FAN_OUT ones of later frames."""
    times, codes = [], []
    later = np.searchsorted(t, t, side="right")
    for k in range(FAN_OUT):
        near = np.flatnonzero(later + k < len(t))
        near = near[t[later[near] + k] - t[near] <= MAX_GAP]
        other = later[near] + k
        times.append(t[near])
        codes.append((f[near] << 14) | (f[other] << 7) | (t[other] - t[near]))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def describe(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    media = to_wav(pad(data))
    back = from_wav(media)
    t, f, n_frames = peaks(whole_frames(np.frombuffer(back, np.uint8)))
    times, codes = pair_peaks(t, f)
    return (
        len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
        n_frames, len(t), times, codes,
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Media facts and time-coded fingerprint of every document: doc_id and COLUMNS."""

    def told(texts: list) -> tuple[None, list[list]]:
        return None, [list(c) for c in zip(*map(describe, texts), strict=True)] if texts else [[]] * len(COLUMNS.split(", "))

    return map_texts(docs, lambda: told, COLUMNS, keep=["doc_id"])


def feature_digest() -> Column:
    """Frames, peaks, pairs and a digest of the time-coded array."""
    listed = F.array_join(F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"].cast("string"), p["codes"].cast("string"))), ",")
    return F.concat_ws(";", F.col("n_frames").cast("string"), F.col("n_peaks").cast("string"), F.size("codes").cast("string"), F.md5(listed.cast("binary")))
