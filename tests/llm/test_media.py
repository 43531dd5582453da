import hashlib
import zlib

import numpy as np

from colloquy.llm import media

ODD = [(1, None), (2, ""), (3, "x" * 192), (4, "x" * 193), (5, "é😀" * 300), (6, "the same"), (6, "the same"), (7, "the same"), (None, "z"), (8, "abc " * 200000)]


def test_payloads_come_back(make):
    got = media.media_columns(make(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    for d, t in ODD:
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = by_id[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded)) and r["payload_bytes"] % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        wav = media.to_wav(padded)
        assert wav[:4] == b"RIFF" and media.from_wav(wav) == padded
        assert r["media_bytes"] == len(wav) and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
    a, b = (by_id[k] for k in (6, 7))
    assert (a["times"], a["codes"]) == (b["times"], b["codes"])
    assert media.media_columns(make([])).count() == 0


def slow_peaks(samples):
    """Frame by frame."""
    x = samples.astype(np.float32) - 128
    x = np.pad(x, (0, max(0, media.FRAME - len(x))))
    out = []
    for t in range(1 + (len(x) - media.FRAME) // media.HOP):
        spectrum = np.abs(np.fft.rfft(x[t * media.HOP : t * media.HOP + media.FRAME] * np.hanning(media.FRAME).astype(np.float32)))
        level = spectrum[2:].mean() + 1e-9
        for lo, hi in media.BANDS:
            best = lo + int(spectrum[lo:hi].argmax())
            if spectrum[best] >= media.STANDOUT * level:
                out.append((t, best))
    return sorted(out)


def test_peaks_of_a_tone_and_of_text():
    tone = (128 + 60 * np.sin(2 * np.pi * 20 * np.arange(4096) / media.FRAME)).astype(np.uint8)
    t, f, n = media.peaks(tone)
    assert n == 31 and set(f[f >= 8].tolist()) == {20} or 20 in f.tolist()
    for samples in (tone, np.frombuffer(media.pad(b"some words and more of them, again " * 90), np.uint8)):
        t, f, _ = media.peaks(samples)
        assert list(zip(t.tolist(), f.tolist(), strict=True)) == slow_peaks(samples)


def test_long_signals_in_blocks(monkeypatch):
    samples = np.frombuffer(media.pad(b"words in a row, and others; " * 900), np.uint8)
    whole = media.peaks(samples)
    monkeypatch.setattr(media, "CHUNK_FRAMES", 7)
    parts = media.peaks(samples)
    assert whole[2] == parts[2] and (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_pairs():
    t, f = np.array([0, 0, 1, 5, 90]), np.array([3, 9, 4, 7, 8])
    times, codes = media.pair_peaks(t, f)
    got = {(int(a), int(c) >> 14, (int(c) >> 7) & 127, int(c) & 127) for a, c in zip(times, codes, strict=True)}
    assert got == {(0, 3, 4, 1), (0, 3, 7, 5), (0, 9, 4, 1), (0, 9, 7, 5), (1, 4, 7, 4)}


def test_last_samples_are_in_a_frame():
    assert [len(media.whole_frames(np.zeros(n, np.uint8))) for n in (0, 192, 256, 576, 640)] == [256, 256, 256, 640, 640]
    # texts that differ only in the 64 samples that no full frame covers
    told = [media.describe("ab " * 170 + "  " + end) for end in ("a~" * 32, " " * 64)]
    assert [t[1] for t in told] == [576, 576] and [t[6] for t in told] == [4, 4]
    assert told[0][7:8] + tuple(told[0][9].tolist()) != told[1][7:8] + tuple(told[1][9].tolist())


def test_every_peak_is_paired_with_peaks_of_later_frames():
    t, f = np.array([0, 0, 0, 0, 1, 2]), np.array([3, 20, 40, 70, 5, 6])
    times, codes = media.pair_peaks(t, f)
    got = sorted(zip(times.tolist(), (codes >> 14).tolist(), ((codes >> 7) & 127).tolist(), (codes & 127).tolist(), strict=True))
    assert got == sorted([(0, a, b, g) for a in (3, 20, 40, 70) for b, g in ((5, 1), (6, 2))] + [(1, 5, 6, 1)])
    assert all(len(x) == 0 for x in media.pair_peaks(t[:0], f[:0]))
