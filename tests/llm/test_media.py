"""Media: exact round trips, sizes and digests, and fingerprints that follow the content."""

from __future__ import annotations

import hashlib
import io
import math
import struct
import wave
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs

from brindle.llm.common import documents
from brindle.llm.media import FRAME, UNIT, from_wav, media_columns, pairs, payload_of, peaks, to_wav

TEXTS = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 500, "long text " * 20_000]


@settings(max_examples=50, deadline=None)
@given(hs.binary(max_size=2000))
def test_round_trip(data):
    payload = payload_of(data)
    assert len(payload) % UNIT == 0 and len(payload) > 0 and payload.rstrip(b" ") == data.rstrip(b" ")
    assert from_wav(to_wav(payload)) == payload


def check(rows, texts):
    for r, text in zip(rows, texts):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])


def test_cases(spark):
    df = spark.createDataFrame([(i, t, b"m", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary, times int")
    rows = sorted(media_columns(df, with_media=True).collect(), key=lambda r: r.doc_id)
    check(rows, TEXTS)
    for r in rows:
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, r.payload_bytes)
        assert list(r.times) == sorted(r.times) and len(r.times) == len(r.codes)
    assert rows[0].feature == rows[1].feature
    assert media_columns(df.limit(0)).collect() == []


def test_whole_small_table(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in media_columns(documents(spark, sf_dir)).collect()}
    check([rows[i] for i, _ in texts], [t for _, t in texts])
    same = {}
    for i, t in texts:
        assert same.setdefault(t, rows[i].feature) == rows[i].feature


def slow_feature(text):
    """The feature by plain sums: windowed frames, a Fourier sum for each bin, peaks, pairs."""
    payload = payload_of((text or "").encode())
    x = [float(b) - 128 for b in payload] + [0.0] * max(0, FRAME - len(payload))
    top = []
    for start in range(0, len(x) - FRAME + 1, UNIT):
        frame = np.array([x[start + k] * (0.5 - 0.5 * math.cos(2 * math.pi * k / (FRAME - 1))) for k in range(FRAME)])
        power = [abs(np.sum(frame * np.exp(-2j * np.pi * f * np.arange(FRAME) / FRAME))) for f in range(192)]
        top.append([max(range(a, b), key=lambda f: round(power[f], 3)) for a, b in ((4, 24), (24, 72), (72, 192))])
    found = []
    for gap in (1, 2):
        for t in range(len(top) - gap):
            found += [(t, top[t][i] << 10 | top[t + gap][j] << 2 | gap) for i, j in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2))]
    found.sort()
    packed = lambda k: b"".join(struct.pack("<i", p[k]) for p in found)
    return f"{len(found)}:{zlib.crc32(packed(0) + packed(1)):08x}", [p[0] for p in found], [p[1] for p in found]


def test_feature_by_plain_sums(spark):
    rng = np.random.default_rng(4)
    texts = [None, "a", "".join(map(chr, rng.integers(32, 127, 700))), "".join(map(chr, rng.integers(32, 127, 1500))), "The quick brown fox jumps. " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")  # a repeated row
    got = media_columns(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        feature, times, codes = slow_feature(texts[r.doc_id])
        assert len(r.times) == len(times) and list(r.times) == times
        assert (r.feature, list(r.codes)) == (feature, codes)


def test_peaks_find_a_tone():
    t = np.arange(UNIT * 40)
    wave_ = (128 + 60 * np.sin(2 * np.pi * 30 * t / FRAME)).astype(np.uint8).tobytes()
    assert (peaks(wave_)[:, 1] == 30).all()
    times, codes = pairs(peaks(wave_))
    assert (30 << 10 | 30 << 2 | 1) in codes and times.max() == len(peaks(wave_)) - 2


def test_shifted_content_keeps_codes():
    rng = np.random.default_rng(1)
    tail = rng.integers(32, 127, UNIT * 60, dtype=np.uint8).tobytes()
    a, b = pairs(peaks(tail))[1], pairs(peaks(rng.integers(32, 127, UNIT * 7, dtype=np.uint8).tobytes() + tail))[1]
    assert len(set(a.tolist()) & set(b.tolist())) > 0.9 * len(set(a.tolist()))
