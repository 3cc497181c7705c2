"""Media columns: texts as 8-bit WAV payloads, and spectral-peak pair fingerprints of what is read back.

A payload is the text's UTF-8 bytes, filled with blanks to a positive multiple of 192 bytes, stored as
mono 8-bit samples by the wave module and read back by it. Frames of 384 samples every 192 go through a
short-time Fourier transform; each frame's strongest bin in each of three bands is a peak; a peak is
paired with the peaks of the next two frames. A pair is stored as its frame (time code) and a code of
(bin, other bin, frames between). Rows are independent: no shuffle.
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

from .common import bound_batches, rows_of

UNIT, FRAME, RATE, TAIL = 192, 384, 8000, 16
#: Bands of Fourier bins, the first bin of each and the end of the last.
BANDS = (4, 24, 72, 192)
FRAMES_AT_ONCE = 8192
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit samples")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """[frames, bands]: the strongest bin of each band in each frame."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    x = np.concatenate((x, np.zeros(max(0, FRAME - len(x)), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::UNIT]
    out = []
    for k in range(0, len(frames), FRAMES_AT_ONCE):  # a long text takes bounded memory
        power = np.abs(np.fft.rfft(frames[k : k + FRAMES_AT_ONCE] * WINDOW, axis=1)).round(3)
        out.append(np.stack([power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:])], axis=1))
    return np.concatenate(out)


def pairs(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the pairs of each frame's peaks with the next two frames' peaks in the same and the next band."""
    times, codes = [np.zeros(0, int)], [np.zeros(0, int)]
    for gap in (1, 2):
        a, b = top[:-gap], top[gap:]
        for i, j in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2)):
            times.append(np.arange(len(a)))
            codes.append(a[:, i] << 10 | b[:, j] << 2 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def describe(text: bytes) -> dict:
    payload = payload_of(text)
    stored = to_wav(payload)
    back = from_wav(stored)
    times, codes = pairs(peaks(back))
    landmark = f"{len(times)}:{zlib.crc32(times.astype('<i4').tobytes() + codes.astype('<i4').tobytes()):08x}"
    return {
        "n_bytes": len(text), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-TAIL:]),
        "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": landmark, "media": stored, "times": times, "codes": codes,
    }


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PAIRS, MEDIA = ", times array<int>, codes array<int>", ", media binary"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_pairs: bool = True, with_media: bool = False) -> DataFrame:
    """One row per input row: id, sizes and digests of payload and WAV, a feature (the number of
    fingerprint pairs and a checksum over them), and with_pairs the time-coded arrays: each pair's frame
    and code, sorted. with_media adds the WAV bytes. Null is empty, and an empty text is one unit of blanks. Equal texts give equal values.
    """
    bound_batches(docs.sparkSession)
    schema = SCHEMA + PAIRS * with_pairs + MEDIA * with_media
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list] = [[] for _ in names]
            for text in rows_of(batch, "text"):
                row = describe(text)
                for column, name in zip(got, names):
                    column.append(row[name])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(got, kinds))], ["id", *names])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)
