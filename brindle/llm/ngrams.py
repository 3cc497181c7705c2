"""Hashed byte n-gram counts of whole texts, as dense blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer, runs

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
BLOCK_ROWS = 512
#: By byte, lower case of A-Z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def ngram_counts(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], fold: bool) -> np.ndarray:
    """float32 [rows, BUCKETS]: how often each bucket's n-grams occur in each row, a blank before and after it."""
    n, length = len(offsets) - 1, np.diff(offsets)
    if fold:
        data = FOLD[data]
    ext = np.full(len(data) + n + 1, 32, np.uint32)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), length)
    ext[at] = data
    begin = offsets[:-1] + np.arange(n)  # of each row's leading blank
    end = offsets[1:] + np.arange(1, n + 1)  # of its trailing blank
    base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, length + 1)
    out = np.zeros(n * BUCKETS + 1)
    for size in sizes:
        h = np.full(len(ext) - 1, size, np.uint32)
        for k in range(size):
            h[: len(ext) - k] += (ext[k : k + len(h)] + np.uint32(1)) * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
        h *= np.uint32(0x85EBCA6B)
        code = base + (h >> np.uint32(32 - BUCKET_BITS))
        for t in range(1, size - 1):  # grams that would go on into the next row
            over = end - t
            code[over[over >= begin]] = n * BUCKETS
        code[begin[length + 2 < size]] = n * BUCKETS
        out += np.bincount(code, minlength=n * BUCKETS + 1)
    return out[:-1].reshape(n, BUCKETS).astype(np.float32)


def blocks(column: pa.Array, sizes: tuple[int, ...], fold: bool) -> Iterator[np.ndarray]:
    """Counts of a text column, for as many rows at a time as memory bounds allow."""
    data, offsets = buffer(column)
    for i, j in runs(offsets):
        for k in range(i, j, BLOCK_ROWS):
            m = min(k + BLOCK_ROWS, j)
            yield ngram_counts(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k], sizes, fold)


def sample(rows: DataFrame, label: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """About per_label rows of each label at most, chosen by a hash of the id.

    Label counts come first, so labels x per_label bounds what is chosen, whatever the table's size.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError(f"{label} has more than 1000 values")
    rates = [F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_label / n))) for k, n in counts.items()]
    rate = F.coalesce(*rates, F.lit(0.0))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(part < rate)


def in_order(rows: list) -> list:
    """Collected (text, label) rows in an order that doesn't depend on partitions."""
    return sorted(rows, key=lambda r: (str(r[1]), r[0] or ""))


def counts_of(texts: list[str | None], sizes: tuple[int, ...], fold: bool) -> np.ndarray:
    out, at = np.zeros((len(texts), BUCKETS), np.float32), 0
    for counts in blocks(pa.array(texts, pa.string()), sizes, fold):
        out[at : at + len(counts)] = counts
        at += len(counts)
    return out
