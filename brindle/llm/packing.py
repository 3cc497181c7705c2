"""Best-fit packing of tokenized documents into fixed-length sequences by linear grouping.

A document longer than a sequence is cut: its first piece takes the rest of the division, so all
other pieces are full and need no packing. What is left to pack has a length from 1 to capacity, and
the plan only needs the number of pieces of each length: a table of `capacity` counts, whatever the
input. On it the driver

1. groups the large lengths into `groups` groups of equal cardinality and rounds each up to its
   group's largest,
2. fills sequences with configurations of the few rounded sizes: each starts at the largest size in
   demand and takes, by subset sums, the fullest combination with it; it is used as often as demand allows,
3. substitutes the actual lengths, which frees the rounding's slack,
4. places the small lengths, longest first, where they fit best, opening sequences only then.

Sequences alike in content are handled as one run, so the plan is a bounded list of runs: pieces
number a to b of a length go to sequences from c on, at offset o. Executors look up their pieces by
(length, number). Numbers come from counts by partition and length, summed over the partitions of a
written table; no length's pieces ever meet in one task.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

END_ID = 2
END_OF_TEXT = "<|endoftext|>"


@cache
def encoder(path: str):
    """The byte-level BPE of a rank file; the special token's string in a text is that token, as the tokenizer has it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str | None, path: str) -> np.ndarray:
    ids = encoder(path).encode(text or "", allowed_special="all")
    return np.array([*ids, END_ID], "<u4")


@dataclass
class Run:
    """Pieces rank..rank+count-1 of a length: per_sequence to each sequence from `sequence` on, from `offset` on."""

    length: int
    rank: int
    count: int
    sequence: int
    per_sequence: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(size index -> times, uses): sequences of rounded sizes that meet the demand. sizes fall."""
    demand, out = list(demand), []
    while any(demand):
        first = next(i for i, d in enumerate(demand) if d)
        room = capacity - sizes[first]
        left = [d - (i == first) for i, d in enumerate(demand)]
        reach, layers = 1, []
        for i, size in enumerate(sizes):  # bit c: a sum of c by sizes[: i + 1]
            layers.append(reach)
            if size <= room:
                for _ in range(min(left[i], room // size)):
                    if (wider := reach | reach << size) == reach:
                        break
                    reach = wider
                reach &= (1 << room + 1) - 1
        total, use = (reach & ((1 << room + 1) - 1)).bit_length() - 1, defaultdict(int, {first: 1})
        for i in range(len(sizes) - 1, -1, -1):
            while not layers[i] >> total & 1:
                total -= sizes[i]
                use[i] += 1
        times = min(demand[i] // n for i, n in use.items())
        for i, n in use.items():
            demand[i] -= n * times
        out.append((dict(use), times))
    return out


def plan(histogram: np.ndarray, capacity: int, groups: int = 512, large_from: float = 0.25) -> tuple[list[Run], int]:
    """(runs, number of sequences) for histogram[length] pieces of each length."""
    next_rank, sequences, runs = defaultdict(int), 0, []
    rest = {n: int(histogram[n]) for n in range(1, capacity) if histogram[n]}
    if histogram[capacity]:
        runs.append(Run(capacity, 0, int(histogram[capacity]), 0, 1, 0))
        sequences = int(histogram[capacity])
    large = [n for n in sorted(rest, reverse=True) if n > capacity * large_from]
    total = sum(rest[n] for n in large)
    grouped: list[list[list[int]]] = []  # of each group, [length, count], longest first
    share = -(-total // groups) if total else 0
    for n in large:
        left = rest.pop(n)
        while left:
            if not grouped or sum(c for _, c in grouped[-1]) >= share:
                grouped.append([])
            take = min(left, share - sum(c for _, c in grouped[-1]))
            grouped[-1].append([n, take])
            left -= take
    sizes = [g[0][0] for g in grouped]
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    for use, times in configurations(sizes, [sum(c for _, c in g) for g in grouped], capacity):
        alike = [(sequences, times, 0)]
        sequences += times
        for i, n in sorted(use.items()):
            for _ in range(n):
                parts = []
                for first, count, used in alike:
                    while count:
                        length, there = grouped[i][0]
                        take = min(count, there)
                        runs.append(Run(length, next_rank[length], take, first, 1, used))
                        next_rank[length] += take
                        parts.append((first, take, used + length))
                        first, count = first + take, count - take
                        grouped[i][0][1] -= take
                        if not grouped[i][0][1]:
                            grouped[i].pop(0)
                alike = parts
        for first, count, used in alike:
            free[capacity - used].append((first, count))
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            room = min((r for r in free if r >= n and free[r]), default=None)
            if room is None:
                room, per = capacity, capacity // n
                free[room].append((sequences, -(-left // per)))
                sequences += -(-left // per)
            first, count = free[room].pop()
            if not free[room]:
                del free[room]
            per = room // n
            take = min(left, count * per)
            runs.append(Run(n, next_rank[n], take, first, per, capacity - room))
            next_rank[n] += take
            left -= take
            full, part = divmod(take, per)
            if full:
                free[room - per * n].append((first, full))
            if part:
                free[room - part * n].append((first + full, 1))
            if count > full + bool(part):
                free[room].append((first + full + bool(part), count - full - bool(part)))
    return runs, sequences


def _pieces_udf(capacity: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in enumerate(batch.column(1).to_pylist()):
                ids = token_ids(text, path)
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % capacity or min(capacity, len(ids))
                    values = (doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length])
                    for column, value in zip(rows, values):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            ids_of = batch.column(0).take(pa.array(rows[0], pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(r, k) for r, k in zip(rows[1:], kinds))], ["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _place_udf(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, run_rank, sequence, per, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                at[mine] = first[n] + np.searchsorted(run_rank[first[n] : first[n + 1]], rank[mine], side="right") - 1
            inner = rank - run_rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + inner // per[at]), pa.array(offset[at] + inner % per[at] * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, ranks: str | None = None, groups: int = 512) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has one token, the end. Rows that repeat an id are packed each. No rows
    give no rows. ranks is the tokenizer's rank file, readable on every executor.
    """
    bound_batches(spark)
    scratch, path = Scratch(spark, "packing"), ranks or default_ranks()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    pieces = scratch.save(src.mapInArrow(_pieces_udf(capacity, path), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    counts = scratch.save(pieces.groupBy("length", "part").count(), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        histogram[length] = n
    runs, _ = plan(histogram, capacity, groups)
    runs.sort(key=lambda r: (r.length, r.rank))
    table = np.array([[r.length, r.rank, r.sequence, r.per_sequence, r.offset] for r in runs], np.int64).reshape(-1, 5)
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((first, *(np.ascontiguousarray(table[:, k]) for k in range(1, 5))))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.save(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    ranked = pieces.join(offsets, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place_udf(shared), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
