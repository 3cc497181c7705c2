"""Mixing sources to target weights, in blocks of tokens.

Each source is a stream: its documents in order of id, cut into blocks of `block_words` words (or of
1/64 of a source that is too small for 64 such blocks). A target number of words per source becomes a
number of slots. Output shards draw how many of their slots each source gets from a multinomial over
what the sources still owe, so all shards together owe nothing. A source's slots are mapped to block
indices by a pseudorandom permutation of the indices (a Feistel network with cycle walking), a new
permutation for each pass over the source, and joined with the blocks by index.

Scale: documents are ordered by a range sort on (source, id), which splits a hot source over tasks;
block numbers come from a running sum within partitions and the partitions' totals, at most
partitions + sources rows, which the driver adds up. What is broadcast is one count for each shard and source
(at MAX_SOURCES 256 MB) and those rows. No permutation is ever stored. Reruns agree,
however the input is partitioned, since the order and the draws depend only on ids, sizes and seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Shares of `share` times all sizes by repeating weights; what exceeds `cap` times a size goes to the others, until none does.

    A source is capped once what a weight of one gets reaches cap x size / weight. So in that order, sources are capped as long as
    the next one's bound lies below what is left for a weight of one: one sort, whatever the number of sources.
    """
    n = np.array(sizes, np.float64)
    w = np.resize(np.array(weights, np.float64), len(n))
    out, open_ = np.zeros(len(n)), np.flatnonzero(n)
    if not len(open_):
        return out.tolist()
    order = open_[np.argsort(n[open_] / w[open_], kind="stable")]
    capped, weight = cap * n[order], w[order]
    left = share * sum(sizes) - (np.cumsum(capped) - capped)  # for each source and those after it, if all before it are capped
    rate = left / np.cumsum(weight[::-1])[::-1]
    full = np.minimum.accumulate(rate * weight > capped)
    k = int(full.sum())
    out[order[:k]] = capped[:k]
    if k < len(order):
        out[order[k:]] = rate[k] * weight[k:]
    return out.tolist()


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index -> a pseudorandom permutation of range(size), one for each key; elementwise."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = value[todo] >> h, value[todo] & m
        for step in range(4):
            mixed = (right + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ mixed >> np.uint64(29)) & m)
        value[todo] = left << h | right
        todo = todo[value[todo] >= size[todo].astype(np.uint64)]
    return value.astype(np.int64)


@dataclass
class Mix:
    names: list  # sources by code point, null last
    sizes: np.ndarray
    targets: np.ndarray
    block: np.ndarray  # words to a block
    blocks: np.ndarray
    counts: np.ndarray  # int32 [shards, sources]: slots; the one array that has both sizes
    seed: int

    @property
    def slots(self) -> int:
        return int(self.counts.sum(dtype=np.int64))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each shard's part of each source starts, a source's slots in earlier shards, where each shard starts), by shard and source."""
        wide = self.counts.astype(np.int64)
        return np.concatenate(([0], np.cumsum(wide.ravel()))), (np.cumsum(wide, axis=0) - wide).ravel(), np.concatenate(([0], np.cumsum(wide.sum(axis=1))))


def draw(names: list, sizes: list[int], goals: list[float], block_words: int, shards: int, seed: int) -> Mix:
    n, t = np.array(sizes, np.int64), np.array(goals)
    block = np.maximum(1, np.minimum(block_words, n // 64))
    blocks = -(-n // block)
    whole = np.where(n > 0, np.floor(t / np.maximum(n, 1) + 1e-12), 0).astype(np.int64)
    slots = whole * blocks + np.minimum(np.rint((t - whole * n) / block).astype(np.int64), blocks)
    rng, owed = np.random.default_rng(seed), slots.copy()
    per = -(-int(slots.sum()) // shards)
    counts = np.zeros((shards, len(n)), np.int32)
    for k in range(shards):
        room = min(per, int(owed.sum()))
        while room:
            got = np.minimum(rng.multinomial(room, owed / owed.sum()), owed)
            counts[k] += got.astype(np.int32)
            owed -= got
            room -= int(got.sum())
    return Mix(names, n, t, block, blocks, counts, seed)


def coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """(a number for each row, the value of each number); null has one too."""
    found = column.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _order_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part, nth and the words of the same source before a row in its partition; rows come sorted by source."""
    part, nth, source, words = TaskContext.get().partitionId(), 0, object(), 0  # the last row's source, and its words so far
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code, names = coded(batch.column(1))
        size = batch.column(2).to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        run = np.cumsum(size) - size
        before = run - np.repeat(run[head], np.diff(np.concatenate((head, [n]))))
        if names[code[0]] == source:
            before[: head[1] if len(head) > 1 else n] += words
        source, words = names[code[-1]], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(nth, nth + n)), pa.array(before, pa.int64())], [*batch.schema.names, "part", "nth", "before"]
        )
        nth += n


def _slots_udf(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        starts, before, shard_starts = m.places()
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            cell = np.searchsorted(starts, g, side="right") - 1
            source, shard = cell % len(m.names), cell // len(m.names)
            turn = before[cell] + g - starts[cell]
            epoch, index = np.divmod(turn, m.blocks[source])
            key = (m.seed * 1_000_003 + source) * 7919 + epoch + 1
            block = permuted(index, m.blocks[source], key)
            size = shard_starts[shard + 1] - shard_starts[shard]
            slot = permuted(g - shard_starts[shard], size, shard + 104_729 * (m.seed + 1))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(block)], ["shard", "slot", "src", "block"])

    return run


def _blocks_udf(shared, offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, starts = shared.value, offsets.value
        number = {s: k for k, s in enumerate(m.names)}
        for batch in batches:
            ids, source, size, part, nth, before = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "source", "size", "part", "nth", "before"))
            size, part, nth, before = (c.to_numpy(zero_copy_only=False) for c in (size, part, nth, before))
            code, names = coded(source)
            src = np.array([number[s] for s in names], np.int64)[code]
            both, where = np.unique(np.stack((part.astype(np.int64), src)), axis=1, return_inverse=True)
            start = before + np.array([starts[p, k] for p, k in both.T.tolist()], np.int64)[where.reshape(-1)]
            width = m.block[src]
            low, high = start // width, np.where(size > 0, (start + size - 1) // width, start // width)
            times = high - low + 1
            row = np.repeat(np.arange(len(src)), times)
            block = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            a = np.maximum(block * width[row], start[row]) - start[row]
            b = np.minimum((block + 1) * width[row], start[row] + size[row]) - start[row]
            key = part.astype(np.int64) << 40 | nth
            arrays = [pa.array(key[row]), ids.take(pa.array(row)), pa.array(size[row]), pa.array(m.sizes[src][row]), pa.array(m.targets[src][row]), pa.array(src[row].astype(np.int32)), pa.array(block), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "size", "source_size", "target", "src", "block", "first", "last"])

    return run


@dataclass
class Mixture:
    """slots: (shard, slot, src, block), the mix in order. parts: (row, id, size, source_size, target, src, block, first, last),
    each document's words first to last (exclusive) in a block of its source. rows: the ordered documents, with part and nth."""

    slots: DataFrame
    parts: DataFrame
    rows: DataFrame

    def taken(self) -> DataFrame:
        """(row, id, size, source_size, target, taken): words of each document that the mix takes, repeats counted."""
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        got = self.parts.join(times, ["src", "block"], "left").withColumn("words", (F.col("last") - F.col("first")) * F.coalesce("times", F.lit(0)))
        return got.groupBy("row", "id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, shards: int = 64, seed: int = 7, keep: tuple[str, ...] = ()) -> Mixture:
    """The mixture of docs. Null text has no words; a null source is a source of its own, the last.

    Rows that repeat an id are separate documents; those equal in id and size may stand for each other.
    Without words there are no slots. keep: further columns that rows carries, named as in docs.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    carried = F.struct(*(F.col(c) for c in keep)).alias("kept")
    sized = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *([carried] if keep else [])), "sized")
    order = [F.col("source").asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("size").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)
    # without a number of its own, so that adaptive execution can merge small partitions
    ordered = sized.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_order_udf, f"{schema}, part int, nth long, before long")
    rows = scratch.save(ordered, "rows")
    scratch.drop("sized")
    totals = rows.groupBy("part", "source").agg(F.sum("size").alias("words")).collect()  # at most partitions + sources rows
    names = sorted({r.source for r in totals}, key=lambda s: (s is None, s))  # str order is by code point
    if len(names) > MAX_SOURCES:
        raise ValueError(f"{len(names)} sources; at most {MAX_SOURCES} are meant")
    number, offsets, sizes = {s: k for k, s in enumerate(names)}, {}, [0] * len(names)
    for r in sorted(totals, key=lambda r: r.part):
        offsets[r.part, number[r.source]] = sizes[number[r.source]]
        sizes[number[r.source]] += r.words
    mix = draw(names, sizes, targets(sizes), block_words, shards, seed)
    shared, starts = spark.sparkContext.broadcast(mix), spark.sparkContext.broadcast(offsets)
    slots = spark.range(0, mix.slots, 1, parts).mapInArrow(_slots_udf(shared), "shard int, slot long, src int, block long")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "source", "size", "part", "nth", "before").mapInArrow(
        _blocks_udf(shared, starts), f"row long, id {kind}, size long, source_size long, target double, src int, block long, first long, last long"
    )
    return Mixture(slots, found, rows)
