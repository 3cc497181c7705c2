"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has a bit for each of 64 majorities over its shingles' XXH64 values. Two
fingerprints link when at most two bits differ. Candidates: the fingerprint is cut into segments
of 23, 23 and 18 bits; two errors leave one of the three segments whole, and the segment after it
has at most two errors. The binary Golay code is perfect: each 23-bit word lies within distance 3
of one codeword. A word takes as keys the indices of all codewords within distance 4: one if it
lies within 2 of its own, else six (its own and five at distance 4). Words at distance two or less
have a word between them whose codeword is within 4 of both, so they share a key. A fingerprint
thus has about 15 keys (whole segment, index of the next), and every link meets in at least one.

Within a key, distances are verified exactly and only a spanning forest of the links goes out, so
what leaves a key is less than its size. Keys hold distinct fingerprints: copies are merged
before. Large keys are probed by flipping bits instead of comparing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, rows_of
from .components import components

#: Generator polynomial of the binary [23,12,7] Golay code: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Members of a key up to which neighbours are compared by shifting, and pairs in blocks.
SHIFT_MAX, BLOCK_MAX = 64, 2048


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, ...]:
    """Syndromes of the low 12 and high 11 bits; by syndrome the error of weight 3 or less, its weight, the five of weight 4."""
    low = np.array([_remainder(v) for v in range(4096)], np.uint32)
    high = np.array([_remainder(v << 12) for v in range(2048)], np.uint32)
    error, weight, four = np.zeros(2048, np.uint32), np.zeros(2048, np.uint8), np.zeros((2048, 5), np.uint32)
    one = [_remainder(1 << i) for i in range(23)]
    seen = np.zeros(2048, int)
    for w in (1, 2, 3, 4):
        for bits in combinations(range(23), w):
            s, v = 0, 0
            for i in bits:
                s, v = s ^ one[i], v | 1 << i
            if w < 4:
                error[s], weight[s] = v, w
            else:
                four[s, seen[s]] = v
                seen[s] += 1
    return low, high, error, weight, four


LOW, HIGH, ERROR, WEIGHT, FOUR = _tables()


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each fingerprint."""
    rows, keys = [], []
    at = np.arange(len(prints))
    for i, (start, bits) in enumerate(SEGMENTS):
        j_start, j_bits = SEGMENTS[(i + 1) % 3]
        whole = prints >> np.uint64(start) & np.uint64((1 << bits) - 1)
        word = (prints >> np.uint64(j_start) & np.uint64((1 << j_bits) - 1)).astype(np.uint32)
        syndrome = LOW[word & 4095] ^ HIGH[word >> 12]
        prefix = (whole << np.uint64(12) | np.uint64(i) << np.uint64(35)).astype(np.int64)
        rows.append(at)
        keys.append(prefix | (word ^ ERROR[syndrome]) >> 11)
        far = np.flatnonzero(WEIGHT[syndrome] == 3)
        more = (word[far, None] ^ FOUR[syndrome[far]]) >> 11
        rows.append(np.repeat(far, 5))
        keys.append((prefix[far, None] | more).ravel())
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


#: By byte, its eight bits as eight byte lanes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of sizes[i] hashes: a bit is 1 if set in over half of them; an empty run gives 0."""
    out = np.zeros(len(sizes), "<u8")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    pieces = -(-size // 255)  # a byte lane counts to 255
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), pieces) + 255 * inner
    lanes = LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    out[full] = np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: only A-Z, and only the six ASCII blanks
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _fingerprint_udf(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            prints, hashes, sizes, held = [], [], [], 0
            for text in rows_of(batch, "text"):
                s = _shingles(text, width)
                hashes.append(np.fromiter(map(digest, s, repeat(42)), np.uint64, len(s)))
                sizes.append(len(s))
                held += len(s)
                if held > 200_000:
                    prints.append(majorities(np.concatenate(hashes), np.array(sizes)))
                    hashes, sizes, held = [], [], 0
            if sizes:
                prints.append(majorities(np.concatenate(hashes), np.array(sizes)))
            fp = np.concatenate(prints).astype("<u8").view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the 64-bit fingerprint as a signed long; 0 for a text without words."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_fingerprint_udf(width), f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _keys_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def _masks() -> np.ndarray:
    bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
    return np.array(bits + [a | b for a, b in combinations(bits, 2)], np.uint64)


def close_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of distinct fingerprints with at most two bits between them, for one large key."""
    if len(fps) > BLOCK_MAX:  # ask for each of the 2080 neighbours instead of all others
        order = np.argsort(fps)
        ranked, left, right = fps[order], [], []
        for mask in _masks():
            want = ranked ^ mask
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == want) & (want > ranked))
            left.append(order[hit])
            right.append(order[at[hit]])
        return np.concatenate(left), np.concatenate(right)
    left, right = [], []
    for k in range(0, len(fps), 256):
        near = np.bitwise_count(fps[k : k + 256, None] ^ fps[None, :]) <= 2
        a, b = np.nonzero(near)
        keep = a + k < b
        left.append(a[keep] + k)
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with node > root in value for the graph of the edges a-b: as many rows as nodes that aren't roots."""
    names, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def _links_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key may go over the end of a batch."""

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        u = fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        few = np.repeat(sizes <= SHIFT_MAX, sizes)
        for d in range(1, min(SHIFT_MAX, int(sizes.max(initial=1)))):
            same = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
            same = same[np.bitwise_count(u[same] ^ u[same + d]) <= 2]
            left.append(same)
            right.append(same + d)
        for s, n in zip(starts[sizes > SHIFT_MAX], sizes[sizes > SHIFT_MAX]):
            a, b = close_pairs(u[s : s + n])
            left.append(a + s)
            right.append(b + s)
        node, root = forest(fps[np.concatenate(left)], fps[np.concatenate(right)])
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(keys) and (cut := int(np.searchsorted(keys, keys[-1]))) > 0:
            yield linked(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield linked(keys, fps)


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable by links).

    Texts without words (null, empty, blanks only) have fingerprint zero and link like any other.
    Equal fingerprints always link. A component whose ids are all null has a null component_id;
    null ids don't count for it otherwise. Rows that repeat an id each get their own text's component.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("low_id")), "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("fp").mapInArrow(_keys_udf, "key long, fp long")
    links = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_links_udf, "a long, b long")
    roots = components(links, scratch)
    labelled = scratch.save(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root")), "labelled")
    lowest = scratch.save(labelled.groupBy("root").agg(F.min("low_id").alias("component_id")), "lowest")
    named = scratch.save(labelled.join(lowest, "root").select("fp", "component_id"), "named")
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
