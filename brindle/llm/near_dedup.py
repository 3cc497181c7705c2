"""Near-dedup at a similarity threshold: Golay-code keys of SimHash fingerprints give the first candidates, prefixes of shingle
sets all that are left; all are verified on the sets.

Golay keys, as in simhash.py. Its 64 bits and two errors hardly reach 0.8 of the five-word shingles, so a fingerprint has 128 bits
here, of two-word shingles: such texts differ in about a twelfth of them. Three segments of 23 bits are decoded to indices of
codewords, and keys are pairs of segments' indices: errors that spoil one segment leave a pair (pigeonhole). A key gives out a
minimum spanning forest of its fingerprints and each one's nearest. What verifies makes groups; fingerprints are no bound, so a
copy that was cut off or added to may have no such key.

Prefixes, for the rest, exactly. A text is the set of its `width`-word shingles' hashes. Put all shingles in one order, frequent ones last. Of two sets with
Jaccard similarity t or more, each shares t of its shingles at least, so the first n - ceil(t n) + 1 of each (its prefix)
have one in common. The prefix shingles that several texts have are keys. Which shingles are frequent comes from a sample of
the texts; that decides how crowded keys are, not what is found.

Within a key all pairs are compared, by bounds that no similar pair fails: sets that similar differ in (n + m)(1 - t)/(1 + t)
shingles at most, and so do, at most, the parities of the shingles that fall on each of `BITS` places. Keys of more than
`BLOCK` texts are cut into blocks, and pairs of blocks are dealt out. What passes meets a second such bound with as many
places as fit the sets' sizes (`sketch`), and is verified on the sets.

A group of n near copies has n x n pairs, and n - 1 links would do. So at first each text of a key only gives out its nearest
one outside its own group; verified pairs make groups, and that is repeated while it finds links, `ROUNDS` times at most. Then
what is left comes whole: all pairs between different groups. Texts with equal sets are linked to the first of them and don't
meet in keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, buffer, rows_of
from .components import components
from .repeats import _mix
from .simhash import ERROR, FOUR, HIGH, LOW, WEIGHT, _shingles, majorities

#: Shingles known as frequent: of one row in SAMPLE, those that OFTEN rows or more have, at most KNOWN (16 bytes each are
#: broadcast). They only order prefixes; any order gives all pairs.
SAMPLE, OFTEN, KNOWN = 8, 8, 500_000
#: Places of a set's parities.
BITS = 256
#: Texts of a key that meet in one task; of a larger key, two blocks of about as many.
BLOCK = 4096
#: Texts of a key up to which pairs are compared by shifting, and pairs that are compared at once in a larger one.
SHIFT_MAX, AT_ONCE = 32, 1 << 18
#: Times that each text of a key gives out its nearest only, after the Golay keys and before all pairs between groups are.
ROUNDS = 1
#: Of a fingerprint: words of its shingles, and segments as (lane of 64 bits, first bit).
PRINT_WIDTH, SEGMENTS = 2, ((0, 0), (0, 23), (1, 0))
#: Bits that Golay candidates may differ in (of similarity 0.8: about 11 of 128, deviation 3; unrelated ones: 64), and each one's nearest beside the forest.
CLOSE, NEAREST = 22, 2
#: Fingerprints of a Golay key that are compared with each other; of a larger key, so many at a time.
MATRIX = 1024
#: What a similarity computed in floating point may be off by.
SLACK = 1e-6


def _hashes(text: bytes, width: int) -> np.ndarray:
    s = _shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, s), np.uint64, len(s))).view(np.int64)


def _sets_udf(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(t, width) for t in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])

    return run


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles on each of twice to four times as many places as there are shingles, a power of two, BITS at least."""
    places = max(BITS, 2 << len(s).bit_length())
    return np.packbits(np.bincount(s & (places - 1), minlength=places) & 1, bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Places that differ, the longer sketch folded to the shorter one's places."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of 64 bits for each text: majorities over its shingles of PRINT_WIDTH words."""
    lanes, hashes, sizes, held = ([], []), [], [], 0
    for k, text in enumerate(texts):
        s = _shingles(text, PRINT_WIDTH)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(42)), np.uint64, len(s)))
        sizes.append(len(s))
        held += len(s)
        if held > 200_000 or k == len(texts) - 1:
            h = np.concatenate(hashes)
            for lane, values in zip(lanes, (h, _mix(h + np.uint64(43)))):
                lane.append(majorities(values, np.array(sizes)))
            hashes, sizes, held = [], [], 0
    return tuple(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in lanes)


def indices(word: np.ndarray) -> np.ndarray:
    """[rows, 6]: indices of the codewords within distance 4; -1 where there are fewer."""
    syndrome = LOW[word & 4095] ^ HIGH[word >> 12]
    out = np.full((len(word), 6), -1, np.int64)
    out[:, 0] = (word ^ ERROR[syndrome]) >> 11
    far = WEIGHT[syndrome] == 3
    out[far, 1:] = (word[far, None] ^ FOUR[syndrome[far]]) >> 11
    return out


def golay_keys(lanes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the pairs of segments."""
    index = [indices((lanes[lane] >> np.uint64(start) & np.uint64((1 << 23) - 1)).astype(np.uint32)) for lane, start in SEGMENTS]
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = index[i][:, :, None], index[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(k << 24 | index[i][row, x] << 12 | index[j][row, y])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _golay_keys_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            rows, fp0, fp1 = (batch.column(c).slice(k, 1000).to_numpy(zero_copy_only=False) for c in range(3))
            at, keys = golay_keys((fp0.view(np.uint64), fp1.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp0[at]), pa.array(fp1[at]), pa.array(rows[at])], ["key", "fp0", "fp1", "row"])


def spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs at most CLOSE bits apart, a minimum spanning forest (by Prim's rule) and every one's NEAREST nearest; some come twice."""
    n = len(fps)
    matrix = np.bitwise_count(fps[:, None, 0] ^ fps[None, :, 0]) + np.bitwise_count(fps[:, None, 1] ^ fps[None, :, 1])
    best, link = np.full(n, 255, np.uint8), np.zeros(n, np.int64)
    done, at = np.zeros(n, bool), 0
    a, b = [], []
    for _ in range(n - 1):
        done[at] = True
        nearer = (matrix[at] < best) & ~done
        best[nearer] = matrix[at][nearer]
        link[nearer] = at
        best[at] = 255
        at = int(best.argmin())
        if best[at] == 255:
            break
        if best[at] <= CLOSE:
            a.append(at)
            b.append(int(link[at]))
    np.fill_diagonal(matrix, 255)
    near = np.argpartition(matrix, NEAREST - 1, axis=1)[:, :NEAREST] if n > NEAREST + 1 else np.zeros((n, 0), np.int64)
    x, y = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    close = matrix[x, y] <= CLOSE
    return np.concatenate((np.array(a, np.int64), x[close])), np.concatenate((np.array(b, np.int64), y[close]))


def _golay_pairs_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp0, fp1, row) sorted by key and row; out: (a, b), pairs of rows, a > b."""

    def pairs(keys: np.ndarray, fp0: np.ndarray, fp1: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        fps = np.stack((fp0.view(np.uint64), fp1.view(np.uint64)), axis=1)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        few = np.repeat(sizes <= 8, sizes)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, min(8, int(sizes.max(initial=1)))):
            same = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
            same = same[np.bitwise_count(fps[same] ^ fps[same + d]).sum(axis=1) <= CLOSE]
            left.append(same)
            right.append(same + d)
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            for k in range(s, s + n, MATRIX):
                a, b = spanning(fps[k : min(s + n, k + MATRIX)])
                left.append(a + k)
                right.append(b + k)
        x, y = rows[np.concatenate(left)], rows[np.concatenate(right)]
        both = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    held = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))]
    for batch in batches:
        held = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
        if len(held[0]) > 200_000 and (cut := int(np.searchsorted(held[0], held[0][-1]))) > 0:
            yield pairs(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield pairs(*held)


def _prints_udf(width: int, least: float, often):
    """(row, size, digest, bits, sketch, prefix, fp0, fp1): of a text's set its size, digest, parities and first shingles, and its fingerprint; often: sorted shingles and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = often.value
        for batch in batches:
            texts = rows_of(batch, "text")
            sets = [_hashes(t, width) for t in texts]
            prefixes = []
            for s in sets:
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                count = np.where(known[at] == s, counts[at], 0) if len(known) else np.zeros(len(s), np.int64)
                prefixes.append(s[np.argsort(count, kind="stable")[: len(s) - int(np.ceil(len(s) * least - SLACK)) + 1]])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bits = [np.packbits(np.bincount(s & (BITS - 1), minlength=BITS) & 1).tobytes() for s in sets]
            arrays = [pa.array(list(map(len, sets)), pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, bits, list(map(sketch, sets)))), pa.array(prefixes, pa.list_(pa.int64())), *map(pa.array, fingerprints(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "size", "digest", "bits", "sketch", "prefix", "fp0", "fp1"])

    return run


def _met_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, row) sorted by token; out: those whose token other rows have too."""
    token, row, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # before: the token ahead of what is held
    for batch in batches:
        token, row = (np.concatenate((x, batch.column(k).to_numpy(zero_copy_only=False))) for k, x in enumerate((token, row)))
        if len(token) < 2:
            continue
        same = token[1:] == token[:-1]
        met = same | np.concatenate(([token[0] == before], same[:-1]))  # of all but the last
        yield pa.RecordBatch.from_arrays([pa.array(token[:-1][met]), pa.array(row[:-1][met])], ["token", "row"])
        before, token, row = token[-2], token[-1:], row[-1:]
    if len(token) and token[0] == before:
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(row)], ["token", "row"])


def close_pairs(starts: np.ndarray, size: np.ndarray, bits: np.ndarray, block: np.ndarray, root: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance as a part of both sizes) of pairs within the runs that begin at starts, of different roots, whose sets may
    differ in `share` of their sizes' sum or less; some at a time.

    Rows of a run are sorted by size. Where a run has two blocks, only pairs of both are compared.
    """
    counts = np.diff(np.concatenate((starts, [len(size)])))
    group = np.repeat(np.arange(len(starts)), counts)
    mixed = np.zeros(len(starts), bool)
    mixed[group[np.flatnonzero(block != block[starts][group])]] = True

    def test(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = (root[a] != root[b]) & (~mixed[group[a]] | (block[a] != block[b]))
        a, b = a[apart], b[apart]
        both = size[a] + size[b]
        differ = np.maximum(np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64), np.abs(size[a] - size[b]))
        near = differ <= share * both + SLACK
        return a[near], b[near], differ[near] / both[near]

    few = counts <= SHIFT_MAX
    for d in range(1, int(counts[few].max(initial=1))):
        at = np.flatnonzero((group[d:] == group[:-d]) & few[group[d:]])
        yield test(at, at + d)
    for s, n in zip(starts[~few], counts[~few]):
        ends = np.searchsorted(size[s : s + n], size[s : s + n] * (1 + share) / (1 - share) + SLACK, side="right")  # larger sets differ in too much
        width = np.maximum(ends - np.arange(n) - 1, 0)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(np.cumsum(width[i:]), AT_ONCE, side="right")) + i)
            a = np.repeat(np.arange(i, j), width[i:j])
            within = np.arange(len(a)) - np.repeat(np.cumsum(width[i:j]) - width[i:j], width[i:j])
            yield test(s + a, s + a + 1 + within)
            i = j


def nearest(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of n rows, for each row the one with the least distance."""
    best, other = np.full(n, np.inf), np.full(n, -1)
    for a, b, distance in found:
        x, y, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((distance, distance))
        by = np.lexsort((y, d, x))
        first = by[np.concatenate((np.ones(min(len(by), 1), bool), x[by[1:]] != x[by[:-1]]))]
        first = first[d[first] < best[x[first]]]
        best[x[first]], other[x[first]] = d[first], y[first]
    have = np.flatnonzero(other >= 0)
    return have, other[have]


def _candidates_udf(least: float, whole: bool):
    """Rows (token, cell, block, size, row, root, bits) sorted by token, cell, size; out: (token, a, b), pairs of rows, a > b; unless whole, of each row the nearest."""
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*(np.zeros(0, np.int64) for _ in range(6)), np.zeros((0, BITS // 64), np.uint64)]

        def starts() -> np.ndarray:
            token, cell = held[:2]
            return np.flatnonzero(np.concatenate((np.ones(min(len(token), 1), bool), (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]))))

        def pairs(first: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
            token, _, block, size, row, root, bits = (h[:end] for h in held)
            found = close_pairs(first, size, bits, block, root, share)
            for a, b in ((a, b) for a, b, _ in found) if whole else [nearest(found, end)]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[a], np.maximum(row[a], row[b]), np.minimum(row[a], row[b]))], ["token", "a", "b"])

        for batch in batches:
            bits = np.frombuffer(buffer(batch.column(6))[0].tobytes(), np.uint64).reshape(-1, BITS // 64)
            held = [np.concatenate((h, x)) for h, x in zip(held, [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)), bits])]
            if len(held[0]) > 50_000 and len(first := starts()) > 1:
                yield from pairs(first[:-1], int(first[-1]))
                held = [h[first[-1] :] for h in held]
        if len(held[0]):
            yield from pairs(starts(), len(held[0]))

    return run


def _closer_udf(least: float):
    """Rows (a, b, both, x, y): sizes summed, and sketches; out: (a, b) of those that may be similar."""
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4))
            near = pa.array([sketch_distance(p, q) <= share * n + SLACK for n, p, q in zip(both, x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_groups(spark: SparkSession, docs: DataFrame, row_col: str, text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(row, root) of every row that is in a group but isn't its first: root is the group's smallest row.

    row_col holds unique longs. Two texts are near copies if the Jaccard similarity of their sets of `width`-word
    shingles (a shorter text is one shingle) is `least` or more; groups are what such pairs connect. Texts without
    words (null, empty) are in no group.
    """
    bound_batches(spark)
    scratch, parts = Scratch(spark, "near"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sample = src.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).mapInArrow(_sets_udf(width), "row long, shingles array<long>").select(F.explode("shingles").alias("token"))
    often = sample.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(KNOWN).orderBy("token").toArrow()
    shared = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("token", "n")))
    schema = "row long, size long, digest binary, bits binary, sketch binary, prefix array<long>, fp0 long, fp1 long"
    prints = scratch.save(src.mapInArrow(_prints_udf(width, least, shared), schema), "prints")
    equal = prints.groupBy("digest").agg(F.min("row").alias("b"), F.count("*").alias("times")).where("times > 1")
    copies = scratch.save(prints.select("digest", F.col("row").alias("a")).join(equal, "digest").where("a > b").select("a", "b"), "copies")
    tokens = prints.select(F.explode("prefix").alias("token"), "row").repartition(parts, "token").sortWithinPartitions("token")
    met = scratch.save(tokens.mapInArrow(_met_udf, "token long, row long"), "met")
    keys = scratch.save(met.join(copies.select(F.col("a").alias("row")), "row", "left_anti").join(prints.select("row", "size", "bits"), "row"), "keys")
    scratch.drop("met")
    large = keys.groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") > BLOCK).select("token", F.ceil(F.col("times") / BLOCK).alias("blocks"))
    cut = keys.join(scratch.save(large, "large"), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    x, y = (prints.select(F.col("row").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")

    def links_of(pairs: DataFrame, steps: Scratch) -> DataFrame:
        both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("a_size") + F.col("b_size")).alias("both"), "a_sketch", "b_sketch")
        closer = steps.save(both.mapInArrow(_closer_udf(least), "a long, b long"), "closer")
        involved = steps.save(closer.select(F.col("a").alias("row")).unionAll(closer.select(F.col("b").alias("row"))).distinct(), "involved")
        sets = steps.save(src.join(involved, "row").select("row", "text").mapInArrow(_sets_udf(width), "row long, shingles array<long>"), "sets")
        return steps.save(_verified(closer, sets, least), "links")

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))

    roots, whole, done = components(copies, Scratch(spark, "near")), False, 0
    steps = Scratch(spark, "near")
    golay = prints.select("row", "fp0", "fp1").join(copies.select(F.col("a").alias("row")), "row", "left_anti").mapInArrow(_golay_keys_udf, "key int, fp0 long, fp1 long, row long")
    # dealt by the first segment's index, so that a pair's many keys mostly meet in one task, which gives it out once
    found = golay.repartition(parts, F.shiftright("key", 12)).sortWithinPartitions("key", "row").mapInArrow(_golay_pairs_udf, "a long, b long")
    links = links_of(steps.save(found.distinct(), "pairs"), steps)
    if not links.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links), Scratch(spark, "near"))
    steps.drop()
    live = rooted(cells.select("token", "cell", "block", "size", "row", "bits")).select("token", "cell", "block", "size", "row", "root", "bits")
    while True:
        steps = Scratch(spark, "near")
        dealt = live.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "size")
        close = steps.save(dealt.mapInArrow(_candidates_udf(least, whole), "token long, a long, b long"), "close")
        pairs = steps.save(close.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():  # no two groups are left that a pair could connect
            break
        links = links_of(pairs, steps)
        linked = not links.isEmpty()
        if linked:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links), Scratch(spark, "near"))
        if whole:
            break
        # keys without a close pair of two groups have none later on
        keep = live.drop("root").join(steps.save(close.select("token").distinct(), "tokens"), "token", "left_semi")
        live = scratch.save(rooted(keep).select("token", "cell", "block", "size", "row", "root", "bits"), f"live{done}")
        for name in ("close", "pairs", "closer", "involved", "sets", "links", "tokens"):
            steps.drop(name)
        if done:
            scratch.drop(f"live{done - 1}")
        done += 1
        whole = done == ROUNDS or not linked  # nearest ones that are no links would only come again
    steps.drop()
    scratch.drop()  # only the groups are needed from here on
    return roots.select(F.col("node").alias("row"), "root")
