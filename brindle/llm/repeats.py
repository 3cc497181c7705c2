"""Removal of repeated passages: suffix-array dedup over the whole corpus.

Every byte covered by a string of `least` bytes that also starts anywhere else is removed. Passages are
counted beside that: runs of windows of `words` + 1 words that another document has too, as a passage
of over fifty words often has less than 400 bytes. Sorting all suffixes of a corpus in one order is
neither needed nor scalable: equal strings only have to meet.

1. Anchors. In every window of `short` bytes the gram of `gram` bytes with the smallest hash is its
   anchor (the first, at ties). Equal windows have equal anchors, and neighbouring windows mostly share
   theirs, so a document's windows fall into few regions, one for each anchor. Counting anchors over all
   documents, with map-side combining, rules out every window whose anchor occurs once.
2. Regions of anchors that occur again are cut out of their texts, each with its windows' bytes up to
   `least`; regions of one anchor and 128-bit digest are merged into one with a count, and dealt out by anchor.
3. A task takes whole groups of anchors, some megabytes at a time, builds the suffix order and the
   Burrows-Wheeler transform of their regions, and expands intervals breadth-first, by `short` and up to
   `least` (see bwt.py); regions that weren't merged are judged by their bytes. An anchor with too many bytes of different
   regions (a passage in very many contexts) is split first: its windows by where they lie around the
   anchor, and each part by what all its windows contain, down to single windows.
4. Repeated windows return to their documents, which are cut.

Windows of words take the same way: their anchors are grams of words, in the same lists (the lowest bit of a hash tells them
apart), and their regions hold a 64-bit hash of each window instead of bytes. A task compares whole groups of an
anchor's regions; the windows of an anchor with too many regions are counted one by one, by partial aggregates.

Texts are written once, bucketed by row, so that both joins with them leave them in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import Scratch, bound_batches, buffer, rows_of, runs

GRAM = 32
#: Of a document that is longer, windows are found a piece at a time.
PIECE = 8 << 20
POSITION_BITS = np.uint64(24)
#: Bytes whose suffixes a task sorts at once, and of one anchor's different regions before they are split.
SORT_BYTES, GROUP_BYTES = 1_400_000, 512 << 10
#: Offsets around an anchor that stay together when a group is split, and split again.
SPLITS = (46, 6, 1)
#: Window hashes that a task compares at once, and bytes of one anchor's different lists of them before they are counted one by one.
COMPARED, LISTS_BYTES = 500_000, 256 << 10
#: White space between words.
BLANK = frozenset(b" \t\n\v\f\r")
SOLID = np.array([k not in BLANK for k in range(256)])
SPANS = "spans array<struct<a:long,b:long,length:long>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


SEED = np.uint64(0x9E3779B97F4A7C15)


def doubled(h: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the `gram` items from each position on, from hashes of the items; gram is a power of two."""
    width = 1
    while width < gram:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return _mix(h)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Of the `gram` bytes from each position on."""
    return doubled(_mix(data.astype(np.uint64) + SEED), gram)


#: What a byte adds to the hash of its word at its first 64 places there.
PLACED = _mix(np.arange(64 << 8, dtype=np.uint64) + SEED)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    solid = SOLID[data]
    edge = np.concatenate(([False], solid, [False]))
    start = np.flatnonzero(solid & (first[:-1] | ~edge[:-2]))
    length = np.flatnonzero(solid & (first[1:] | ~edge[2:])) + 1 - start
    upto = np.cumsum(length) - length
    key = (np.arange(length.sum()) - np.repeat(upto, length)) << 8 | data[solid]
    if not len(key):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    each = PLACED[key] if length.max() <= 64 else _mix(key.astype(np.uint64) + SEED)
    return np.searchsorted(start, offsets), _mix(np.add.reduceat(each, upto) + length.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the rows in words, hash of each word). A row of more than `piece` bytes is hashed in pieces that end at a blank."""
    if len(offsets) != 2 or len(data) <= piece:
        return _word_hashes(data, offsets)
    found, a = [], 0
    while a < len(data):
        b = min(len(data), a + piece)
        while b < len(data) and SOLID[data[b : b + piece]].all():
            b = min(len(data), b + piece)
        b += int(np.argmin(SOLID[data[b : b + piece]])) if b < len(data) else 0
        found.append(_word_hashes(data[a:b], np.array([0, b - a]))[1])
        a = b
    words = np.concatenate(found)
    return np.array([0, len(words)]), words


def word_gram(window: int) -> int:
    """Words of an anchor: 8 in windows of 51."""
    return 1 << (max(1, window // 6).bit_length() - 1)


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int, piece: int = PIECE) -> list[np.ndarray]:
    """Of each row, hashes of the `window` words from each word on."""
    out, half = [], 1 << (window.bit_length() - 1)
    for i, j in runs(offsets):
        at, words = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], piece)
        h = doubled(words, half)
        n = max(0, len(words) - window + 1)
        h = _mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + h[window - half : window - half + n])
        out += [h[a : max(a, b - window + 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int = GRAM, hashes: Callable[[np.ndarray, int], np.ndarray] = gram_hashes) -> tuple[np.ndarray, ...]:
    """(row, hash, anchor, first, last): regions of window starts first..last, in positions of data."""
    empty = np.zeros(0, np.int64)
    length = np.diff(offsets)
    if len(data) < least or not (length >= least).any():
        return empty, empty, empty, empty, empty
    h = hashes(data, gram)
    key = h >> POSITION_BITS << POSITION_BITS | np.arange(len(h), dtype=np.uint64)
    low = sliding_minimum(key, least - gram + 1)
    count = np.maximum(length - least + 1, 0)
    row = np.repeat(np.arange(len(length)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][row]
    at = (low[start] & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    tail = np.concatenate((head[1:], [len(at)])) - 1
    return row[head], h[at[head]].view(np.int64), at[head], start[head], start[tail]


def _pieces(offsets: np.ndarray, least: int, piece: int = PIECE) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, from, to): rows a few megabytes at a time, or pieces of a longer row that share no window."""
    for i, j in runs(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= piece:
            yield i, j, a, b
        else:
            for k in range(a, b, piece):
                yield i, j, k, min(b, k + piece + least - 1)


def _anchors_udf(least: int, piece: int, window: int):
    """window: words of a window, 0 for none. Hashes are even for windows of bytes and odd for windows of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffer(batch.column(1))
            rows, found = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(4)]
            for i, j, a, b in _pieces(offsets, least, piece):
                inner = np.clip(offsets[i : j + 1], a, b) - a
                row, h, *places = anchors(data[a:b], inner, least)
                rows.append(row + i)
                found[0].append(h & ~1)
                for column, place in zip(found[1:], places):
                    column.append(place + a - offsets[row + i])
            for i, j in runs(offsets) if window else ():
                at, words = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], piece)
                for k, m, a, b in _pieces(at, window, piece):
                    row, h, *places = anchors(words[a:b], np.clip(at[k : m + 1], a, b) - a, window, word_gram(window), doubled)
                    rows.append(row + k + i)
                    found[0].append(h | 1)
                    for column, place in zip(found[1:], places):
                        column.append(place + a - at[row + k])
            row = np.concatenate(rows)
            order = np.argsort(row, kind="stable")
            lists = pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(lists, pa.array(np.concatenate(x)[order])) for x in found]
            key = pa.array((part << 40) + np.arange(nth, nth + batch.num_rows))
            text = pa.array(rows_of(batch, "text"), pa.binary())
            yield pa.RecordBatch.from_arrays([key, batch.column(0), text, *arrays], ["row", "id", "text", "h", "at", "first", "last"])
            nth += batch.num_rows

    return run


def _digest(region: bytes, windows: int) -> bytes:
    return xxhash.xxh3_128_digest(b"%d " % windows + region)


def _regions_udf(least: int, window: int, piece: int):
    """Cuts regions; of equal ones in a batch only one carries its bytes (those of its windows' hashes, where windows are of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, digests, starts, centers, windows, regions = [], [], [], [], [], [], []
            seen = set()
            of_words = window_hashes(*buffer(batch.column(1)), window, piece) if window else [None] * batch.num_rows
            for row, text, hashed, found in zip(batch.column(0).to_pylist(), rows_of(batch, "text"), of_words, batch.column(2).to_pylist()):
                for item in found:
                    n = item["last"] - item["first"] + 1
                    region = hashed[item["first"] : item["last"] + 1].tobytes() if item["h"] & 1 else text[item["first"] : item["last"] + least]
                    d = _digest(region, n)
                    key = (item["h"], d)
                    rows.append(row)
                    hashes.append(item["h"])
                    digests.append(d)
                    starts.append(item["first"])
                    centers.append(item["at"] - item["first"])
                    windows.append(n)
                    regions.append(None if key in seen else region)
                    seen.add(key)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = (rows, hashes, digests, starts, centers, windows, regions)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["row", "h", "d", "start", "center", "windows", "region"])

    return run


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _expand_udf(lengths: tuple[int, ...]):
    """Rows (h, d, copies, windows, region) sorted by h; out: (h, d, spans), runs of starts in the region of repeated strings of each length."""

    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("length", pa.int64())]))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        lists = pa.array([[{"a": a, "b": b, "length": n} for a, b, n in r[2]] for r in rows], spans)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), lists], ["h", "d", "spans"])

    def merged_copies(rows: list[tuple]) -> pa.RecordBatch:
        """All strings of regions that were merged from several equal ones."""
        return out([(h, d, whole(windows, region)) for h, d, copies, windows, region in rows if copies > 1])

    def whole(windows: int, region: bytes) -> list[tuple[int, int, int]]:
        return [(0, min(windows, len(region) - n + 1), n) for n in lengths if len(region) >= n]

    def solve(held: list[tuple]) -> pa.RecordBatch:
        flags, at, rows = repeated_starts([r[4] for r in held], lengths, [r[3] for r in held]), 0, []
        for h, d, copies, windows, region in held:
            end = at + len(region)
            own = whole(windows, region) if copies > 1 else [(a, b, n) for n, f in zip(lengths, flags) for a, b in _spans(f[at:end])]
            if own:
                rows.append((h, d, own))
            at = end + 1
        return out(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group, alone = [], 0, [], []

        def close() -> int:
            """Takes the group in: a region alone under its anchor has nothing to be compared with."""
            (alone if len(group) == 1 else held).extend(group)
            return 0 if len(group) == 1 else sum(len(r[4]) + 1 for r in group)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if group and row[0] != group[0][0]:
                    size += close()
                    group = []
                    if size > SORT_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    if len(alone) > 5000:
                        yield merged_copies(alone)
                        alone = []
                group.append(row)
        close()
        if alone:
            yield merged_copies(alone)
        if held:
            yield solve(held)

    return run


def _split_udf(short: int, least: int, width: int):
    """Rows (h, d, copies, center, windows, region) -> parts of their windows: (ph, pd, shift, h, d, copies, center, windows, region).

    A part has the windows that lie `width` offsets or less apart around the anchor; it goes by what all of them contain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for h, d, copies, center, windows, region in zip(*(batch.column(k).to_pylist() for k in range(6))):
                a = 0
                while a < windows:
                    cell = (center - a) // width  # falls as a grows
                    latest = center - cell * width
                    b = min(windows, latest + 1)
                    part, common = region[a : b - 1 + least], region[latest : latest - width + 1 + short]
                    name = xxhash.xxh3_128_digest(b"%d %d %d " % (h, cell, width) + common)
                    for column, value in zip(out, (h, d, a, int.from_bytes(name[:8], "little", signed=True), _digest(part, b - a), copies, center - a, b - a, part)):
                        column.append(value)
                    a = b
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["ph", "pd", "shift", "h", "d", "copies", "center", "windows", "region"])

    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each list)."""
    return np.frombuffer(b"".join(lists), np.uint64), np.array([len(x) // 8 for x in lists])


def _shared_udf(compared: int):
    """Rows (h, d, low, high, region) sorted by h: distinct lists of window hashes, with the first and the last row that has them.
    Out: (h, d, spans), runs of windows that two rows or more have; their length is 0."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        w, n = _windows([r[4] for r in held])
        order = np.argsort(w)
        head = np.concatenate(([True], w[order][1:] != w[order][:-1]))
        low, high = (np.repeat(np.array([r[k] for r in held]), n)[order] for k in (2, 3))
        start = np.flatnonzero(head)
        shared = np.empty(len(w), bool)
        shared[order] = (np.minimum.reduceat(low, start) < np.maximum.reduceat(high, start))[np.cumsum(head) - 1]
        ends, rows = np.cumsum(n), []
        for k in np.flatnonzero(np.add.reduceat(shared, ends - n)).tolist():
            rows.append((held[k][0], held[k][1], [{"a": a, "b": b, "length": 0} for a, b in _spans(shared[ends[k] - n[k] : ends[k]])]))
        lists = pa.array([r[2] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("length", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), lists], ["h", "d", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size > compared and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 8
        if held:
            yield solve(held)

    return run


def _windows_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, d, low, high, region) -> (h, d, low, high, k, w), one row a window."""
    for batch in batches:
        w, n = _windows(batch.column(4).to_pylist())
        row = pa.array(np.repeat(np.arange(batch.num_rows), n))
        k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(4)), pa.array(k), pa.array(w.view(np.int64))], ["h", "d", "low", "high", "k", "w"])


def _shared(spark: SparkSession, scratch: Scratch, regions: DataFrame) -> DataFrame:
    """(h, d, spans): in each distinct list of windows of words, those that two rows or more have. regions: (row, h, d, region)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = regions.groupBy("h", "d").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.first("region", ignorenulls=True).alias("region"))
    lists = scratch.save(lists, "lists")
    groups = lists.groupBy("h").agg(F.sum(F.length("region")).alias("bytes"))
    large = scratch.save(groups.where(F.col("bytes") > LISTS_BYTES).select("h"), "common")
    split = not large.isEmpty()
    rows = (lists.join(large, "h", "left_anti") if split else lists).select("h", "d", "low", "high", "region")
    found = rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_shared_udf(COMPARED), f"h long, d binary, {SPANS}")
    if split:
        rows = lists.join(large, "h", "left_semi").select("h", "d", "low", "high", "region")
        windows = scratch.save(rows.mapInArrow(_windows_udf, "h long, d binary, low long, high long, k long, w long"), "windows")
        shared = windows.groupBy("h", "w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h", "w")
        span = F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.lit(0).cast("long").alias("length"))
        back = windows.select("h", "d", "k", "w").join(scratch.save(shared, "shared").hint("merge"), ["h", "w"])
        found = found.unionAll(back.groupBy("h", "d").agg(F.collect_list(span).alias("spans")))  # at most the windows around an anchor
    return scratch.save(found, "passages")


def whole_words(text: bytes, a: int, b: int) -> int:
    """Words that lie in text[a:b] from their first byte to their last."""
    cut = (a > 0 and text[a - 1] not in BLANK and text[a] not in BLANK) + (b < len(text) and text[b] not in BLANK and text[b - 1] not in BLANK)
    return max(0, len(text[a:b].split()) - cut)


def _stretches(spans: list[tuple[int, int]], window: int) -> int:
    """Maximal runs of words under windows that start at a to b; those that overlap or touch are one."""
    n, end = 0, -1
    for a, b in sorted(spans):
        n += a > end
        end = max(end, b + window)
    return n


def _cut_udf(least: int, words: int, window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, found in zip(rows_of(batch, "text"), batch.column(2).to_pylist()):
                found = [(x["a"], x["b"], x["length"]) for x in found or ()]
                gone = _joined([(a, b) for a, b, n in found if n == least])
                edges = [0, *(x for span in gone for x in span), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                if window:
                    passages = _stretches([(a, b) for a, b, n in found if not n], window)
                else:
                    passages = sum(whole_words(text, a, b) > words for a, b in _joined([(a, b) for a, b, _ in found]))
                for column, value in zip(out, (len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), passages, rest)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"]
            k = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in list(zip(out, kinds))[:k])], ["id", *names[:k]])

    return run


def _repeats(spark: SparkSession, scratch: Scratch, distinct: DataFrame, lengths: tuple[int, int], level: int = 0) -> DataFrame:
    """(h, d, spans): the starts of repeated strings in each distinct region. distinct: (h, d, copies, center, windows, region)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = distinct.groupBy("h").agg(F.sum(F.length("region")).alias("bytes"), F.count("*").alias("n"))
    large = scratch.save(groups.where((F.col("n") > 1) & (F.col("bytes") > GROUP_BYTES)).select("h"), f"large{level}")
    direct = distinct
    if level < len(SPLITS) and not large.isEmpty():
        direct = distinct.join(large, "h", "left_anti")
    else:
        large = None
    rows = direct.select("h", "d", "copies", "windows", "region").repartition(parts, "h").sortWithinPartitions("h")
    found = scratch.save(rows.mapInArrow(_expand_udf(tuple(sorted(set(lengths)))), f"h long, d binary, {SPANS}"), f"spans{level}")
    if large is None:
        return found
    split = distinct.join(large, "h", "left_semi").select("h", "d", "copies", "center", "windows", "region")
    schema = "ph long, pd binary, shift long, h long, d binary, copies long, center long, windows long, region binary"
    children = scratch.save(split.mapInArrow(_split_udf(*lengths, SPLITS[level]), schema), f"children{level}")
    merged = children.groupBy("h", "d").agg(F.sum("copies").alias("copies"), F.min("center").alias("center"), F.first("windows").alias("windows"), F.first("region").alias("region"))
    below = _repeats(spark, scratch, scratch.save(merged, f"merged{level}"), lengths, level + 1)
    back = children.select("ph", "pd", "shift", "h", "d").join(below.hint("merge"), ["h", "d"])
    back = back.select(F.col("ph").alias("h"), F.col("pd").alias("d"), F.transform("spans", lambda s: F.struct((s["a"] + F.col("shift")).alias("a"), (s["b"] + F.col("shift")).alias("b"), s["length"].alias("length"))).alias("spans"))
    joined = back.groupBy("h", "d").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a region's parts: a few hundred at most
    return scratch.save(found.unionAll(joined), f"all{level}")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400, words: int = 50, short: int | None = None, with_text: bool = False, piece: int = PIECE) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and with_text the kept bytes.

    Texts are UTF-8 bytes, null is empty, matches stay within a document but may lie in the same one and
    overlap. Strings are judged on the input: all copies go, also the first. n_passages counts the maximal runs of words
    under windows of `words` + 1 words that another row has too, whatever white space lies between; with `short`, the maximal runs
    covered by repeated strings of so many bytes, in any row, that have more than `words` whole words. They aren't removed as such.
    Windows of a text of more than `piece` bytes are found a piece at a time, which changes no result. Rows that repeat an id are
    documents of their own. Texts shorter than `least` bytes stay whole. Kept bytes may start or end within a
    character, as spans are judged by bytes.
    """
    window, short = (words + 1, least) if short is None else (0, short)
    if not 2 * GRAM <= short <= least:
        raise ValueError(f"short is {2 * GRAM} bytes or more, and least no less")
    bound_batches(spark)
    scratch, parts = Scratch(spark, "repeats"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    lists = "h array<long>, at array<long>, first array<long>, last array<long>"
    texts = scratch.bucketed(src.mapInArrow(_anchors_udf(short, piece, window), f"row long, id {kind}, text binary, {lists}"), "texts", "row", parts)
    occurs = texts.select("row", F.explode(F.arrays_zip("h", "at", "first", "last")).alias("x")).select("row", "x.*")
    again = scratch.save(occurs.groupBy("h").count().where("count > 1").select("h"), "again")
    wanted = occurs.join(again.hint("merge"), "h").groupBy("row").agg(F.collect_list(F.struct("h", "at", "first", "last")).alias("found"))  # at most a document's regions
    cut = texts.select("row", "text").join(wanted.hint("shuffle_hash"), "row").select("row", "text", "found")
    regions = scratch.save(cut.mapInArrow(_regions_udf(least, window, piece), "row long, h long, d binary, start long, center long, windows long, region binary"), "regions")
    of_words = F.col("h").bitwiseAND(1) == 1
    merged = regions.where(~of_words).groupBy("h", "d").agg(F.count("*").alias("copies"), F.min("center").alias("center"), F.first("windows").alias("windows"), F.first("region", ignorenulls=True).alias("region"))
    spans = _repeats(spark, scratch, scratch.save(merged, "distinct"), (short, least))
    if window:
        spans = spans.unionAll(_shared(spark, scratch, regions.where(of_words).select("row", "h", "d", "region")))
    hits = regions.select("row", "h", "d", "start").join(spans.hint("merge"), ["h", "d"]).select("row", "start", F.explode("spans").alias("s"))
    removed = hits.select("row", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") - 1 + F.col("s.length")).alias("b"), F.col("s.length").alias("length")).alias("span"))
    found = removed.groupBy("row").agg(F.collect_list("span").alias("found"))
    full = texts.select("row", "id", "text").join(found.hint("shuffle_hash"), "row", "left").select("id", "text", "found")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_text
    return full.mapInArrow(_cut_udf(least, words, window, with_text), schema).withColumnRenamed("id", id_col)
