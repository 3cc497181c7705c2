"""Language-model scores: context-tree weighting over bytes, and a smoothed word unigram as its base.

Context-tree weighting. Each byte is coded as eight binary choices. A choice is predicted in every
context of 0 to `DEPTH` preceding bytes by a Krichevsky-Trofimov estimate, and the depths are mixed with
the weights that the context tree gives them: a node's weighted probability is half its own estimate
plus half the product of its children's. Both follow from the counts of (context, byte) in the training
texts alone, so training is one distributed count of byte strings.

The tree is whole: it has every context that occurs, so the model grows with the input. It is made in two
tiers. Strings are dealt out by the two bytes before the predicted one, and a task weighs the subtrees
below its contexts of two bytes from the leaves up; of these only the choices at two bytes go to the
driver (65,793 contexts x 255 choices at most, whatever the input), which weighs what is above. With that a
second run goes down from there and gives out the log probability of each byte in its context. Strings that
only occur in texts to be scored are carried with a count of zero, which changes no weight.

Texts are scored with the table of strings, `shard` of them at a time: a shard is broadcast, each text sums
what it finds there, and the sums are added. A text ends with a byte that UTF-8 never uses, so the
probabilities of all texts sum to one.

Words. Counts are made with a combiner in each task and summed by word. Scoring uses a broadcast of
the `frequent` most frequent words; a document's other words are joined with the whole word table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, buffer, rows_of, runs

DEPTH = 6
EDGE = 0xFF  # before and after a text
TOP = 2  # depth of the contexts whose subtrees a task weighs
FLUSH = 150_000  # distinct words that a task holds before it hands them on
GRAM_FLUSH = 1_000_000  # distinct byte strings that it does
SCORE_BYTES = 512 << 10  # bytes whose strings are looked up at once: sorting them stays in the cache
GRAM_BYTES = 1 << 20  # bytes whose strings are counted at once: some 80 MB
WEIGH = 200_000  # byte strings whose subtrees are weighed at once; one group of more goes whole
NODE_SCHEMA = "key long, level int, zeros long, ones long, weighted double"


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): DEPTH edges, then each row's bytes and DEPTH edges; starts[i] is row i's first byte."""
    n, length = len(offsets) - 1, np.diff(offsets)
    ext = np.full(len(data) + DEPTH * (n + 1), EDGE, np.uint8)
    ext[np.arange(len(data)) + np.repeat(DEPTH * np.arange(1, n + 1), length)] = data
    return ext, offsets[:-1] + DEPTH * np.arange(1, n + 1)


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of each row and the end after it: the DEPTH bytes before it, the last first, and itself, as one number."""
    ext, starts = framed(data, offsets)
    wide = ext.astype(np.int64)
    code, n = wide[DEPTH:].copy(), len(ext) - DEPTH
    for k in range(1, DEPTH + 1):
        code |= wide[DEPTH - k : DEPTH - k + n] << (8 * (DEPTH + 1 - k))
    length = np.diff(offsets) + 1
    return code[np.arange(length.sum()) + np.repeat(starts - DEPTH - (np.cumsum(length) - length), length)]


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sums of their counts, 1 each if none are given)."""
    if counts is None:
        codes = np.sort(codes)
    else:
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(codes), 1), bool), codes[1:] != codes[:-1])))
    if counts is None:
        return codes[first], np.diff(np.concatenate((first, [len(codes)])))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of gram_codes, summed over as many texts as memory bounds allow; texts that aren't learned from count 0."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        return tally(*(np.concatenate(x) for x in zip(*held)))

    def out(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])

    for batch in batches:
        data, offsets = buffer(batch.column(0))
        learn = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for i, j in runs(offsets, GRAM_BYTES):
            codes = gram_codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            mine = np.repeat(learn[i:j], np.diff(offsets[i : j + 1]) + 1)
            held.append(tally(codes[mine]))
            others = tally(codes[~mine])[0]
            held.append((others, np.zeros(len(others), np.int64)))
            if sum(len(c) for c, _ in held) > 2 * GRAM_FLUSH:
                held = [merge()]
                if len(held[0][0]) > GRAM_FLUSH:
                    yield out(*held.pop())
    if held:
        yield out(*merge())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; errors near 1e-11."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - shift


#: Logarithms of the gamma function at k + 0.5 and k + 1 for small counts.
SMALL = 1 << 12
HALVES, WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def log(table: np.ndarray, n: np.ndarray, plus: float) -> np.ndarray:
        out = table[np.minimum(n, SMALL - 1)]
        large = n >= SMALL
        out[large] = log_gamma(n[large] + plus)
        return out

    return log(HALVES, zeros, 0.5) + log(HALVES, ones, 0.5) - log(WHOLES, zeros + ones, 1.0) - 2 * HALVES[0]


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, each row's group)."""
    head = np.concatenate((np.ones(min(len(sorted_keys), 1), bool), sorted_keys[1:] != sorted_keys[:-1]))
    return np.flatnonzero(head), np.cumsum(head) - 1


class Subtrees:
    """All nodes below contexts of TOP bytes, for strings (code, n) sorted by code that have every string of their contexts.

    A node is a context and one of the 255 choices of the byte after it. Level l has the choices after l bits; its nodes at depth
    d are known by key: the d bytes before, the last first, and the l bits.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.code, self.key, self.zeros, self.ones, self.of = code, {}, {}, {}, {}
        for d in range(DEPTH, TOP - 1, -1):
            if d < DEPTH:
                code, n = tally((code >> 16) << 8 | code & 255, n)
            for level in range(8):
                key = code >> (8 - level)
                first, self.of[d, level] = groups(key)
                bit = (code >> (7 - level)) & 1
                self.key[d, level] = key[first]
                total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
                self.zeros[d, level], self.ones[d, level] = total - ones, ones
        self.up, self.share, self.weighted = {}, {}, {}
        for level in range(8):
            weighted = estimate(self.zeros[DEPTH, level], self.ones[DEPTH, level])
            for d in range(DEPTH - 1, TOP - 1, -1):
                bits = self.key[d + 1, level] & ((1 << level) - 1)
                self.up[d + 1, level] = np.searchsorted(self.key[d, level], self.key[d + 1, level] >> (8 + level) << level | bits)
                below = np.bincount(self.up[d + 1, level], weights=weighted, minlength=len(self.key[d, level]))
                own = estimate(self.zeros[d, level], self.ones[d, level])
                weighted = np.logaddexp(own, below) - np.log(2)
                self.share[d, level] = np.exp(np.minimum(own - weighted - np.log(2), 0))
            self.weighted[level] = weighted

    def top(self) -> list[np.ndarray]:
        """(key, level, zeros, ones, weighted) of the nodes at depth TOP."""
        rows = [(self.key[TOP, k], np.full(len(self.key[TOP, k]), k, np.int32), self.zeros[TOP, k], self.ones[TOP, k], self.weighted[k]) for k in range(8)]
        return [np.concatenate(x) for x in zip(*rows)]

    def logs(self, above: Above) -> np.ndarray:
        """Log10 probability of each string's last byte after its others."""
        total = np.zeros(len(self.code))
        for level in range(8):
            mixed, left = above.at(self.key[TOP, level], level)
            for d in range(TOP, DEPTH + 1):
                one = (self.ones[d, level] + 0.5) / (self.zeros[d, level] + self.ones[d, level] + 1)
                share = self.share[d, level] if d < DEPTH else 1.0
                mixed, left = mixed + left * share * one, left * (1 - share)
                if d < DEPTH:
                    up = self.up[d + 1, level]
                    mixed, left = mixed[up], left[up]
            p = mixed[self.of[DEPTH, level]]
            total += np.log10(np.where((self.code >> (7 - level)) & 1 == 1, p, 1 - p))
        return total


class Above:
    """Depths 0 to TOP - 1, from the nodes at depth TOP: what they mix and leave to the depths below, by node at depth TOP - 1."""

    def __init__(self, key: np.ndarray, level: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        self.keys, self.mixed, self.left = [], [], []
        for k in range(8):
            at = level == k
            nodes = [(key[at], zeros[at], ones[at], weighted[at])]
            ups = []
            for d in range(TOP - 1, -1, -1):
                below, z, o, w = nodes[-1]
                own_key = below >> (8 + k) << k | below & ((1 << k) - 1)
                distinct, up = np.unique(own_key, return_inverse=True)
                total = lambda x: np.bincount(up, weights=x, minlength=len(distinct))  # noqa: B023, E731
                z, o = total(z).astype(np.int64), total(o).astype(np.int64)
                nodes.append((distinct, z, o, np.logaddexp(estimate(z, o), total(w)) - np.log(2)))
                ups.append(up)
            mixed = left = None
            for d in range(TOP):
                distinct, z, o, w = nodes[TOP - d]
                if d == 0:
                    mixed, left = np.zeros(len(distinct)), np.ones(len(distinct))
                else:
                    mixed, left = mixed[ups[TOP - d]], left[ups[TOP - d]]
                share = np.exp(np.minimum(estimate(z, o) - w - np.log(2), 0))
                mixed, left = mixed + left * share * (o + 0.5) / (z + o + 1), left * (1 - share)
            self.keys.append(nodes[1][0])
            self.mixed.append(mixed)
            self.left.append(left)

    def at(self, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(mixed, left) for nodes at depth TOP."""
        place = np.searchsorted(self.keys[level], key >> (8 + level) << level | key & ((1 << level) - 1))
        return self.mixed[level][place], self.left[level][place]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, n) of whole contexts of TOP bytes, from rows sorted by code."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
        if len(held[0]) > WEIGH:
            last = int(np.searchsorted(held[0], held[0][-1] >> GROUP << GROUP))
            if last:
                yield held[0][:last], held[1][:last]
                held = [h[last:] for h in held]
    if len(held[0]):
        yield held[0], held[1]


#: Bits of a code below its context of TOP bytes.
GROUP = 8 * (DEPTH + 1 - TOP)


def top_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for code, n in _subtrees(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in Subtrees(code, n).top()], ["key", "level", "zeros", "ones", "weighted"])


def _logs_udf(above):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _subtrees(batches):
            logs = Subtrees(code, n).logs(above.value)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(logs.astype(np.float32))], ["code", "log"])

    return run


def text_scores(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row the sum of the log probabilities of its strings that are in the table: (sorted codes, logs)."""
    known, logs = table
    codes = gram_codes(data, offsets)
    by = np.argsort(codes)
    first, group = groups(codes[by])
    want = codes[by[first]]
    if not len(known):
        return np.zeros(len(offsets) - 1)
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    values = np.empty(len(codes))
    values[by] = np.where(known[at] == want, logs[at], 0.0)[group]
    return np.add.reduceat(values, offsets[:-1] + np.arange(len(offsets) - 1))


def batch_scores(texts: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, offsets = buffer(texts)
    return np.concatenate([np.zeros(0), *(text_scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table) for i, j in runs(offsets, SCORE_BYTES))])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        held.update(chain.from_iterable(t.lower().split() for t in rows_of(batch, "text")))  # bytes: A-Z and ASCII blanks
        if len(held) > FLUSH:
            yield out()
            held.clear()
    if held:
        yield out()


def _sums_udf(shared):
    """(row, score) of the strings of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((part << 40) + np.arange(nth, nth + batch.num_rows)), pa.array(batch_scores(batch.column(0), shared.value))], ["row", "score"])
            nth += batch.num_rows

    return run


def _score_udf(shared):
    """For each document a row with word null; for each of its words that isn't frequent a row with word and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, nth = shared.value, TaskContext.get().partitionId(), 0
        frequent = m["frequent"]
        end, end_known = m["end"]
        for batch in batches:
            names = batch.schema.names
            scores = batch_scores(batch.column(names.index("text")), m["table"])
            n_tokens, n_known, base, key, words, counts = [], [], [], [], [], []
            for k, text in enumerate(rows_of(batch, "text")):
                tokens = text.lower().split()
                logs = list(map(frequent.get, tokens))
                missing = logs.count(None)
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(tokens) - missing + end_known)
                if missing:
                    rare = Counter(t for t, x in zip(tokens, logs) if x is None)
                    key.extend([part << 40 | nth + k] * len(rare))
                    words.extend(rare.keys())
                    counts.extend(rare.values())
                    base.append(sum(x for x in logs if x is not None) + end)
                else:
                    base.append(sum(logs) + end)
            n, r = batch.num_rows, len(words)
            own = pa.array((part << 40) + np.arange(nth, nth + n))
            nulls = lambda kind, size: pa.nulls(size, kind)
            columns = [
                pa.concat_arrays([own, pa.array(key, pa.int64())]),
                pa.concat_arrays([nulls(pa.binary(), n), pa.array(words, pa.binary())]),
                pa.concat_arrays([pa.array(n_tokens, pa.int64()), pa.array(counts, pa.int64())]),
                pa.concat_arrays([pa.array(n_known, pa.int64()), nulls(pa.int64(), r)]),
                pa.concat_arrays([pa.array(base, pa.float64()), nulls(pa.float64(), r)]),
                pa.concat_arrays([pa.array(scores), nulls(pa.float64(), r)]),
            ]
            carried = [pa.concat_arrays([batch.column(c), nulls(batch.column(c).type, r)]) for c in range(len(names)) if names[c] != "text"]
            yield pa.RecordBatch.from_arrays([*columns, *carried], ["row", "word", "n", "known", "base", "score", *(x for x in names if x != "text")])
            nth += n

    return run


def lm_scores(spark: SparkSession, docs: DataFrame, learn: str = "learn", id_col: str = "doc_id", keep: tuple[str, ...] = (), frequent: int = 100_000, smooth: float = 0.1, shard: int = 8_000_000) -> DataFrame:
    """One row per row of docs: id, the columns of keep, n_tokens, n_known, train_tokens, base_score, score.

    The boolean column `learn` marks the rows to learn from (null: not). Tokens are the words with A-Z lower-cased, then one
    end, which no word equals. base_score is the sum of log10((c + smooth) / (N + smooth (V + 1))); score the log10
    probability of the text by context-tree weighting. Null is empty: one token, the end. Without training rows c, N and V
    are 0 and every byte's choices have probability one half. `shard` strings (12 bytes each) are broadcast at once; a model
    of more takes as many passes over the texts.
    """
    bound_batches(spark)
    scratch, parts = Scratch(spark, "lm"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    learned = docs.where(learn).select("text")
    vocabulary = scratch.save(learned.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = learned.count()
    total, kinds = words + n_train, distinct + (n_train > 0)
    grams = scratch.save(docs.select("text", learn).mapInArrow(count_grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "grams")
    dealt = grams.repartition(parts, F.shiftright("code", GROUP)).sortWithinPartitions("code")
    top = dealt.mapInArrow(top_nodes, NODE_SCHEMA).toArrow()  # at most 65,793 x 255 rows
    above = spark.sparkContext.broadcast(Above(*(top.column(k).to_numpy() for k in range(5))))
    del top
    logs = scratch.save(dealt.mapInArrow(_logs_udf(above), "code long, log float"), "logs")
    shards = max(1, -(-logs.count() // shard))

    def table(k: int) -> tuple[np.ndarray, np.ndarray]:
        found = logs.where(F.pmod(F.xxhash64("code"), F.lit(shards)) == k).toArrow()
        code, log = found.column("code").to_numpy(), found.column("log").to_numpy()
        del found
        by = np.argsort(code)
        return code[by], log[by]

    def log10_of(c: float) -> float:
        return float(np.log10((c + smooth) / (total + smooth * (kinds + 1)))) if total + smooth * (kinds + 1) else 0.0

    often = vocabulary.orderBy(F.col("c").desc(), "word").limit(frequent).toArrow()
    known = {w: log10_of(c) for w, c in zip(often.column("word").to_pylist(), often.column("c").to_pylist())}
    shared = spark.sparkContext.broadcast({"table": table(0), "frequent": known, "end": (log10_of(n_train), int(n_train > 0))})
    src = docs.select(F.col(id_col).alias("id"), *keep, "text")
    if shards > 1:  # all passes number the same rows
        src = scratch.save(src, "texts")
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    scored = scratch.save(src.mapInArrow(_score_udf(shared), f"row long, word binary, n long, known long, base double, score double{kept}"), "parts")
    rare = scored.where("word is not null").select("row", "word", "n").join(vocabulary, "word", "left")
    log_p = F.log10((F.coalesce("c", F.lit(0)) + smooth) / F.lit(total + smooth * (kinds + 1)))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * log_p).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = scored.where("word is null").join(sums, "row", "left")
    shared.unpersist()
    more = None
    for k in range(1, shards):
        shared = spark.sparkContext.broadcast(table(k))
        sums = scratch.save(src.select("text").mapInArrow(_sums_udf(shared), "row long, score double"), f"shard{k}")
        more = sums if more is None else more.unionAll(sums)
        shared.unpersist()
    if more is not None:
        out = out.join(more.groupBy("row").agg(F.sum("score").alias("beyond")), "row")
    return out.select(
        F.col("id").alias(id_col),
        *keep,
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + (F.col("beyond") if more is not None else F.lit(0.0))).alias("score"),
    )
