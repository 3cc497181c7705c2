"""Language-model scores against slow versions, and against each other."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm.common import documents
from brindle.llm.language_model import DEPTH, EDGE, Above, Subtrees, count_grams, estimate, gram_codes, lm_scores, log_gamma, tally
from brindle.llm.queries import op7_lm_scoring


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def base_scores(train, texts):
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()) + len(train), len(counts) + (len(train) > 0)
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    out = []
    for t in texts:
        tokens = words(t)
        out.append((len(tokens) + 1, sum(counts[w] > 0 for w in tokens) + (len(train) > 0), n, sum(log(counts[w]) for w in tokens) + log(len(train))))
    return out


class SlowTree:
    """Context-tree weighting by its recursion, on the counts of some texts.

    A context is a tuple of bytes, the last one first.
    """

    def __init__(self, texts):
        self.counts, self.kept = Counter(), {()}
        for t in texts:
            seen = [EDGE] * DEPTH + list((t or "").encode()) + [EDGE]
            for k in range(DEPTH, len(seen)):
                for d in range(DEPTH + 1):
                    context = tuple(seen[k - d : k][::-1])
                    self.kept.add(context)
                    for bit in range(8):
                        self.counts[context, seen[k] >> (8 - bit) | 1 << bit, seen[k] >> (7 - bit) & 1] += 1
        self.children = {c: [] for c in self.kept}
        for c in self.kept - {()}:
            self.children[c[:-1]].append(c)

    def pair(self, context, node):
        return self.counts[context, node, 0], self.counts[context, node, 1]

    @staticmethod
    def own(pair):
        a, b = pair
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    @cache
    def weighted(self, context, node):
        if not self.children[context]:
            return self.own(self.pair(context, node))
        below = sum(self.weighted(c, node) for c in self.children[context])
        return np.logaddexp(self.own(self.pair(context, node)), below) - math.log(2)

    def choice(self, history, node, bit):
        out, left, d = 0.0, 1.0, 0
        while True:
            context = history[:d]
            pair = self.pair(context, node)
            here = (pair[bit] + 0.5) / (sum(pair) + 1)
            if not self.children[context]:
                return out + left * here
            share = math.exp(self.own(pair) - math.log(2) - self.weighted(context, node))
            out, left, d = out + left * share * here, left * (1 - share), d + 1
            if history[:d] not in self.kept:
                return out + left / 2

    def score(self, text):
        seen, total = [EDGE] * DEPTH + list((text or "").encode()) + [EDGE], 0.0
        for k in range(DEPTH, len(seen)):
            history = tuple(seen[k - DEPTH : k][::-1])
            total += sum(math.log10(self.choice(history, seen[k] >> (8 - bit) | 1 << bit, seen[k] >> (7 - bit) & 1)) for bit in range(8))
        return total


TRAIN = ["the cat sat on the mat", "The cat ran", "été à la mer", "", None, "aaa bbb aaa"]
SCORED = ["the cat", "THE mat sat", "zzz new words", None, "", "é x y\x1cz", "a" * 3000]


def learnable(spark, texts, learn_from=()):
    rows = [(i, t, 1, 2, False) for i, t in enumerate(texts)] + [(-1, t, 1, 2, True) for t in learn_from]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, base int, learn boolean")


@pytest.mark.parametrize("shard", [8_000_000, 100])
def test_scores_equal_the_recursion(spark, shard):
    got = lm_scores(spark, learnable(spark, SCORED, TRAIN), frequent=3, shard=shard).where("doc_id >= 0").collect()
    tree = SlowTree(TRAIN)
    assert len(got) == len(SCORED)
    for r, text, (n, known, total, base) in zip(sorted(got, key=lambda r: r.doc_id), SCORED, base_scores(TRAIN, SCORED)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(tree.score(text), rel=1e-5)


def test_probabilities_sum_to_one():
    codes, n = tally(gram_codes(np.frombuffer(b"abracadabra" * 3, np.uint8), np.array([0, 11, 22, 33])))
    contexts = np.unique(codes >> 8)
    every = (contexts[:, None] << 8 | np.arange(256)).ravel()
    tree = Subtrees(*tally(np.concatenate((codes, every)), np.concatenate((n, np.zeros(len(every), np.int64)))))
    p = 10.0 ** tree.logs(Above(*tree.top()))
    assert np.abs(p.reshape(len(contexts), 256).sum(axis=1) - 1).max() < 1e-12


def test_estimate_of_small_and_large_counts():
    zeros, ones = np.array([0, 3, 4000, 5000, 10**7]), np.array([0, 2, 4000, 0, 1])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5) for a, b in zip(zeros.tolist(), ones.tolist())]
    assert np.allclose(estimate(zeros, ones), want, rtol=1e-10, atol=1e-8)


def test_tally():
    codes, n = tally(np.array([5, 1, 5, 5]))
    assert (codes.tolist(), n.tolist()) == ([1, 5], [1, 3])
    codes, n = tally(np.array([5, 1, 5]), np.array([2, 3, 4]))
    assert (codes.tolist(), n.tolist()) == ([1, 5], [3, 6])
    assert [len(x) for x in tally(np.zeros(0, np.int64))] == [0, 0]


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 10, 1e3, 1e7])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_no_training_rows_and_no_rows(spark):
    docs = learnable(spark, ["ab"])
    r = lm_scores(spark, docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(24 * math.log10(0.5))
    assert lm_scores(spark, docs.limit(0)).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "new rare", False), (1, "new rare", None), (None, "the", False), (2, "the the", True)], "doc_id long, text string, learn boolean")
    got = lm_scores(spark, docs, frequent=1).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3, 3]
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_the_model_grows_with_the_texts(spark):
    """A context that is rare beside the others still counts: a deep one seen once predicts its byte."""
    rare = learnable(spark, ["qzxwvk"], ["qzxwvk", *["the cat sat on the mat"] * 500])
    without = learnable(spark, ["qzxwvk"], ["the cat sat on the mat"] * 500)
    of = lambda docs: lm_scores(spark, docs).where("doc_id = 0").first().score
    assert of(rare) > of(without) + 3


def test_query_base(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    want = base_scores([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows])
    got = {r.doc_id: r for r in op7_lm_scoring(spark, sf_dir).collect()}
    for r, (n, known, total, base) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], n, known, total)
        assert g.base_score == pytest.approx(base) and g.score < 0


def test_counting_needs_no_text():
    assert list(count_grams(iter(()))) == []


def test_counting_strings_takes_bounded_memory():
    """A batch of 4 MB used to take 278 MB at its peak."""
    rng = np.random.default_rng(3)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 40_000))) for _ in range(100)])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([True] * 100)], ["text", "learn"])
    tracemalloc.start()
    total = sum(int(b.column(1).to_numpy().sum()) for b in count_grams(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 100 * 40_001 and peak < 220 << 20
