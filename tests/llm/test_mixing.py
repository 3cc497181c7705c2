"""Mixing: targets by a second way, permutations, and what every document and source gives."""

from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm.common import documents
from brindle.llm.mixing import WORD, mix_sources, permuted, targets


def test_targets():
    assert targets([100, 100, 100]) == [200.0, pytest.approx(250 * 2 / 3), pytest.approx(250 / 3)]
    assert targets([0, 10]) == [0.0, 15.0] and targets([]) == [] and targets([0]) == [0.0]
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 1000, rng.integers(1, 12)).tolist()
        got, total = targets(sizes), 1.5 * sum(sizes)
        assert sum(got) == pytest.approx(total) and all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes))
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        free = [t / w for t, w, n in zip(got, weights, sizes) if n and t < 2 * n - 1e-6]
        assert not free or max(free) == pytest.approx(min(free))
        level = max(free, default=float("inf"))
        assert all(2 * n / w <= level + 1e-6 for t, w, n in zip(got, weights, sizes) if n and t >= 2 * n - 1e-6)


def slow_targets(sizes):
    """By the rule's words: shares by weight, what is above twice a size is reshared by weight, until none is above."""
    weight = [Fraction((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    target, pool, open_ = [Fraction(0)] * len(sizes), Fraction(3, 2) * sum(sizes), {i for i, n in enumerate(sizes) if n}
    while pool and open_:
        total = sum(weight[i] for i in open_)
        for i in open_:
            target[i] += pool * weight[i] / total
        pool = sum(max(target[i] - 2 * sizes[i], 0) for i in open_)
        for i in list(open_):
            if target[i] >= 2 * sizes[i]:
                target[i] = Fraction(2 * sizes[i])
                open_.discard(i)
    return [float(t) for t in target]


def test_targets_by_the_rule():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = rng.choice([rng.integers(0, 1000, 40), rng.integers(1, 10**9, 40), rng.pareto(0.5, 40).astype(int)])[: rng.integers(1, 40)].tolist()
        assert targets(sizes) == pytest.approx(slow_targets(sizes))
    many = rng.integers(1, 10**6, 300_000).tolist()
    assert sum(targets(many)) == pytest.approx(1.5 * sum(many))


def test_permutations():
    for n in (1, 2, 3, 10, 1000):
        for key in (1, 99):
            assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))
    assert permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != permuted(np.arange(50), np.full(50, 50), np.full(50, 2)).tolist()


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(re.findall(WORD, t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = dict(zip(names, slow_targets([sizes[s] for s in names])))
    want = sorted((str(i), len(re.findall(WORD, t or "")), sizes[s], round(goal[s], 6)) for i, t, s in docs)
    assert sorted((str(r.id), r.size, r.source_size, round(r.target, 6)) for r in rows) == want
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    of, taken = {str(i): s for i, _, s in docs}, defaultdict(int)
    for r in rows:
        taken[of[str(r.id)]] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(2, sizes[s] / 50, 256)


def test_whole_small_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = mix_sources(spark, docs).taken().collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    again = mix_sources(spark, docs.repartition(7)).taken().collect()
    assert sorted(map(tuple, (r[1:] for r in rows))) == sorted(map(tuple, (r[1:] for r in again)))


def test_cases(spark):
    docs = [(1, None, "a"), (2, "", None), (3, "x " * 700, None), (4, "one", "é"), (5, "w " * 90, "Z"), (6, "v " * 5000, "a")]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], "doc_id long, text string, source string, part int, size int")
    check(mix_sources(spark, df).taken().collect(), docs)
    assert mix_sources(spark, df.limit(0)).taken().collect() == []
    only = spark.createDataFrame([(1, " ", "a")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in mix_sources(spark, only).taken().collect()] == [(1, 0, 0, 0.0, 0)]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s")], "doc_id long, text string, source string")
    assert mix_sources(spark, df).taken().count() == 3


def test_slots(spark, sf_dir):
    mix = mix_sources(spark, documents(spark, sf_dir), shards=8)
    slots = mix.slots.collect()
    per = defaultdict(set)
    for r in slots:
        per[r.shard].add(r.slot)
    assert all(v == set(range(len(v))) for v in per.values()) and len(slots) == sum(map(len, per.values()))
    times = defaultdict(int)
    for r in slots:
        times[r.src, r.block] += 1
    assert max(times.values()) <= 2
