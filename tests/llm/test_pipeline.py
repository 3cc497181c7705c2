"""Stages of the pipeline against brute force on a small fixture, and on the small table."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from brindle.llm import near_dedup
from brindle.llm.common import Scratch
from brindle.llm.components import components
from brindle.llm.near_dedup import near_groups, sketch, sketch_distance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def prose(rng, n, words=3000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def changed(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"n{rng.randrange(10**6)}"
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_groups(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 200)), "a") for i in range(30)]
    for k in range(12):
        base = prose(rng, 250)
        rows += [(100 + 10 * k + j, " ".join(changed(rng, base, 4)), "a") for j in range(4)]
        rows += [(100 + 10 * k + 5, " ".join(changed(rng, base, 60)), "a")]
    rows += [(500, None, "a"), (501, "", "a"), (502, "one two", "a"), (503, "One  two", "a")]
    got = {r.row: r.root for r in near_groups(spark, frame(spark, rows).withColumnRenamed("doc_id", "row"), "row").collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if r != i}


def exact_groups(rows):
    """near_groups by comparing all pairs."""
    sets = {i: shingles(t) for i, t, _ in rows}
    ids, root = sorted(i for i in sets if sets[i]), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids if top(i) != i}


def groups(spark, rows):
    return {r.row: r.root for r in near_groups(spark, frame(spark, rows).withColumnRenamed("doc_id", "row"), "row").collect()}


def test_crowded_keys_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 60)
    rows = [(i, " ".join(changed(rng, base, rng.randrange(1, 7))), "a") for i in range(400)]  # most pairs lie below 0.8
    rows += [(1000 + i, rows[i][1].upper(), "a") for i in range(20)]
    want = exact_groups(rows)
    assert groups(spark, rows) == want
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    assert groups(spark, rows) == want
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)  # all pairs at once
    assert groups(spark, rows) == want


def test_golay_keys_come_first(spark, monkeypatch):
    """Edited copies are linked by Golay keys alone; prefixes only have to find what fingerprints can't reach."""

    def nothing(least, whole):
        def run(batches):
            for _ in batches:
                yield from ()

        return run

    monkeypatch.setattr(near_dedup, "_candidates_udf", nothing)
    rng = random.Random(3)
    rows = [(i, " ".join(prose(rng, 200)), "a") for i in range(30)]
    for k in range(30):
        base = prose(rng, 250)
        rows += [(100 + 10 * k + j, " ".join(changed(rng, base, 2)), "a") for j in range(3)]
    want, got = exact_groups(rows), groups(spark, rows)
    assert len(want) == 60 and set(got) <= set(want) and len(got) >= 57
    many = np.random.default_rng(1).integers(0, 2**63, (40, 2)).astype(np.uint64)
    many[20:] = many[:20] ^ np.uint64(1 << 7)
    a, b = near_dedup.spanning(many)
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == {(i, i + 20) for i in range(20)}


def test_appended_and_truncated_copies(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = prose(rng, 204)
        least = (0.8, 0.85, 0.9)[k % 3]
        n = round(200 * least) + 4  # words whose shingles are that share of all, or a word less
        other = [words[:n], words[-n:], words[: n - 1]][k // 3 % 3] if k < 30 else words + prose(rng, int(200 / least) - 200 + k % 2)
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(other), "a")]
    want = exact_groups(rows)
    assert 40 < len(want) < 60 and groups(spark, rows) == want


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, m, common in ((40, 60, 30), (700, 650, 640), (5000, 900, 850), (1, 1, 0), (129, 127, 127)):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        y = np.unique(np.concatenate((x[:common], rng.integers(-(2**63), 2**63 - 1, m - common))))
        assert sketch_distance(sketch(x), sketch(y)) <= len(np.setxor1d(x, y))
        assert sketch_distance(sketch(x), sketch(x)) == 0


def test_near_groups_of_long_texts(spark):
    rng = random.Random(9)
    base = prose(rng, 150_000, 10**6)
    rows = [(1, " ".join(base), "a"), (2, " ".join(changed(rng, base, 900)), "a"), (3, " ".join(base[:90_000]), "a"), (4, " ".join(base[:140_000]), "a")]
    rows += [(5, "x" * 1_000_000, "a"), (6, "x" * 1_000_000, "a"), (7, "a " * 200_000, "a")]
    assert groups(spark, rows) == {2: 1, 4: 1, 6: 5}


@pytest.mark.parametrize("n", [0, 1, 300])
def test_components(spark, n):
    rng = random.Random(n)
    chain = [(i + 1, i) for i in range(n)]  # a path, the worst shape for stars
    other = [(1000 + max(x), 1000 + min(x)) for x in ([rng.sample(range(200), 2) for _ in range(n)])]
    edges = spark.createDataFrame(chain + other, "a long, b long")
    root = {i: i for e in chain + other for i in e}
    for _ in range(n):
        for a, b in chain + other:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: r for i, r in root.items() if i != r}


def test_exact_stage(spark):
    rows = [(1, "Same", "a"), (2, "same", "a"), (2, "same", "a"), (3, None, "a"), (4, "", "a"), (5, "other", "a")]
    kept = sorted((r.doc_id, r.text) for r in cp.exact(spark, frame(spark, rows), "").collect())
    assert kept == [(2, "same"), (4, ""), (5, "other")]


def test_mix_stage(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(prose(rng, rng.randrange(1, 900))), f"s{i % 4}") for i in range(40)] + [(90, None, "s1"), (91, " \n", "s2")]
    out = cp.mix(spark, frame(spark, rows), "").collect()
    texts = {i: t for i, t, _ in rows}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(count(t) for _, t, _ in rows)
    assert abs(sum(count(r.text) for r in out) - 1.5 * total) < 0.02 * total
    for r in out:
        assert r.n_chars == len(r.text) and all(p in texts[r.doc_id] for p in r.text.split("\n"))
    ids = [r.doc_id for r in out]
    assert max(map(ids.count, ids)) <= 2 and 90 not in ids and 91 not in ids


def test_empty_stages(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_run(spark, sf_dir):
    docs = cp.documents(spark, sf_dir)
    scratch = cp.Scratch(spark, "test")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        assert docs.columns == list(cp.COLUMNS)
        if name != "mix":
            assert 0 < docs.count() <= before
            before = docs.count()
    pieces = cp.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
