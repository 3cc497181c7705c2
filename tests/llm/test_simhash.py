"""Fingerprints and components against brute force, on a fixture and on the whole small table."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brindle.llm.common import documents
from brindle.llm.simhash import BLOCK_MAX, close_pairs, fuzzy_keys, simhash_components


def slow_print(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    fps = {i: slow_print(t) for i, t in rows}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(spark, df).collect()}
    assert got == slow_components(rows)


def test_small_fixture(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "ONE two"), (6, "é x y z k l")]
    for i in range(7, 60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = simhash_components(spark, df)
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]


def test_whole_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    check(spark, rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "q r s t u"), (5, "a b c d"), (5, "v w x y z")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash_components(spark, df).collect()), key=str)
    assert got == [("5", 5), ("5", 5), ("None", 5), ("None", None)]


def test_long_texts(spark):
    rng = random.Random(11)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-1])), (3, "y" * 3_000_000), (4, "Y" * 3_000_000), (5, "b " * 500_000)]
    check(spark, rows)


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    keys = [set() for _ in a]
    for row, key in zip(*(x.tolist() for x in fuzzy_keys(a))):
        keys[row].add(key)
    other = [set() for _ in a]
    for row, key in zip(*(x.tolist() for x in fuzzy_keys(b))):
        other[row].add(key)
    assert all(x & y for x, y in zip(keys, other))


def test_probing_equals_pairs():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(seeds[rng.integers(0, 40, 6000)] ^ (np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64)))
    assert len(fps) > BLOCK_MAX
    want = {(min(i, j), max(i, j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist() if i != j}
    a, b = close_pairs(fps)
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
