"""Packing: pieces, checksums, gapless sequences, and how full they are."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from tokenizers import Tokenizer

from brindle.llm.common import documents
from brindle.llm.packing import configurations, default_ranks, pack, plan, token_ids


def slots(runs):
    placed = defaultdict(list)
    for r in runs:
        for k in range(r.count):
            placed[r.sequence + k // r.per_sequence].append((r.offset + k % r.per_sequence * r.length, r.length))
    return placed


def check_plan(histogram, capacity, runs, sequences):
    ranks = defaultdict(list)
    for r in runs:
        ranks[r.length].append((r.rank, r.rank + r.count))
    for n in range(1, capacity + 1):
        at = 0
        for a, b in sorted(ranks[n]):
            assert a == at
            at = b
        assert at == histogram[n]
    placed = slots(runs)
    assert sorted(placed) == list(range(sequences))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end = offset + length
        assert end <= capacity


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(0, 9), min_size=64, max_size=64), hs.integers(1, 20))
def test_plans_are_valid(counts, groups):
    histogram = np.array([0, *counts])
    runs, sequences = plan(histogram, 64, groups)
    check_plan(histogram, 64, runs, sequences)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    runs, sequences = plan(histogram, 1024)
    check_plan(histogram, 1024, runs, sequences)
    assert sequences <= 1.003 * -(-int((histogram * np.arange(1025)).sum()) // 1024)


def test_configurations_meet_demand():
    got = configurations([700, 400, 300], [5, 7, 4], 1024)
    used = [sum(use.get(i, 0) * times for use, times in got) for i in range(3)]
    assert used == [5, 7, 4] and all(sum([700, 400, 300][i] * n for i, n in use.items()) <= 1024 for use, _ in got)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pack(df, rows, tokenizer):
    got = [r.asDict() for r in df.collect()]
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - start) % 1024 or 1024
            want.append((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start, piece = start + length, piece + 1
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    return len(placed), -(-sum(r["length"] for r in got) // 1024)


def test_whole_small_table(spark, sf_dir, tokenizer):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    used, least = check_pack(pack(spark, documents(spark, sf_dir)), rows, tokenizer)
    assert used <= 1.05 * least


def test_cases(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 3000), (5, "é\n\n  x <|endoftext|> y"), (6, "=" * 9000)]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, length int, part int")
    check_pack(pack(spark, df), rows, tokenizer)
    assert pack(spark, df.limit(0)).collect() == []


def test_ranks_equal_tokenizer(spark, sf_dir, tokenizer):
    for r in documents(spark, sf_dir).select("text").collect():
        assert token_ids(r.text, default_ranks()).tolist() == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
