"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from brindle.llm import repeats
from brindle.llm.bwt import repeated_starts
from brindle.llm.common import documents
from brindle.llm.repeats import remove_repeats


def slow_passages(text, count, short, words):
    """Maximal runs of repeated strings of `short` bytes with more than `words` words that lie in them."""
    flags = [False] * len(text)
    for k in range(len(text) - short + 1):
        if count[text[k : k + short]] > 1:
            flags[k : k + short] = [True] * short
    tokens = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    edges = [k for k in range(len(text) + 1) if (k < len(text) and flags[k]) != (k > 0 and flags[k - 1])]
    return sum(sum(a <= x and y <= b for x, y in tokens) > words for a, b in zip(edges[::2], edges[1::2]))


def slow(rows, least, short, words):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    brief = Counter(t[i : i + short] for t in texts for i in range(len(t) - short + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), slow_passages(t, brief, short, words)))
    return sorted(out, key=str)


def check(spark, rows, least, short=None, words=50, **more):
    short = short or least
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row int, h string, id int")
    assert sorted((tuple(r) for r in remove_repeats(spark, df, least=least, short=short, words=words, **more).collect()), key=str) == slow(rows, least, short, words)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, loop = prose(60), "ab" * 150
    rows = [(1, None), (2, ""), (3, "short"), (4, passage), (5, passage), (6, loop), (7, prose(80) + loop[:90] + prose(20))]
    rows += [(i, prose(rng.randrange(60)) + passage[rng.randrange(40) : 100 + rng.randrange(150)] + prose(rng.randrange(60))) for i in range(8, 60)]
    rows += [(60, prose(900)), (61, "=" * 500), (4, passage), (None, passage[3:120])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_fixture(spark, seed):
    check(spark, fixture(seed), 64)
    check(spark, fixture(seed), 150, 64, 9)


def test_split_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 300)  # nearly all anchors are split, down to single windows
    check(spark, fixture(3), 70)
    check(spark, fixture(3), 130, 70, 9)


def test_pieces_of_a_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abc ") for _ in range(3000))
    rows = [(1, long), (2, long[500:1500]), (3, long[100:200])]
    check(spark, rows, 64, piece=700)
    check(spark, rows, 110, 64, 9, piece=700)


def test_text_of_more_than_eight_mebibytes(spark):
    rng = random.Random(6)
    half = rng.randbytes(5 << 20).hex()[: 8_900_000]
    rows = [(1, half), (2, half[8_388_000:8_389_500]), (3, half[100:700]), (4, "z" * 300 + half[8_899_000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark, df).collect()}
    assert got == {1: (8_900_000, 1500 + 600 + 1000, 3), 2: (1500, 1500, 1), 3: (600, 600, 1), 4: (1300, 1000, 1)}


def test_passages_of_less_than_400_bytes(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage, brief = prose(66), prose(45)
    assert 330 < len(passage) < 400 and len(brief) > 230
    rows = [(i, f"{prose(90)} {passage} {prose(40)}") for i in range(3)] + [(i, f"{prose(90)} {brief} {prose(40)}") for i in range(3, 6)] + [(6, prose(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_passages) for r in remove_repeats(spark, df).collect()}
    assert got == {i: (0, int(i < 3)) for i in range(7)}


def slow_shared(rows, window):
    """Maximal runs of words under windows that occur in two rows or more."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    holders = Counter(x for w in words for x in {tuple(w[k : k + window]) for k in range(len(w) - window + 1)})
    out = []
    for (i, _), w in zip(rows, words):
        under = [False] * len(w)
        for k in range(len(w) - window + 1):
            if holders[tuple(w[k : k + window])] > 1:
                under[k : k + window] = [True] * window
        out.append((i, sum(u and not (k and under[k - 1]) for k, u in enumerate(under))))
    return sorted(out, key=str)


def check_shared(spark, rows, words, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_passages) for r in remove_repeats(spark, df, words=words, **more).collect()), key=str)
    assert got == slow_shared(rows, words + 1)
    return dict(got)


def test_passages_across_documents(spark):
    """Passages of 51 short words (below 256 bytes) count, one of 50 doesn't, nor one that repeats in its own document only; white space doesn't matter."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 6))) for _ in range(n))
    passage, brief, own = prose(51), prose(50), prose(120)
    assert len(passage) < 256 and len(own) > 400
    rows = [(1, f"{prose(90)} {passage} {prose(40)}"), (2, f"{prose(30)}\n{passage.replace(' ', chr(10), 3)}\t{prose(9)} {passage}"), (3, f"{brief} {prose(20)}")]
    rows += [(4, f"{prose(20)} {brief}"), (5, f"{own} {prose(30)} {own}"), (6, prose(300)), (7, None)]
    assert check_shared(spark, rows, 50) == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


@pytest.mark.parametrize("words", [2, 9])
def test_shared_windows(spark, monkeypatch, words):
    check_shared(spark, fixture(4), words)
    long = " ".join(t or "" for _, t in fixture(5))
    check_shared(spark, [*fixture(4), (70, long), (71, long[300:900])], words, piece=700)
    monkeypatch.setattr(repeats, "LISTS_BYTES", 30)  # nearly all windows are counted one by one
    check_shared(spark, fixture(4), words)


def test_shared_windows_of_the_small_table(spark, sf_dir):
    check_shared(spark, [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()], 50)


def test_word_hashes_in_pieces():
    text = (b"ab  c " + b"x" * 90 + b"\n\n" + "é ü".encode()) * 40 + b"y" * 300
    data = repeats.np.frombuffer(text, repeats.np.uint8)
    whole = repeats.word_hashes(data, repeats.np.array([0, len(text)]))[1]
    words = text.split()
    assert len(whole) == len(words) and len(set(zip(whole.tolist(), words))) == len(set(words)) == len(set(whole.tolist()))
    for piece in (7, 64, 1000):
        assert (repeats.word_hashes(data, repeats.np.array([0, len(text)]), piece)[1] == whole).all()


def test_whole_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    check(spark, rows, 400, 320)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(spark, df).collect() == []


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "x" + "abcdefgh" * 10), (2, "abcdefgh" * 10 + "y")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark, df, least=64, short=64, with_text=True).collect()}
    assert got == {1: b"x", 2: b"y"}


def test_expansion_against_counts():
    rng = random.Random(2)
    for _ in range(200):
        lengths, base = rng.choice([(1,), (3, 8), (8, 9), (9, 20), (20,)]), "".join(rng.choice("abc") for _ in range(50))
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(30))) + base[rng.randrange(50) :] for _ in range(rng.randrange(1, 6))]
        windows = [rng.randrange(1, len(t) + 2) for t in texts]
        got = repeated_starts([t.encode() for t in texts], lengths, windows)
        for least, flags in zip(lengths, got):
            starts = [[i < w and i + least <= len(t) for i in range(len(t) + 1)] for t, w in zip(texts, windows)]
            count = Counter(t[i : i + least] for t, s in zip(texts, starts) for i in range(len(t)) if s[i])
            assert flags.tolist() == [s[i] and count[t[i : i + least]] > 1 for t, s in zip(texts, starts) for i in range(len(t) + 1)]
