"""Language and quality: held-out accuracy, and defined results at the edges."""

from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pytest

from brindle.llm import language_id as language_id_module
from brindle.llm import quality
from brindle.llm.language_id import language_id
from brindle.llm.ngrams import BUCKETS, counts_of
from brindle.llm.quality import quality_scores
from brindle.llm.queries import op3_language_id, op9_quality

BIG = "/root/testdata/sf0.01"


def test_counts_belong_to_their_row():
    texts = ["ab", "", None, "xyz " * 50, "q"]
    together = counts_of(texts, (1, 2, 3), False)
    assert together.shape == (5, BUCKETS)
    for k, t in enumerate(texts):
        assert (counts_of([t], (1, 2, 3), False)[0] == together[k]).all()
    assert together[1].sum() == 1 + 1  # a single blank, and the pair of blanks around nothing


def test_language_held_out(spark):
    rows = op3_language_id(spark, BIG).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.8 * len(held) and np.mean([r.lang_pred == lang[r.doc_id] for r in sure]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def slow_probabilities(model, text):
    """Subwords one by one: hashed, embeddings averaged, a softmax."""
    data = [32, *(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()), 32]
    total, n = np.zeros(len(model.labels)), 0
    for size in language_id_module.SIZES:
        for k in range(max(0, len(data) - size + 1)):
            h = size
            for j, b in enumerate(data[k : k + size]):
                h = (h + (b + 1) * pow(0x9E3779B1, j + 1, 1 << 32)) % (1 << 32)
            total, n = total + model.table[(h * 0x85EBCA6B % (1 << 32)) >> 19], n + 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language_scores_by_single_subwords(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.orderBy("doc_id").collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    model = language_id_module.fit([r.text for r in learn[:400]], [r.lang for r in learn[:400]])
    texts = ["The Cat", "é", "a", "ab cd", "Über den Wolken", None, "x" * 50] + [r.text for r in rows[:25]]
    got = model.probabilities(counts_of(texts, language_id_module.SIZES, True))
    for p, t in zip(got, texts):
        assert p == pytest.approx(slow_probabilities(model, t), abs=1e-4)


def test_ties_have_one_answer(spark):
    """Equal texts get equal answers, also where labels or languages tie."""
    learn = spark.createDataFrame([(i, "same words here", ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(i, "same words here") for i in range(6)], "doc_id long, text string")
    assert len({(r.lang_pred, r.score) for r in language_id(spark, docs, learn).collect()}) == 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    scores = {(r.score, r.predicted) for r in quality_scores(spark, docs, labels).collect()}
    assert len(scores) == 1 and scores.pop()[0] == pytest.approx(0.5)


def test_language_edges(spark):
    learn = spark.createDataFrame([(i, "the cat and the dog " * 3, "en") for i in range(20)] + [(i, "der hund und die katze " * 3, "de") for i in range(20, 40)] + [(50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, 1, 2), (2, "", 1, 2), (3, "123 !?", 1, 2), (4, "the dog", 1, 2), (5, "die katze", 1, 2), (6, "a", 1, 2), (6, "a", 1, 2), (None, "the " * 50_000, 1, 2)], "doc_id long, text string, score int, _text int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id(spark, docs, learn).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "en"
    assert len(got) == 8 and by[6][0] in ("en", "de")
    assert language_id(spark, docs.limit(0), learn).collect() == []
    assert {r.lang_pred for r in language_id(spark, docs, learn.limit(0)).collect()} == {"und"}


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in op9_quality(spark, BIG).collect()}
    labels = [r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect() if r.quality is not None and rows[r.doc_id].held_out]
    score, y = np.array([rows[r.doc_id].score for r in labels]), np.array([r.quality for r in labels])
    assert auc(score, y) > 0.85 and np.mean((score >= 0.5) == (y == 1)) > 0.9
    assert np.mean(score[y == 1] >= 0.5) > 0.98  # clean documents stay
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc !$")) for _ in range(60)) for _ in range(60)]
    labels = [i % 2 for i in range(60)]
    model = quality.fit(texts[:40], labels[:40], 0.5, dim=8, neighbours=5)
    counts = quality.terms(counts_of(texts[40:], quality.SIZES, False), [t.encode() for t in texts[40:]])
    v = model.embed(counts)
    for row, got in zip(v, model.scores(counts)):
        cosine = model.vectors @ row
        near = np.argsort(-cosine)[:5]
        vote = np.maximum(cosine[near], 0) ** 8 * model.weights[near]
        assert got == pytest.approx((vote * model.labels[near]).sum() / vote.sum(), rel=1e-4)


def test_repetition():
    assert quality.repetition(b"a a b\na a b\n") == (2 * quality.WORD_WEIGHT, 5 * quality.BYTE_WEIGHT)
    assert quality.repetition(b"") == (0, 0)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("clean text here " if i % 2 else "$$$ ### !!! ") * 5, 1, 2) for i in range(40)] + [(40, None, 1, 2), (41, "", 1, 2), (41, "", 1, 2), (None, "x" * 200_000, 1, 2)], "doc_id long, text string, quality int, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None), (99, 1)], "doc_id long, quality int")
    got = quality_scores(spark, docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 44 and all(by[i].predicted == i % 2 for i in range(40)) and 0 <= by[40].score <= 1
    assert quality_scores(spark, docs.limit(0), labels).collect() == []
    assert {r.score for r in quality_scores(spark, docs, labels.limit(0)).collect()} == {0.5}


def test_quality_fit_is_off_the_driver(spark):
    """The driver gets the fitted model (about 3 MB), not the sample's counts (20 MB for 600 rows)."""
    docs = spark.createDataFrame([(i, ("clean text here " if i % 2 else "$$$ ### !!! ") * (1 + i % 7)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        scored = quality_scores(spark, docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12_000_000
    assert all(r.predicted == r.doc_id % 2 for r in scored.collect())
