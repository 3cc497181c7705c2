"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams of the text with A-Z lower-cased, hashed to buckets. A text is the mean of
its buckets' embeddings; one linear layer scores the languages. Embeddings and layer are learned by
stochastic gradient descent in numpy on the driver, from a bounded sample (`per_label` rows of each
language). A part of that sample, kept from training, calibrates: a temperature for the softmax, and
the least score at which answers there were right often enough (`precision`); below it the answer
is marked rejected. The fitted model is one table of BUCKETS x languages floats, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .ngrams import BUCKETS, blocks, counts_of, in_order, sample

SIZES = (2, 3, 4)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # of each bucket, its embedding times the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / np.maximum(counts.sum(axis=1, keepdims=True), 1) + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 20, rate: float = 0.5, seed: int = 1, precision: float = 0.99) -> LanguageModel:
    """Learns from (text, label); without any rows the model knows no language and answers `und`."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    x = counts_of(texts, SIZES, True)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    y = np.searchsorted(names, labels)
    order = rng.permutation(len(y))
    held, train = np.split(order, [len(order) // 5])
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    scale = 40.0  # means of many small parts are short; longer steps for the embeddings
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            if not len(batch):
                continue
            mean = x[batch] @ embed
            p = softmax(mean @ layer + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            down = p @ layer.T
            layer -= step * (mean.T @ p)
            bias -= step * p.sum(axis=0)
            embed -= step * scale * (x[batch].T @ down)
    model = LanguageModel(names, (embed @ layer).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        logits = x[held] @ model.table + bias
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        down = np.argsort(-score, kind="stable")
        enough = np.flatnonzero(np.cumsum(right[down]) >= precision * np.arange(1, len(down) + 1))
        model.reject_below = float(score[down[enough[-1]]]) if len(enough) else 1.0
    return model


def language_id(spark: SparkSession, docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", per_label: int = 600, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, lang_pred, score, rejected.

    learn_from has text and lang (null lang: not used). lang_pred is `und`, with score 0, where the
    text is null or has no letter; else one of the learned values. Long and short texts count whole.
    """
    bound_batches(spark)
    rows = in_order(sample(learn_from.where("lang is not null and text is not null"), "lang", per_label, id_col).select("text", "lang").collect())
    model = fit([r[0] for r in rows], [r[1] for r in rows])
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, int), np.zeros(n)
            at = 0
            for counts in blocks(batch.column(batch.num_columns - 2), SIZES, True) if m.labels else ():
                p = m.probabilities(counts)
                best[at : at + len(p)], score[at : at + len(p)] = p.argmax(axis=1), p.max(axis=1)
                at += len(p)
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & bool(m.labels)
            lang = [m.labels[b] if k else "und" for b, k in zip(best.tolist(), letters.tolist())]
            score = np.where(letters, np.clip(score, 0, 1), 0.0)
            rejected = (score < m.reject_below) | ~letters
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang), pa.array(score), pa.array(rejected)], [*batch.schema.names[:-2], "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col), *keep, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])
    return src.mapInArrow(predict, f"{kept}, lang_pred string, score double, rejected boolean")
