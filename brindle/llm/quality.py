"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become idf-weighted shares of byte n-grams and of two terms for repetition (words equal to the one
before, lines seen before), projected on the leading singular vectors
of a bounded labelled sample (`per_label` rows of each label) and normalised. One task fits the model, so the
driver never holds the sample's texts and counts; the sample's vectors
and the projection go through it and are broadcast: their size is fixed by the parameters. Every document's cosines to
all labelled vectors are computed exactly, a block of documents at a time; the `neighbours` nearest
vote with their similarity, each label scaled back to its share among the labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, rows_of
from .ngrams import BUCKETS, blocks, counts_of, in_order, sample

SIZES = (1, 2, 3)
#: What a repeated word, and a byte of a repeated line, count against n-grams: about as many as start in them.
WORD_WEIGHT, BYTE_WEIGHT = 18.0, 3.0


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # [terms, dim]
    vectors: np.ndarray  # [labelled, dim], normalised
    labels: np.ndarray
    weights: np.ndarray  # of each labelled row, so that a label's votes follow its share
    neighbours: int
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return self.normalised(weigh(counts, self.idf) @ self.axes)

    @staticmethod
    def normalised(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """A text without n-grams that the axes know gets the share of label 1."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        v = self.embed(counts)
        cosine = v @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8 * self.weights[near]
        total = vote.sum(axis=1)
        out = np.where(total > 1e-12, (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def repetition(text: bytes) -> tuple[float, float]:
    """Weights of words equal to the one before them, and of lines that the text had before."""
    words = text.split()
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += len(line)
        seen.add(line)
    return WORD_WEIGHT * sum(map(eq, words, words[1:])), BYTE_WEIGHT * again


def terms(counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """[rows, BUCKETS + 2]: n-gram counts and the terms for repetition."""
    return np.concatenate((counts, np.array([repetition(t) for t in texts], np.float32).reshape(-1, 2)), axis=1)


def weigh(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Shares of a text's n-grams, square-rooted and idf-weighted: long and short texts compare."""
    share = np.divide(counts, np.maximum(counts.sum(axis=1, keepdims=True), 1), out=out)
    np.sqrt(share, out=share)
    share *= idf
    return share


def fit(texts: list[str | None], labels: list[int], prior: float, dim: int = 48, neighbours: int = 15) -> QualityModel:
    y = np.array(labels, float)
    if not len(y):
        return QualityModel(np.ones(BUCKETS + 2, np.float32), np.zeros((BUCKETS + 2, 1), np.float32), np.zeros((0, 1), np.float32), y, y, neighbours, prior)
    x = terms(counts_of(texts, SIZES, False), [(t or "").encode() for t in texts])
    idf = np.log((1 + len(y)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x = weigh(x, idf, out=x)
    values, left = np.linalg.eigh(x @ x.T)  # singular vectors of the sample, through its small Gram matrix
    top = np.argsort(-values)[: min(dim, len(y))]
    top = top[values[top] > 1e-9]
    axes = (x.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
    model = QualityModel(idf, axes, np.zeros(0), y, np.ones(len(y)), neighbours, prior)
    model.vectors = model.normalised(x @ axes).astype(np.float32)
    share = max(y.mean(), 1e-9)
    if 0 < y.mean() < 1:  # the sample has labels in other shares than the table
        model.weights = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return model


def _fit_udf(prior: float):
    """Rows (text, quality), all in one task; out: the model, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = in_order([row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
        model = fit([r[0] for r in rows], [r[1] for r in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_label: int = 1000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of keep, score (0 to 1, higher: label 1 likelier), predicted.

    labels has id and quality (0 or 1; other rows are left out), for rows of docs that the model may learn
    from. The sample is drawn from the labels, so the documents' texts meet at most 2 x per_label broadcast
    ids and are never shuffled. Null and empty texts are scored like others: as a text of a single blank.
    Without labelled rows every score is 0.5.
    """
    bound_batches(spark)
    usable = labels.where("quality in (0, 1)").select(id_col, "quality")
    share = usable.agg(F.avg("quality")).first()[0]
    chosen = sample(usable, "quality", per_label, id_col)
    prior = 0.5 if share is None else float(share)
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select("text", "quality").repartition(1)
    fitted = rows.mapInArrow(_fit_udf(prior), "model binary").first()
    model = fit([], [], prior) if fitted is None else pickle.loads(fitted[0])
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            texts, scored, at = rows_of(batch, "text"), [np.zeros(0)], 0
            for counts in blocks(batch.column(names.index("text")), SIZES, False):
                scored.append(m.scores(terms(counts, texts[at : at + len(counts)])))
                at += len(counts)
            score = np.concatenate(scored)
            new = {c: batch.column(k) for k, c in enumerate(names) if c != "text" or "text" in keep}
            new |= {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(new.values()), list(new))

    src = docs.select(F.col(id_col), *keep, *(() if "text" in keep else ("text",)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "text" or "text" in keep)
    return src.mapInArrow(predict, f"{kept}, score double, predicted int")
