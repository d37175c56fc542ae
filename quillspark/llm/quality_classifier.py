"""Quality scores by positive-unlabelled learning (operator 2).

The model is a logistic function of quantile bins of text statistics. It minimises the non-negative unbiased
risk  pi * R+(P) + max(0, R-(U) - pi * R-(P))  from trusted positives P (labels with quality 1), unlabelled
texts U and the class prior pi; texts labelled 0 enter only through pi, the share of 1 among training labels.

Labels are read only where crc32(doc_id as text) mod 4 is not 2, and U has only such rows too. P and U are
samples of about ``SAMPLE`` rows each by a hash of the id (a documented bound); every row is scored.

Defined results: null and empty texts are scored by their statistics, all 0; null ids are never in a sample
and count as not held out; repeated rows are scored each; an empty table gives an empty result; without
labels, or without any unlabelled text, every score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import TEXT_FEATURES, stats
from ._text import blocks

#: Rows of either sample.
SAMPLE = 8000
#: Scores from here on are predicted as quality 1.
THRESHOLD = 0.7
BINS = 8


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray):
        self.edges, self.weights = edges, weights

    def design(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        out[:, -1] = 1
        for j in range(x.shape[1]):
            out[np.arange(len(x)), j * BINS + np.searchsorted(self.edges[j], x[:, j], "left")] = 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.weights[-1])
        for j in range(x.shape[1]):
            z += self.weights[j * BINS + np.searchsorted(self.edges[j], x[:, j], "left")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-3) -> Model:
    """Adam over the full samples; where the estimated negative risk falls below 0, its gradient is reversed."""
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.arange(1, BINS) / BINS, axis=0).T
    # shares are mostly 0: upper tails need their own edges
    edges[:, -3:] = np.quantile(both, [0.9, 0.95, 0.98], axis=0).T
    edges.sort(axis=1)
    model = Model(edges, np.zeros(both.shape[1] * BINS + 1))
    p, u = model.design(positive), model.design(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    m = v = np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        zp, zu = p @ model.weights, u @ model.weights
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        push = -prior * (p * (1 - sigmoid(zp))[:, None]).mean(0)
        pull = (u * sigmoid(zu)[:, None]).mean(0) - prior * (p * sigmoid(zp)[:, None]).mean(0)
        g = (push + pull if negative >= 0 else -pull) + decay * model.weights * (np.arange(len(model.weights)) < len(model.weights) - 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weights = model.weights - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, to in blocks(batch):
                x = stats(block).features
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _sampled(ids: DataFrame, salt: int, bound: int) -> DataFrame:
    """About ``bound`` rows at most, by a hash of the id."""
    n = ids.count()
    part = min(1.0, bound / max(n, 1))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < int(part * (1 << 20)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None without positives or unlabelled texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rate = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("ones")).head()
    if not rate["ones"]:
        return None
    prior = (rate["ones"] + 1) / (rate["n"] + 2)
    trusted = _sampled(known.where("quality = 1").select("doc_id"), 1, sample)  # bounded by the sample
    positive = _measured(docs.join(F.broadcast(trusted), "doc_id", "left_semi")).select("x").collect()
    unlabelled = _measured(_sampled(docs.select("doc_id", "text"), 2, sample)).select("x").collect()
    if not positive or not unlabelled:
        return None
    return fit(np.array([r[0] for r in positive]), np.array([r[0] for r in unlabelled]), prior)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``_score double`` after its own columns; text is a string column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if sent.value is not None:
                for block, at, to in blocks(batch):
                    score[at:to] = sent.value.score(stats(block).features)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, docs.withColumn("_score", F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if sent.value is not None:
                for block, at, to in blocks(batch):
                    score[at:to] = sent.value.score(stats(block).features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = plain.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, unchanged."""
    names = docs.columns
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    return scored(plain, train(docs, labels)).where(F.col("_score") >= THRESHOLD).drop("_score").toDF(*names)


__all__ = ["THRESHOLD", "TEXT_FEATURES", "Model", "fit", "good_documents", "held_out", "quality", "scored", "train"]
