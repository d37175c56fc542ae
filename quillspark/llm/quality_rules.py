"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate (operator 5).

Lines are split at line feeds; only lines with a word are labelled. Features of a line are shares (words,
symbols, capitals, digits, repetition, end of sentence, earlier equal line). Viterbi decoding labels the lines
of a text jointly; the share of words in content lines decides whether the text is retained.

The weights are fitted by maximum likelihood (forward-backward) on all lines of at most about ``SAMPLE``
labelled texts (a documented bound): lines of texts with quality 1 are taken as content, of quality 0 as
boilerplate, from rows where crc32(doc_id as text) mod 4 is not 2. A quadratic penalty draws them to ``PRIOR``,
which also serves where there are no labels.

Defined results: null and empty texts have no words and fail the base rule; repeated rows count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import LINE_FEATURES, stats
from ._text import blocks
from .quality_classifier import _sampled, held_out

SAMPLE = 3000
#: Retained texts have at least this share of words in content lines.
SHARE = 0.5
#: Weights of boilerplate against content for LINE_FEATURES; then the gain of staying in a state.
PRIOR = np.array([-1.5, 0.8, 0.2, 0.6, 3.0, 2.0, 3.0, 2.0, 2.0, 4.0, 2.0, 0.5])
STATES = ("content", "boilerplate")


def _steps(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each line in its text, and lines by place: order and bounds."""
    n = len(text)
    new = np.ones(n, bool)
    new[1:] = text[1:] != text[:-1]
    start = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange((place.max() if n else -1) + 2))
    return place, order, bounds


def viterbi(x: np.ndarray, text: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """True for boilerplate. Lines stand by text; all texts move a line at a time."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    gain, stay = x @ weights[:-1], weights[-1]
    _, order, bounds = _steps(text)
    best = np.zeros((n, 2))
    back = np.zeros((n, 2), np.int8)
    for k in range(len(bounds) - 1):
        at = order[bounds[k] : bounds[k + 1]]
        if k:
            was = best[at - 1]
            from_other = was[:, ::-1]
            back[at] = np.where(was + stay >= from_other, [0, 1], [1, 0])
            best[at] = np.maximum(was + stay, from_other)
        best[at, 1] += gain[at]
    out = np.zeros(n, np.int8)
    for k in range(len(bounds) - 2, -1, -1):
        at = order[bounds[k] : bounds[k + 1]]
        last = (at + 1 == n) | (text[np.minimum(at + 1, n - 1)] != text[at])
        after = np.minimum(at + 1, n - 1)
        out[at] = np.where(last, best[at, 1] > best[at, 0], back[after, out[after]])
    return out.astype(bool)


def marginals(x: np.ndarray, text: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """P(boilerplate) by line, the expected number of staying steps, and the log partition sum."""
    n = len(text)
    gain, stay = x @ weights[:-1], weights[-1]
    _, order, bounds = _steps(text)
    node = np.stack([np.zeros(n), gain], 1)
    fwd, bwd = node.copy(), np.zeros((n, 2))
    trans = np.array([[stay, 0.0], [0.0, stay]])
    for k in range(1, len(bounds) - 1):
        at = order[bounds[k] : bounds[k + 1]]
        fwd[at] += np.logaddexp.reduce(fwd[at - 1][:, :, None] + trans, axis=1)
    last = np.append(text[1:] != text[:-1], True)
    for k in range(len(bounds) - 2, -1, -1):
        at = order[bounds[k] : bounds[k + 1]]
        at = at[~last[at]]
        bwd[at] = np.logaddexp.reduce(trans + (node[at + 1] + bwd[at + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(fwd[last], axis=1)
    z_of = np.repeat(z, np.diff(np.concatenate([[0], np.flatnonzero(last) + 1])))
    p = np.exp(fwd[:, 1] + bwd[:, 1] - z_of)
    i = np.flatnonzero(~last)
    same = sum(np.exp(fwd[i, s] + stay + node[i + 1, s] + bwd[i + 1, s] - z_of[i]).sum() for s in (0, 1))
    return p, float(same), float(z.sum())


def fit(x: np.ndarray, text: np.ndarray, boilerplate: np.ndarray, steps: int = 120, rate: float = 0.1, pull: float = 0.5) -> np.ndarray:
    weights = PRIOR.copy()
    if not len(x):
        return weights
    together = text[1:] == text[:-1]
    kept = float((together & (boilerplate[1:] == boilerplate[:-1])).sum())
    m = v = np.zeros_like(weights)
    for t in range(1, steps + 1):
        p, same, _ = marginals(x, text, weights)
        g = np.append(x.T @ (p - boilerplate), same - kept) / len(x) + pull * (weights - PRIOR) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    # lines of one text share a label here, so staying would be learnt without end
    weights[-1] = min(weights[-1], 1.5)
    return weights


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(_sampled(known, 3, sample))  # bounded by the sample
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("quality", "text")
    width = len(LINE_FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column(0).to_numpy()
            for block, at, _ in blocks(batch):
                s = stats(block)
                cuts = np.searchsorted(s.line_text, np.arange(len(block) + 1))
                for i in range(len(block)):
                    own = s.line_features[cuts[i] : cuts[i + 1]]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([int(quality[at + i])], pa.int32()), pa.array([own.astype(np.float64).tobytes()], pa.binary())], ["quality", "x"])

    rows = sorted((r["quality"], bytes(r["x"])) for r in texts.mapInArrow(run, "quality int, x binary").collect())
    if not rows:
        return PRIOR.copy()
    x = [np.frombuffer(r[1]).reshape(-1, width) for r in rows]
    text = np.repeat(np.arange(len(x)), [len(a) for a in x])
    return fit(np.concatenate(x), text, np.repeat([float(r[0] != 1) for r in rows], [len(a) for a in x]))


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``content_share`` and ``kept`` for each row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, to in blocks(batch):
                s = stats(block)
                junk = viterbi(s.line_features, s.line_text, weights.value)
                good = np.bincount(s.line_text, weights=s.line_words * ~junk, minlength=len(block))
                share = good / np.maximum(s.n_words, 1)
                failed = (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *(pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), pa.array(failed), pa.array(share), pa.array(~failed & (share >= SHARE))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
