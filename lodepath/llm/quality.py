"""Quality classifier: naive Bayes support vectors.

Indicators of a text's n-grams (words and pairs of words, runs of marks counted as words, and a mark for a word said twice
in a row) are scaled by the log-count ratio of the classes and brought to unit length; a linear hinge-loss model is fitted
to them by dual coordinate descent, and its margin becomes a score by Platt's method on held-in texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, held_out
from lodepath.llm.toxicity import fitted, training_rows
from lodepath.llm.words import hashed_words, platt

BITS = 22
MASK = np.uint64((1 << BITS) - 1)
PAIR = np.uint64(0x9E3779B97F4A7C15)
SAME = np.uint64(0x5851F42D4C957F2D)


def features(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of every text, repeats included."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(hashes) < 2:
        return text, (hashes & MASK).astype(np.int64)
    a, b = hashes[:-1], hashes[1:]
    inside = text[:-1] == text[1:]
    pair = np.where(a == b, SAME, (a * PAIR) ^ (b + (a >> np.uint64(29))) * SAME)
    pair = (pair ^ (pair >> np.uint64(31))) & MASK
    return np.concatenate([text, text[:-1][inside]]), np.concatenate([hashes & MASK, pair[inside]]).astype(np.int64)


def distinct(text: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket of a text once, by text."""
    key = np.unique((text << BITS) | bucket)
    return key >> BITS, key & int(MASK)


@dataclass
class NbSvm:
    """Per bucket: the ratio (0: not a feature) and the model's weight times the ratio."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def margins(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, bucket = features(hashes, at)
        known = self.ratio[bucket] != 0
        text, bucket = distinct(text[known], bucket[known])
        n = len(at) - 1
        norm = np.sqrt(np.bincount(text, self.ratio[bucket].astype(np.float64) ** 2, n))
        return np.bincount(text, self.weight[bucket], n) / np.maximum(norm, 1e-9) + self.bias

    def scores(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, n_features: int, rounds: int, rng) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss (rows have unit length; a constant 1 is the bias feature): w and the bias."""
    w, bias = np.zeros(n_features), 0.0
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - g / (x @ x + 1), 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit(hashes: list[np.ndarray], labels: np.ndarray, least_texts: int = 3, cost: float = 1.0, rounds: int = 20, seed: int = 5) -> NbSvm | None:
    """Train on texts given as word hashes; None if there is one class only."""
    if len(labels) < 10 or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = len(order) - len(order) // 5
    train, held = order[:cut], order[cut:]
    if labels[train].min() == labels[train].max():
        train = held = order
    sparse = [distinct(*features(hashes[i], np.array([0, len(hashes[i])])))[1] for i in train]
    y = np.where(labels[train] == 1, 1.0, -1.0)
    counts = {s: np.bincount(np.concatenate([x for x, c in zip(sparse, y) if c == s] or [np.empty(0, np.int64)]), minlength=1 << BITS) for s in (1.0, -1.0)}
    keep = counts[1.0] + counts[-1.0] >= least_texts
    p, q = (counts[1.0] + 1.0) * keep, (counts[-1.0] + 1.0) * keep
    ratio = np.zeros(1 << BITS, np.float32)
    ratio[keep] = np.log((p[keep] / p.sum()) / (q[keep] / q.sum()))
    rows = []
    for x in sparse:
        x = x[ratio[x] != 0]
        v = ratio[x].astype(np.float64)
        rows.append((x, v / max(np.sqrt(v @ v), 1e-9)))
    share = {s: len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    w, bias = descend(rows, y, np.array([cost * share[s] for s in y]), 1 << BITS, rounds, rng)
    model = NbSvm(ratio, (w * ratio).astype(np.float32), bias)
    margin = np.concatenate([model.margins(hashes[i], np.array([0, len(hashes[i])])) for i in held])
    model.scale = platt(margin, labels[held])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 5000, **fit_options) -> NbSvm | None:
    """Fit on at most `most` labelled texts outside the held-out fold."""

    def fit_rows(texts: pa.Array, y: np.ndarray, langs: list) -> NbSvm | None:
        h, at = hashed_words(texts, True)
        return fit([h[s:e] for s, e in zip(at, at[1:])], y, **fit_options)

    return fitted(training_rows(docs, labels, "quality", most), fit_rows)


def score(docs: DataFrame, model: NbSvm | None) -> DataFrame:
    """Score whole texts: doc_id, held_out, score (1: of the better class).

    Null and empty texts have no n-grams and get the score of none. Without a model (no labels, or one class) every score
    is 0.5. Repeated rows are scored alike; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.full(b.num_rows, 0.5) if m is None else m.scores(m.margins(*hashed_words(b.column(1), True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score")
