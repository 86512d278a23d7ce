"""Quality rules: counts that any reader can check, and a logistic regression of hashed word and character n-grams.

The model's features are shares: of a text's words that are a given word, of its neighbouring pairs (equal words share a mark of
their own), and of its characters' runs, where a word gives each of its runs of 2 to 4 characters an equal part. So a text's
margin is a mean over its words, and what a word adds is worked out once for each different word of a batch. The
margin is calibrated to a probability on labelled texts kept from the training, and that is held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, trimmed
from lodepath.llm.toxicity import fitted, training_rows
from lodepath.llm.words import AS_IS, coded_words, platt

#: Buckets of features (as bits), and lengths of character runs.
BITS, RUNS = 20, (2, 3, 4)
#: A document fails with fewer words, or with a greater share of its words in repeated windows (per cent); the model keeps it from
#: this probability on.
LEAST_WORDS, MOST_REPEATED, KEEP = 50, 50, 0.5
#: A repeated window has so many words.
WINDOW = 3
#: Most labelled texts that the model learns from.
MOST = 5000

SYMBOLS = b"#*$%&|<>"
_WORD, _PAIR, _SAME = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def down(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(_PAIR) >> np.uint64(64 - BITS)).astype(np.int64)


class Words:
    """The words of a batch of texts, by number, and what their counts need."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        words, self.codes, at, line, self.starts = coded_words(texts, AS_IS)
        self.words, self.at = words.to_pylist(), at[: len(texts) + 1]
        self.n = np.diff(self.at)
        self.line = line
        self.text = np.repeat(np.arange(len(texts)), self.n)

    def over_texts(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        upto = np.concatenate([[0], np.cumsum(marked)])
        ends = np.cumsum([len(t) + 1 for t in self.texts], dtype=np.int64)
        begins = ends - [len(t) + 1 for t in self.texts]
        return upto[ends - 1] - upto[begins]

    def word_chars(self) -> np.ndarray:
        gap = (self.line == 32) | (self.line == 10)
        return self.over_texts(~gap & ((self.line & 0xC0) != 0x80))  # bytes that begin a code point

    def symbols(self) -> np.ndarray:
        return self.over_texts(np.isin(self.line, np.frombuffer(SYMBOLS, np.uint8)))

    def dup_lines(self) -> np.ndarray:
        out = []
        for t in self.texts:
            lines = [x for x in t.split(b"\n") if x.strip()]
            out.append(len(lines) - len(set(lines)))
        return np.array(out, np.int64)

    def repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that their text has twice or more."""
        n = max(len(self.codes) - WINDOW + 1, 0)
        at = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 : WINDOW - 1 + n])
        key = self.text[at]
        for j in range(WINDOW):
            key = np.unique(key * max(len(self.words), 1) + self.codes[at + j], return_inverse=True)[1]
        twice = at[np.bincount(key)[key] > 1] if len(at) else at
        change = np.bincount(twice, minlength=len(self.codes) + 1) - np.bincount(twice + WINDOW, minlength=len(self.codes) + 1)
        return np.bincount(self.text, np.cumsum(change)[:-1] > 0, len(self.texts)).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)

    def char_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of the runs of characters of each different word, its ends marked."""
        line = np.frombuffer("".join(f" {w.decode('utf-8', 'replace')} " for w in self.words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        space = np.flatnonzero(line == 32)
        begin, end = space[::2], space[1::2] + 1
        word, left = np.repeat(np.arange(len(self.words)), end - begin), np.repeat(end, end - begin) - np.arange(len(line))
        whose, what = [], []
        for k in RUNS:
            h = np.full(max(len(line) - k + 1, 0), k, np.uint64)
            for j in range(k):
                h = (h ^ line[j : j + len(h)]) * np.uint64(_WORD)
                h ^= h >> np.uint64(29)
            fits = left[: len(h)] >= k
            whose.append(word[: len(h)][fits])
            what.append(down(h[fits]))
        return np.concatenate(whose), np.concatenate(what)

    def pairs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, bucket) of neighbouring words of a text."""
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        a, b = hashes[self.codes[at]], hashes[self.codes[at + 1]]
        return at, down(np.where(a == b, np.uint64(_SAME), a * np.uint64(_PAIR) + b))


@dataclass
class Logistic:
    weight: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def margins(self, w: Words) -> np.ndarray:
        if not len(w.codes):
            return np.full(len(w.texts), self.bias)
        h = w.hashes()
        whose, what = w.char_runs()
        each = self.weight[down(h)] + np.bincount(whose, self.weight[what], len(h)) / np.maximum(np.bincount(whose, minlength=len(h)), 1)
        total = np.bincount(w.text, each[w.codes], len(w.texts))
        at, bucket = w.pairs(h)
        total += np.bincount(w.text[at], self.weight[bucket], len(w.texts))
        return total / np.maximum(w.n, 1) + self.bias

    def scores(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: the features whose weighted sum is its margin."""
    h = w.hashes()
    word, (whose, what), (at, pair) = down(h), w.char_runs(), w.pairs(h)
    order = np.argsort(whose, kind="stable")
    what, size = what[order], np.bincount(whose, minlength=len(h))
    first, pair_text = np.cumsum(size) - size, np.searchsorted(w.text[at], np.arange(len(w.texts) + 1))
    out = []
    for i, (s, e) in enumerate(zip(w.at, w.at[1:])):
        some, n = np.unique(w.codes[s:e], return_counts=True)
        runs = np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
        mine = pair[pair_text[i] : pair_text[i + 1]]
        bucket = np.concatenate([word[some], what[runs], mine])
        share = np.concatenate([n.astype(float), np.repeat(n / np.maximum(size[some], 1), size[some]), np.ones(len(mine))]) / max(e - s, 1)
        bucket, where = np.unique(bucket, return_inverse=True)
        out.append((bucket, np.bincount(where, share, len(bucket))))
    return out


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 30, batch: int = 64, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> Logistic | None:
    """Adagrad on the log loss, classes weighted alike; a fifth of the texts is kept to calibrate. None if there is one class only."""
    if len(labels) < 10 or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = len(order) - len(order) // 5
    train, held = order[:cut], order[cut:]
    if min(labels[train].min(), labels[held].min()) != 0 or max(labels[train].max(), labels[held].max()) != 1 or labels[held].min() == labels[held].max():
        train = held = order
    rows = [x for i in range(0, len(train), 256) for x in features(Words([texts[j] for j in train[i : i + 256]]))]
    y = labels[train]
    share = np.where(y == 1, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1)) * len(y) / 2
    model = Logistic(np.zeros(1 << BITS), 0.0)
    squares, bias_square = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        mixed = rng.permutation(len(rows))
        for k in range(0, len(mixed), batch):
            some = mixed[k : k + batch]
            at = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, model.weight[at] * x, len(some)) + model.bias, -30, 30)))
            miss = (p - y[some]) * share[some] / len(some)
            here, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, x * miss[row], len(here)) + decay * model.weight[here]
            squares[here] += g * g
            model.weight[here] -= rate * g / np.sqrt(squares[here])
            bias_square += miss.sum() ** 2
            model.bias -= rate * miss.sum() / np.sqrt(bias_square)
    model.weight = model.weight.astype(np.float32)
    margin = np.concatenate([model.margins(Words([texts[j] for j in held[i : i + 256]])) for i in range(0, len(held), 256)])
    model.scale = platt(margin, labels[held])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, **fit_options) -> Logistic | None:
    """Fit on at most `most` rows labelled by quality, outside the held-out fold, in one task of an executor."""
    return fitted(training_rows(docs, labels, "quality", most), lambda texts, y, langs: fit(texts.cast(pa.binary()).to_pylist(), y, **fit_options))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def judged(docs: DataFrame, model: Logistic | None, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """Counts and verdict of every whole text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Nulls: a null text has no words, lines or symbols; a null id is kept. Empty texts have no words, fail and get the score of none.
    Long texts are read whole. Without a model (no labels, or one class) every score is 1, and the counts alone decide. A score equal to the
    threshold keeps. Repeated rows are judged each. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            w = Words(b.column(1).cast(pa.binary()).to_pylist())
            score = np.ones(b.num_rows) if m is None else m.scores(m.margins(w))
            counts = (w.n, w.word_chars(), w.symbols(), w.dup_lines(), w.repeat_words())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(score)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = rows.mapInArrow(trimmed(run), SCHEMA).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
