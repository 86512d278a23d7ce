"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its runs of 4 and 5 characters (word ends
included), in 2^24 buckets; buckets that enough training texts hold have one, all others the zero vector, so a rare word
is known by its parts and can't be learnt by heart. Filters of several widths run over the whole text, each keeps its
greatest answer, and a logistic layer makes the score. Embeddings and their products with the filters are made once for
each different word of a batch, so a word costs a few look-ups.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, held_out, trimmed
from lodepath.llm.words import platt, split_words

BUCKETS = 1 << 24
RUNS = (4, 5)


def parts(words: list[str], chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, one word after another, and where each word's begin (one more entry than words)."""
    made = [_parts(words[i : i + chunk]) for i in range(0, len(words), chunk)] or [_parts([])]
    return np.concatenate([m[0] for m in made]), np.concatenate([[0], np.cumsum(np.concatenate([m[1] for m in made]))])


def _parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    line = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(line))
    whose, what = [np.arange(len(words))], [own]
    for n in RUNS:
        h = np.full(max(len(line) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ line[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        fits = left[: len(h)] >= n
        whose.append(word[: len(h)][fits])
        what.append(h[fits])
    whose, what = np.concatenate(whose), (np.concatenate(what) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return what[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))


def sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each segment of rows; segments may be empty."""
    out = np.zeros((len(at) - 1, rows.shape[1]), rows.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(rows, at[full], axis=0)
    return out


@dataclass
class Cnn:
    """vocab: sorted buckets that have an embedding, a row of emb each."""

    vocab: np.ndarray
    emb: np.ndarray
    conv: list[np.ndarray]  # (width, dim, filters) for each width
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def known(self, buckets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of emb of the buckets that have one, and where each word's begin."""
        row = np.minimum(np.searchsorted(self.vocab, buckets), max(len(self.vocab) - 1, 0))
        keep = self.vocab[row] == buckets if len(self.vocab) else np.zeros(len(buckets), bool)
        return row[keep], np.concatenate([[0], np.cumsum(keep)])[at]

    def tables(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Products of word vectors with each filter column; row 0 is the padding's."""
        vectors = np.concatenate([np.zeros((1, vectors.shape[1]), np.float32), vectors])
        return [[vectors @ w[o] for o in range(len(w))] for w in self.conv]

    def margins(self, texts: pa.Array, chunk: int = 1 << 18) -> np.ndarray:
        """Of whole texts. Texts are taken some at a time, a very long one by overlapping pieces, so memory is bounded."""
        words, at = split_words(texts)
        coded = words.dictionary_encode()
        rows, starts = self.known(*parts(coded.dictionary.to_pylist()))
        tables = self.tables(sums(self.emb[rows], starts))
        ids = coded.indices.to_numpy().astype(np.int64) + 1
        out = np.empty(len(at) - 1)
        widest, first = max(map(len, self.conv)), 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(at, at[first] + chunk, side="right")) - 1)
            lo, hi = int(at[first]), int(at[last])
            if last == first + 1 and hi - lo > chunk:
                ends = [(c, min(c + chunk + widest - 1, hi)) for c in range(lo, hi, chunk)]
                tops = [self.answers(pooled(tables, ids[s:e], np.array([0, e - s]), chunk)) for s, e in ends]
                h = np.max(np.concatenate(tops), axis=0, keepdims=True)
            else:
                h = self.answers(pooled(tables, ids[lo:hi], at[first : last + 1] - lo))
            out[first:last] = np.maximum(h, 0) @ self.out + self.base
            first = last
        return out

    def answers(self, tops: list[tuple]) -> np.ndarray:
        return np.concatenate([t[0] + b for t, b in zip(tops, self.bias)], axis=1)

    def scores(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def pooled(tables: list[list[np.ndarray]], ids: np.ndarray, at: np.ndarray, most_starts: int | None = None) -> list[tuple]:
    """For each width: greatest answer of each filter over each text (before the bias), all answers, where each text's begin,
    how many they are, and the padded word ids.

    A filter starts at each word (at the first most_starts only, if given) and sees zero ids beyond the text's end, never
    another text; a text without words is a zero id."""
    found = []
    for cols in tables:
        w = len(cols)
        n = np.maximum(np.diff(at), 1)
        start = np.concatenate([[0], np.cumsum(n + w - 1)[:-1]])
        total = int((n + w - 1).sum()) + 1
        line = np.zeros(total + w, np.int64)
        line[np.repeat(start - at[:-1], np.diff(at)) + np.arange(at[-1])] = ids
        z = cols[0][line[:total]]
        for o in range(1, w):
            z += cols[o][line[o : o + total]]
        n = n if most_starts is None else np.minimum(n, most_starts)
        # segments from each start to its text's end; those between are left out
        tops = np.maximum.reduceat(z, np.stack([start, start + n], axis=1).ravel(), axis=0)[::2] if len(n) else z[:0]
        found.append((tops, z, start, n, line))
    return found


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str | None], dim: int = 12, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, epochs: int = 6, steps: int = 900, batch: int = 32, least_texts: int = 4, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Cnn | None:
    """Train with Adagrad, for `epochs` rounds or as many as make `steps` steps if that is more; None if there is one class only.
    A fifth of the texts is kept from the training to fit the score's scale and each language's threshold."""
    if len(labels) < 10 or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = len(order) - len(order) // 5
    train, held = order[:cut], order[cut:]
    words, at = split_words(texts.take(pa.array(train)))
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    ids = [ids[s:e] for s, e in zip(at, at[1:])]
    bucket, first = parts(coded.dictionary.to_pylist())
    n_texts = np.zeros(BUCKETS, np.int32)
    for x in ids:
        some = np.unique(x)
        n = first[some + 1] - first[some]
        n_texts[np.unique(bucket[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
    vocab = np.flatnonzero(n_texts >= least_texts)
    del n_texts
    emb = rng.normal(0, 0.1, (len(vocab), dim)).astype(np.float32)
    conv = [rng.normal(0, 0.5 / np.sqrt(w), (w, dim, filters)).astype(np.float32) for w in widths]
    model = Cnn(vocab, emb, conv, [np.zeros(filters, np.float32) for _ in widths], rng.normal(0, 0.3, filters * len(widths)), float(np.log(labels.mean() / (1 - labels.mean()))))
    rows, first = model.known(bucket, first)
    squares = [np.full_like(x, 1e-6) for x in (*conv, *model.bias, model.out)]
    emb_squares, base_square = np.full_like(emb, 1e-6), 1e-6
    y = labels[train]
    for _ in range(max(epochs, -(-steps * batch // len(train)))):
        mixed = rng.permutation(len(train))
        for start_at in range(0, len(mixed), batch):
            some = mixed[start_at : start_at + batch]
            at = np.concatenate([[0], np.cumsum([len(ids[i]) for i in some])])
            here, local = np.unique(np.concatenate([ids[i] for i in some]), return_inverse=True)
            n = first[here + 1] - first[here]
            mine = rows[np.repeat(first[here] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            vectors = sums(model.emb[mine], np.concatenate([[0], np.cumsum(n)]))
            tops = pooled(model.tables(vectors), local + 1, at)
            h = model.answers(tops)
            a = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ model.out + model.base, -30, 30)))
            miss = (p - y[some]) / len(some)
            back = (miss[:, None] * model.out) * (h > 0)
            padded = np.concatenate([np.zeros((1, dim), np.float32), vectors])
            word_grad = np.zeros_like(padded)
            grads = []
            for k, (_, z, start, size, line) in enumerate(tops):
                dz = back[:, k * filters : (k + 1) * filters].astype(np.float32)
                won = np.stack([z[s : s + m].argmax(axis=0) + s for s, m in zip(start, size)])
                g = np.zeros_like(model.conv[k])
                for o in range(len(g)):
                    word = line[won + o]  # texts x filters
                    g[o] = np.einsum("nfd,nf->df", padded[word], dz)
                    np.add.at(word_grad, word.ravel(), (dz[..., None] * model.conv[k][o].T[None]).reshape(-1, dim))
                grads.append((g + decay * model.conv[k], dz.sum(axis=0)))
            touched = np.flatnonzero(np.abs(word_grad[1:]).sum(axis=1))
            n_touched = n[touched]
            where = np.repeat((np.cumsum(n) - n)[touched] - np.cumsum(n_touched) + n_touched, n_touched) + np.arange(n_touched.sum())
            at_row, local_row = np.unique(mine[where], return_inverse=True)
            emb_grad = np.zeros((len(at_row), dim), np.float32)
            np.add.at(emb_grad, local_row, np.repeat(word_grad[1:][touched], n_touched, axis=0))
            emb_grad += decay * model.emb[at_row]
            weights = [*model.conv, *model.bias, model.out]
            for x, sq, g in zip(weights, squares, [*(g for g, _ in grads), *(b for _, b in grads), a.T @ miss + decay * model.out]):
                sq += g * g
                x -= rate * g / np.sqrt(sq)
            emb_squares[at_row] += emb_grad**2
            model.emb[at_row] -= rate * emb_grad / np.sqrt(emb_squares[at_row])
            base_square += float(miss.sum()) ** 2
            model.base -= rate * float(miss.sum()) / np.sqrt(base_square)
    margin = np.concatenate([model.margins(texts.take(pa.array(held[i : i + 512]))) for i in range(0, len(held), 512)])
    model.scale = platt(margin, labels[held])
    model.thresholds = thresholds(model.scores(margin), labels[held], [langs[i] for i in held])
    return model


def thresholds(score: np.ndarray, label: np.ndarray, langs: list[str | None], default: float = 0.7, least: int = 10, bounds: tuple[float, float] = (0.4, 0.9)) -> dict[str, float]:
    """By language: the middle of the gap that gives the best F1 on the held texts, within bounds; the default where a
    language has fewer than `least` texts of either class."""
    found = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        s, y = score[mine], label[mine]
        if min(y.sum(), (1 - y).sum()) < least:
            continue
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        best = int(f1.argmax())
        below = s[order][best + 1] if best + 1 < len(s) else 0.0
        found[lang] = float(np.clip((s[order][best] + below) / 2, *bounds))
    return {x: t for x, t in found.items()} | {"": default}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(id, y, text, lang) of at most `most` labelled texts outside the held-out fold, chosen by a hash of their id.

    Contradicting labels of an id: the mean, 1 from a half on. Null labels don't count. Of rows of one id, one is taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")).where(~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    picked = chosen.join(texts, "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("t"))
    return picked.select("id", "y", "t.text", "t.lang")


def fitted(rows: DataFrame, fit_rows: Callable[[pa.Array, np.ndarray, list], object | None]):
    """Fit a model to a bounded sample in one task of an executor, in the order of ids: fit_rows(texts, labels, languages). Only the
    model comes to the driver; the task can be run again if its executor is lost."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            model = fit_rows(t["text"].combine_chunks(), t["y"].to_numpy().astype(np.float64), t["lang"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.repartition(1).sortWithinPartitions("id").mapInArrow(trimmed(run), "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, **fit_options) -> Cnn | None:
    """Fit on at most `most` labelled texts outside the held-out fold."""
    return fitted(training_rows(docs, labels, "toxic", most), lambda texts, y, langs: fit(texts, y, langs, **fit_options))


def score(docs: DataFrame, model: Cnn | None, keep: bool = False) -> DataFrame:
    """Score whole texts: doc_id, held_out, score, threshold (of the row's language), rejected (score not below it);
    with keep, all columns of docs as the struct row_ in place of doc_id and held_out.

    Null and empty texts have no words and get the score of none, as any text; a null language has the default
    threshold. Without a model (no labels, or one class of them) every score is 0. Repeated rows are scored alike. Other
    columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    first = F.struct("*").alias("row_") if keep else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(first, F.col("text").cast("string").alias("t_"), F.col("lang").cast("string").alias("l_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                s = np.zeros(b.num_rows)
            else:
                s = m.scores(m.margins(b.column("t_")))
            limit = m.thresholds if m else {}
            t = [limit.get(x, limit.get("", 0.7)) if x is not None else limit.get("", 0.7) for x in b.column("l_").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(t, pa.float64())], names=[b.schema.names[0], "score", "threshold"])

    schema = rows.select(rows.columns[0], F.lit(0.0).alias("score"), F.lit(0.0).alias("threshold")).schema
    for f in schema:
        f.nullable = True
    out = rows.mapInArrow(trimmed(run), schema).withColumn("rejected", F.col("score") >= F.col("threshold"))
    return out if keep else out.select("doc_id", held_out().alias("held_out"), "score", "threshold", "rejected")
