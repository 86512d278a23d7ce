import random

import numpy as np
import pyarrow as pa
from docs import SCHEMA, awkward
from lodepath.llm import quality, toxicity
from lodepath.llm.words import hashed_words, split_words
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "to", "mi", "ru", "le") for b in ("na", "so", "ti", "ve", "lo", "da")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Grotz", "grotzig", "grotzen"])
        if not good:
            w = [x + rng.choice(["%%%", "###"]) if rng.random() < 0.4 else x for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), "s", 1))
        labels.append((i, good, toxic))
    return rows, labels


def accuracy(got, labels, column):
    truth = {r[0]: r[column] for r in labels}
    mine = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(mine) > 50
    return np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in mine])


def test_toxicity_learns_words_and_their_parts(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("row_", F.lit(1))
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    got = toxicity.score(docs, model).collect()
    assert accuracy(got, labels, 2) > 0.95 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.score(docs, model, keep=True)
    assert kept.select("row_.*").columns == docs.columns and kept.count() == len(rows)
    again = toxicity.train(docs.repartition(3), spark.createDataFrame(labels, LABELS))
    assert sorted(map(str, toxicity.score(docs, again).collect())) == sorted(map(str, got))


def test_quality_learns_marks(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    model = quality.train(docs, spark.createDataFrame(labels, LABELS))
    got = quality.score(docs, model).collect()
    assert accuracy(got, labels, 1) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    import zlib

    rows, labels = corpus(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    other = [(i, *((1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (q, t))) for i, q, t in labels]
    moved = spark.createDataFrame([(i, t, "xx", "yy", 0) for i, t, *_ in rows], SCHEMA)
    for m in (toxicity, quality):
        a = m.train(docs, spark.createDataFrame(labels, LABELS))
        b = m.train(moved, spark.createDataFrame(other, LABELS))
        one = {r.doc_id: r.score for r in m.score(docs, a).collect()}
        assert one == {r.doc_id: r.score for r in m.score(moved, b).collect()}


def test_awkward_texts_and_missing_labels(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    rows, labels = corpus(150)
    none = spark.createDataFrame([], LABELS)
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 0)], LABELS)
    for m, default in ((toxicity, 0.0), (quality, 0.5)):
        for empty in (none, nulls):
            assert m.train(docs, empty) is None
            assert {r.score for r in m.score(docs, None).collect()} == {default}
        model = m.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
        got = m.score(docs, model).collect()
        assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
        assert m.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_a_long_text_in_pieces_has_the_score_of_the_whole():
    rows, labels = corpus(120)
    model = toxicity.fit(pa.array([r[1] for r in rows]), np.array([x[2] for x in labels], float), [r[2] for r in rows], steps=60)
    texts = pa.array([" ".join(r[1] for r in rows[:40]), "", None, rows[50][1]])
    assert np.allclose(model.margins(texts), model.margins(texts, chunk=7))


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, b = quality.descend([(np.arange(5), r) for r in x], y, np.ones(60), 5, 500, rng)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(loss(w + d[:5], b + d[5]) >= best - 1e-3 for d in rng.normal(scale=0.05, size=(300, 6)))


def test_word_splitting():
    words, at = split_words(pa.array(["  Don't STOP  ", None, "", "ÄB--c"]))
    assert words.to_pylist() == ["don", "t", "stop", "äb", "c"] and at.tolist() == [0, 3, 3, 3, 5]
    words, at = split_words(pa.array(["in%%% the!", " "]), marks=True)
    assert words.to_pylist() == ["in", "%%%", "the", "!"] and at.tolist() == [0, 4, 4]
    h, at = hashed_words(pa.array(["a a", "a"]))
    assert h[0] == h[1] == h[2]


def naive_margin(model, words):
    """The convolutional classifier by its definition, one word, start and filter width at a time."""
    import xxhash

    row = {b: i for i, b in enumerate(model.vocab.tolist())}
    vectors = []
    for word in words:
        marked, buckets = f"<{word}>", [xxhash.xxh64_intdigest(word)]
        for n in toxicity.RUNS:
            for s in range(len(marked) - n + 1):
                h = n
                for c in marked[s : s + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                buckets.append(h)
        known = [model.emb[row[b % toxicity.BUCKETS]] for b in buckets if b % toxicity.BUCKETS in row]
        vectors.append(np.sum(known, axis=0) if known else np.zeros(model.emb.shape[1]))
    tops = []
    for conv, bias in zip(model.conv, model.bias):
        line = (vectors or [np.zeros(model.emb.shape[1])]) + [np.zeros(model.emb.shape[1])] * (len(conv) - 1)
        answers = [sum(line[s + o] @ conv[o] for o in range(len(conv))) for s in range(max(len(words), 1))]
        tops.append(np.max(answers, axis=0) + bias)
    return np.maximum(np.concatenate(tops), 0) @ model.out + model.base


def test_toxicity_margins_are_those_of_a_naive_convolution():
    rows, labels = corpus(160)
    model = toxicity.fit(pa.array([r[1] for r in rows]), np.array([x[2] for x in labels], float), [r[2] for r in rows], steps=80)
    texts = [rows[0][1], "", None, "unseen", "grotzel " + rows[1][1], *(r[1] for r in rows[2:30])]
    want = [naive_margin(model, split_words(pa.array([t], pa.string()))[0].to_pylist()) for t in texts]
    assert np.allclose(model.margins(pa.array(texts)), want, atol=1e-4) and np.ptp(want) > 0.5


def test_quality_ratios_and_margins_are_those_of_naive_counts():
    rng = random.Random(3)
    vocab = ["ka", "to", "mi", "ru", "le", "na", "so"]
    labels = np.array([float(rng.random() < 0.6) for _ in range(120)])
    texts = [" ".join(rng.choice(vocab if y else [*vocab, "zu", "zu"]) for _ in range(rng.randint(1, 20))) for y in labels]
    h, at = hashed_words(pa.array(texts), True)
    hashes = [h[s:e] for s, e in zip(at, at[1:])]
    model = quality.fit(hashes, labels)

    def grams(text):
        w = text.split()
        return {(x,) for x in w} | {("twice", "twice") if a == b else (a, b) for a, b in zip(w, w[1:])}

    def bucket(gram):
        return quality.features(*hashed_words(pa.array([" ".join(gram)]), True))[1][-1]

    train = np.random.default_rng(5).permutation(len(texts))[: len(texts) - len(texts) // 5]
    counts = {}
    for i in train:
        for g in grams(texts[i]):
            counts.setdefault(g, [0, 0])[int(labels[i])] += 1
    counts = {g: (bad + 1, good + 1) for g, (bad, good) in counts.items() if bad + good >= 3}
    bad, good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    ratio = {g: np.log(c[1] / good / (c[0] / bad)) for g, c in counts.items()}
    assert len(ratio) > 20 and np.count_nonzero(model.ratio) <= len(ratio)
    assert all(abs(model.ratio[bucket(g)] - r) < 1e-5 for g, r in ratio.items())
    for text, found in zip(texts, model.margins(h, at)):
        mine = [g for g in grams(text) if g in ratio]
        norm = np.sqrt(sum(ratio[g] ** 2 for g in mine))
        assert abs(sum(model.weight[bucket(g)] for g in mine) / max(norm, 1e-9) + model.bias - found) < 1e-4
