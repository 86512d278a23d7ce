import random
import re

import numpy as np
from docs import SCHEMA, awkward, words
from lodepath.llm import rules as R
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def slow(rows):
    out = []
    for i, text, *_ in rows:
        w = words(text)
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = {x: 0 for x in windows}
        for x in windows:
            times[x] += 1
        again = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), failed))
    return sorted(out, key=str)


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "to", "mi", "ru", "le", "Ü") for b in ("na", "so", "ti", "ve", "lo", "da")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        good = int(rng.random() < 0.7)
        if not good:
            kind = rng.randrange(3)
            w = [x + rng.choice(["%%%", "###"]) if rng.random() < 0.4 else x for x in w] if kind == 0 else [x.upper() for x in w] if kind == 1 else [y for x in w for y in (x, "|")]
        text = "".join(x + rng.choice([" ", " ", "\n", "\n\n"]) for x in w)
        rows.append((i, text + rng.choice(["", text]), rng.choice(["en", "de"]), "s", 1))
        labels.append((i, good, 0))
    return rows, labels


def test_counts_against_plain_python(spark):
    rows = awkward() + corpus(120)[0] + [(900, "a b c " * 40, "en", "s", 1), (901, "a b c\n" * 20 + " \n\n" + "x# y| z<>\r\n", "en", "s", 1), (902, "é " * 49 + "日本", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("kept", F.lit("clash"))
    got = R.judged(docs, None).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == slow(rows)
    assert all(r.kept != r.base_failed for r in got)  # without a model the counts alone decide


def test_learns_marks_capitals_and_tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = R.train(docs, spark.createDataFrame(labels, LABELS))
    got = R.judged(docs, model).collect()
    truth = {i: good for i, good, _ in labels}
    held = [r for r in spark.createDataFrame(got).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).where("h").collect()]
    assert len(held) > 100 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.kept == (not r.base_failed and r.score >= 0.5) for r in got)
    again = R.judged(docs.repartition(3), R.train(docs.repartition(5), spark.createDataFrame(labels, LABELS))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_margins_are_the_weighted_features():
    rows, labels = corpus(60)
    texts = [(r[1] or "").encode() for r in rows + awkward()]
    model = R.fit([r[1].encode() for r in rows], np.array([y for _, y, _ in labels], float), rounds=2)
    w = R.Words(texts)
    want = [model.weight[at] @ share + model.bias for at, share in R.features(w)]
    assert np.allclose(model.margins(w), want, atol=1e-6)
    alone = [model.margins(R.Words([t]))[0] for t in texts]
    assert np.allclose(model.margins(w), alone, atol=1e-9)


def test_held_out_labels_change_nothing(spark):
    import zlib

    rows, labels = corpus(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, t) for i, y, t in labels]
    one, two = (R.train(docs.withColumn("lang", F.lit(x)), spark.createDataFrame(ls, LABELS)) for x, ls in (("a", labels), ("b", turned)))
    assert (one.weight == two.weight).all() and one.scale == two.scale


def test_one_class_no_labels_no_rows(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert R.train(docs, spark.createDataFrame([(i, 1, 0) for i, *_ in labels], LABELS)) is None
    assert R.train(docs, spark.createDataFrame([], LABELS)) is None
    assert R.judged(spark.createDataFrame([], SCHEMA), None).count() == 0
