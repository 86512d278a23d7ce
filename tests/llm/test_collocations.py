import random
import re
from collections import Counter

import pytest
from docs import SCHEMA, awkward
from lodepath.llm import collocations as C
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, longest, top):
    f, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: n for x, n in f.items() if n >= least and len(x) > 2}
    inside = {(x[0], *x[i:j]) for x, n in often.items() for i in range(1, len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x) - 1 and n >= f[(x[0], *x[i:j])]}
    out = []
    for x, a in often.items():
        if x in inside:
            continue
        n = totals[x[0]]
        s, _, l, r = min((1000 * a * n // (f[x[:k]] * f[(x[0], *x[k:])]), k, f[x[:k]], f[(x[0], *x[k:])]) for k in range(2, len(x)))
        out.append((x[0], " ".join(x[1:]), a, l, r, n, s))
    out.sort(key=lambda t: (t[0], -t[6], -t[2], t[1].encode()))
    ranked = []
    for t in out:
        rank = ranked[-1][1] + 1 if ranked and ranked[-1][0] == t[0] else 1
        ranked.append((t[0], rank, *t[1:]))
    return [t for t in ranked if t[1] <= top]


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = ["The", "of", "ÉTÉ", "été", "a b", "x", "y", "日本", "New", "york", "CITY"]
    rows = awkward()
    for i in range(150):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice([["New", "York", "City", "hall"], [rng.choice(vocab)], [rng.choice(vocab)], ["of", "of", "of"]])
        rows.append((1000 + i, "".join(x + rng.choice([" ", " ", "\t ", ", ", ".\n"]) for x in w), rng.choice(["en", "en", "en", "de", None, "und"]), "s", 1))
    return rows


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (10, 5, 7), (100, 3, 2000), (300, 5, 2000)])
def test_against_counting_everything(spark, least, longest, top):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = sorted(map(tuple, C.collocations(docs, least, longest, top).collect()), key=lambda t: (t[0], t[1]))
    want = slow(rows, least, longest, top)
    assert got == want
    assert least > 3 or len(want) > 60


def test_filters_that_let_everything_through_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "full_buckets", lambda *_: C.np.full((1 << C.BUCKET_BITS) // 8, 255, C.np.uint8))
    monkeypatch.setattr(C, "frequent_map", lambda *_: C.np.full(1 << C.FREQUENT_BITS - 3, 255, C.np.uint8))
    rows = corpus(5)
    got = sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA), 20).collect()), key=lambda t: (t[0], t[1]))
    assert got == slow(rows, 20, 5, 2000)


def test_filters_keep_what_is_frequent_and_little_else(spark):
    rows = [(i, "a b c. " + f"u{i} v{i} w{i}", "en", "s", 1) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.select("text", "lang")
    partial = C.stored(C.counted(texts, 1, None, 100, 5), "one")
    full = C.full_buckets(partial, 100)
    p = C.Phrases([b"a b c"], ["en"])
    assert C.has(full, C.bucket(p.hashes(2), C.BUCKET_BITS)).all() and C.np.unpackbits(full).sum() == 2


def test_scores_beyond_64_bits(spark):
    big = [(10**12 + 7, 10**13 + 9, 10**12 + 9, 10**12 + 11), (10**15, 9 * 10**17, 10**15, 10**15 + 1), (100, 10**14, 100, 100), (1, 1, 3, 1000)]
    got = spark.createDataFrame(big, "a long, n long, l long, r long").select(C.score("a", "n", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [1000 * a * n // (l * r) for a, n, l, r in big]


def test_no_rows_and_no_words(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, None)], SCHEMA), 1).count() == 0
