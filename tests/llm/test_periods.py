import hashlib
import random
import zlib

import numpy as np
import pytest
from docs import SCHEMA, awkward, words
from lodepath.llm import periods as P
from pyspark.sql import functions as F


def slow_runs(w, least=6, times=4):
    """Every period by itself; the smallest of an interval."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e, p) for (s, e), p in found.items())


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 400]), rng.choice([1, 2, 2, 3, 5, 20])
        w = [rng.randrange(k) for _ in range(size)]
        if size > 10 and rng.random() < 0.6:
            a, p = rng.randrange(size), 1 + rng.randrange(max(1, size // 4))
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            if rng.random() < 0.3:
                w[rng.randrange(size)] = 77
        out.append(w)
    return out


@pytest.mark.parametrize("steps", [1, 3, 32])
def test_runs_against_every_period(monkeypatch, steps):
    monkeypatch.setattr(P, "STEPS", steps)
    many = texts(steps, 400)
    at = np.concatenate([[0], np.cumsum([len(w) for w in many])])
    got = P.found_runs(np.array([x for w in many for x in w], np.int64), at)
    for s, e, w in zip(at, at[1:], many):
        mine = got[(got[:, 0] >= s) & (got[:, 0] < e)]
        assert sorted(map(tuple, (mine - [s, s, 0]).tolist())) == slow_runs(w)


def test_z_function():
    for w in texts(9, 100):
        want = [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(len(w))]
        assert not w or P.z_function(w, len(w)) == want


def test_runs_of_one_long_text_are_linear_in_it():
    w = np.concatenate([np.arange(300), np.zeros(60_000, int), np.arange(300)])
    assert P.found_runs(w, np.array([0, len(w)])).tolist() == [[300, 60_301, 1]]


def slow(rows):
    out = []
    for i, text, *_ in rows:
        w = words(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        runs = [(s, e - s, q) for s, e, q in slow_runs(w)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left))))
    return sorted(out, key=str)


def test_query_against_every_period(spark):
    rng = random.Random(4)
    rows = [r for r in awkward() if len(r[1] or "") < 10_000] + [(1000 + i, " ".join(map(str, w)), "en", "s", 1) for i, w in enumerate(texts(8, 150))]
    rows += [(2000 + i, rng.choice(["\t", " \n"]).join(rng.choice("abcdefg") + str(rng.randrange(30)) for _ in range(200)), "en", "s", 1) for i in range(60)]
    rows += [(5000, " ".join(["x y"] * 700 + ["z"] * 40), None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit("clash")).withColumn("start", F.lit("clash"))
    got = P.digest(P.periods(docs, plant=True)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_a_very_long_text_and_its_neighbours(spark):
    made = {r.doc_id: r for r in P.periods(spark.createDataFrame(awkward(), SCHEMA)).where("size(runs) > 0").collect()}
    assert [tuple(x) for x in made[63].runs] == [(0, 30_000, 1)] and made[63].collapsed == "long"


def test_no_rows(spark):
    made = P.digest(P.periods(spark.createDataFrame([], SCHEMA), plant=True))
    assert made.count() == 0
    assert [f.dataType.simpleString() for f in made.schema] == ["bigint"] * 6 + ["string"] * 2
