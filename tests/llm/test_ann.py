import numpy as np
import pytest
from lodepath.llm import ann
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, every, k=10):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            best = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in ok if i != q)[:k]
            out[q] = best
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:300] = v[100]  # a third share a vector
    out = [(i, x.tolist()) for i, x in enumerate(v)]
    return out + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] + [1.0] * 15), (1400, []), (None, [1.0] * 16), (1500, [float("inf")] + [1.0] * 15)]


def test_recall_and_exact_scores(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit("clash")).withColumn("keys", F.lit(1))
    got = {}
    for r in ann.nearest(df, every=20, piece=100, queries=9).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = slow(rows, 20)
    assert set(got) == set(want)
    hits = 0
    vectors = dict(rows)
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r[0] for r in mine] == list(range(1, 11)) and [r[1:] for r in mine] == sorted(r[1:] for r in mine)
        for _, d, i in mine:
            a, b = (np.array(vectors[x], np.float32).astype(np.float64) for x in (q, i))
            assert d == pytest.approx(float(np.sqrt(((a - b) ** 2).sum())), rel=1e-12)
        hits += len({i for _, i in best} & {r[2] for r in mine})
    assert hits / (10 * len(want)) >= 0.95
    assert [r[2] for r in sorted(got[100])] == [i for i in range(101, 111)]


def test_few_candidates_are_all_returned(spark):
    rows = [(0, [1.0, 0.0]), (5, [100.0, 3.0]), (7, [-900.0, 4.0]), (100, [1.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 100), (0, 2, 5), (0, 3, 7), (100, 1, 0), (100, 2, 5), (100, 3, 7)]
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_far_queries_fall_back_to_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)] + [(100, (rng.normal(size=8) + 1e4).tolist())]
    got = [r.vec_id for r in ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [i for _, i in slow([(i, v) for i, v in rows], 100)[100]]


def test_perturbations_come_in_order_and_are_valid():
    rng = np.random.default_rng(2)
    left = rng.uniform(size=4)
    cost = np.concatenate([left, 1 - left]) ** 2
    order = np.argsort(cost)
    got = list(ann.perturbations(cost[order], order % 4))
    sums = [cost[order][list(s)].sum() for s in got]
    assert np.allclose(sums, sorted(sums)) and len(got) == len(set(got)) == 3**4 - 1


def test_clustered_vectors_are_offered_few_rows(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 32))
    rows = [(i, (centre[i % 60] + rng.normal(size=32) * 0.05).tolist()) for i in range(3000)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), piece=500).collect()
    want = slow(rows, 100)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(want)
    hits = sum(len({i for _, i in want[q]} & {r.vec_id for r in mine}) for q, mine in found.items())
    share = np.mean([mine[0].offered / len(rows) for mine in found.values()])
    assert hits / (10 * len(want)) >= 0.9 and share < 0.1, (hits, share)
    # a hot bucket is salted: all rows in one part, dealt to pieces, give the same
    again = ann.nearest(spark.createDataFrame(rows, SCHEMA), piece=10**6, probes=ann.MOST_PROBES).select("query_id", "rank", "vec_id")
    salted = ann.nearest(spark.createDataFrame(rows, SCHEMA), piece=40, probes=ann.MOST_PROBES).select("query_id", "rank", "vec_id")
    assert again.exceptAll(salted).isEmpty() and salted.exceptAll(again).isEmpty()
