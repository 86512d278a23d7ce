import math

import pytest
from docs import SCHEMA, awkward, words
from lodepath.llm import mixing as M
from pyspark.sql import functions as F


def slow_targets(sizes, most=3.0):
    """sizes by source (None last) -> targets, by pouring what is cut again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
        if not free:
            return out


def slow_seats(votes, seats, most):
    """Highest quotients, one seat at a time."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        free = [k for k in votes if got[k] < most[k] and votes[k] > 0]
        if not free:
            break
        best = min(free, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes,seats", [({"a": 53, "b": 24, "c": 23}, 7), ({"a": 1, "b": 1, "c": 1}, 4), ({"a": 1000, "b": 3, "c": 0.4, "d": 0}, 50), ({"a": 5}, 9), ({"a": 6, "b": 2}, 0)])
def test_apportion_is_sainte_lague(spark, votes, seats):
    df = spark.createDataFrame([("g", k, float(v)) for k, v in votes.items()], "g string, k string, v double")
    got = M.apportion(df, ["g", "k"], F.lit(seats), F.col("v"), ["g"], F.lit(1000)).collect()
    assert {r.k: r.quota for r in got} == slow_seats(votes, seats, dict.fromkeys(votes, 1000))


def test_bounded_apportion_in_many_groups(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for g in range(300):
        votes = {f"k{i:02}": rng.choice([0.0, rng.random(), 10 * rng.random(), float(rng.randrange(50)), 300.0]) for i in range(rng.randrange(1, 12))}
        most = {k: rng.choice([0, 1, 3, int(v) + 1, 3 * int(v), 500]) for k, v in votes.items()}
        seats = rng.choice([0, 1, round(sum(votes.values())), rng.randrange(200)])
        rows += [(g, k, v, most[k], seats) for k, v in votes.items()]
        want |= {(g, k): n for k, n in slow_seats(votes, seats, most).items()}
    df = spark.createDataFrame(rows, "g int, k string, v double, c long, s long")
    got = M.apportion(df, ["g", "k"], F.col("s"), F.col("v"), ["g"], F.col("c")).collect()
    assert {(r.g, r.k): r.quota for r in got} == want


def test_no_document_is_taken_more_than_three_times(spark):
    """Sources of these sizes have a quota above three a block by quotients alone."""
    import random

    rng = random.Random(1)
    many = [[171103, 23, 417, 438124, 276, 97777, 8576, 63599]] + [[int(10 ** rng.uniform(0, 4.6)) for _ in range(rng.randrange(2, 12))] for _ in range(2)]
    for sizes in many:
        rows, i = [], 0
        for s, size in enumerate(sizes):
            for at in range(0, size, 50):
                rows.append((i, "w " * min(50, size - at), "en", f"s{s}", 1))
                i += 1
        got = M.mix(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert got.where("taken > 3 * size").count() == 0
        for r in got.groupBy("source", "target").agg(F.sum("taken").alias("t"), F.first("source_size").alias("n")).collect():
            assert abs(r.t - r.target) <= 2 * max(8, r.n // 100) + 4096 * (r.n > 409600)


def test_mix_matches_brute_force(spark):
    rows = [r for r in awkward(200) if r[1] is None or len(r[1]) < 10000]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("taken", F.lit("clash"))
    got = M.mix(docs, block=2).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    aims = slow_targets(sizes)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, aims[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, len(words(r[1]))) for r in rows)
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= 6
    again = M.mix(docs.repartition(5), block=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_small_shards_still_meet_targets(spark):
    rows = [(i, "w " * (1 + i % 17), "en", "big" if i % 3 else "small", 1) for i in range(300)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA), block=4, shard_tokens=200)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("aim")).collect():
        assert abs(r.t - r.aim) < 0.03 * r.aim


def test_mixed_documents_are_the_words_taken(spark):
    rows = [r for r in awkward(80) if r[1] is None or len(r[1]) < 10000]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("clash"))
    want = {}
    for r in M.mix(docs).collect():
        want[(r.doc_id, r.source)] = want.get((r.doc_id, r.source), 0) + r.taken
    texts = {}
    for r in rows:
        texts.setdefault((r[0], r[3]), []).append(words(r[1]))
    made = M.mixed_documents(docs)
    assert made.columns == docs.columns
    got = {}
    for r in made.collect():
        w = words(r.text)
        assert r.n_chars == len(r.text) and w
        assert any(set(w) <= set(t) for t in texts[(r.doc_id, r.source)])
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + len(w)
    assert got == {k: v for k, v in want.items() if v}


def test_texts_stay_in_long_stretches(spark):
    rows = [(1000 * s + i, " ".join(f"{s}w{i}x{k}" for k in range(400)), "en", f"s{s}", 1) for s in range(3) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    text = {r[0]: r[1] for r in rows}
    made = M.mixed_documents(docs).collect()
    for s, ratio in enumerate((0.5, 1.0, 1.5)):
        mine = [r for r in made if r.source == f"s{s}"]
        assert abs(sum(len(words(r.text)) for r in mine) / (300 * 400) - ratio) < 0.015
        assert sum(r.text.count("\n") + 1 for r in mine) < 1.2 * len(mine)
        assert sum(r.text == text[r.doc_id] for r in mine) > 0.6 * ratio * 300


def test_copies_are_what_taken_before_counts():
    for size, start, n, quota in [(30, 0, 7, 11), (5, 12, 7, 20), (1, 27, 7, 3), (9, 20, 3, 9)]:
        spans = M.copies(start, size, n, quota, 0.37, 4)
        upto = lambda i: math.floor(i * quota / n + 0.37)
        def before(x):
            j = max(min(x // 4, n - 1), 0)
            return upto(j) * 4 + (x - j * 4) * (upto(j + 1) - upto(j))
        assert sum(b - a for c in spans for a, b in c) == before(start + size) - before(start)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 1)], SCHEMA)
    assert [(r.target, r.taken) for r in M.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
