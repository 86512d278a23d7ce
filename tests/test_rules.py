"""Rules of runs and models on edge cases, and the recurrent policy against a plain loop."""

import math

import numpy as np
import pytest
from lodepath.functions import runs as U
from lodepath.operators import graph as G
from lodepath.operators import policy as P
from lodepath.operators import search as S
from pyspark.sql import functions as F


def one(spark, column, **values):
    form = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], form).select(column.alias("x")).first().x


def test_unknown_spellings_and_dimensions_are_errors(spark):
    assert one(spark, U.flag(F.col("t")), t=("string", " N ")) is False and one(spark, U.flag(F.col("t")), t=("string", None)) is None
    for bad in (U.flag(F.col("t")), U.algorithm_key(F.col("t")), U.vector_cache("c", F.col("t"), F.lit(9), F.lit(8)), U.vector_cache("c", F.col("t"), F.lit(9), F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
            one(spark, bad, t=("string", "maybe"))
    with pytest.raises(ValueError):
        U.of_family(F.col("t"), "tuned")


def test_settings_labels_and_ids(spark):
    m = ("map<string,string>", {"_a": "1", "bfs_max_visits": "5"})
    assert one(spark, U.public_settings(F.col("m")), m=m) == {"bfs_max_visits": "5"} and one(spark, U.public_settings(F.col("m")), m=("map<string,string>", None)) == {}
    assert one(spark, U.used_cap(F.lit("BFS"), F.col("m")), m=m) == "5" and one(spark, U.used_cap(F.lit("RL"), F.col("m")), m=m) is None
    assert one(spark, U.run_label(F.col("a"), F.lit("m"), F.col("d")), a=("string", None), d=("int", None)) == "None | m | baseline"
    assert one(spark, U.example_id(F.col("a"), F.lit(3)), a=("string", None)) == "3" and one(spark, U.example_id(F.col("a"), F.lit(3)), a=("string", "")) == "3"
    assert one(spark, U.dataset_name(F.col("a")), a=("string", "d\\x.y_filtered.json")) == "x.y"
    faults = [(0, 1, 1, "batch is not positive"), (256, 1, 1, "batch is too large"), (48, 1, 1, "batch does not divide"), (64, 0, 1, "epochs are not positive"), (64, 1, -1, "patience is negative"), (128, 1, 5, None)]
    for b, e, p, fault in faults:
        assert one(spark, U.training_fault(F.col("b"), F.col("e"), F.col("p")), b=("int", b), e=("int", e), p=("int", p)) == fault


def test_first_existing_with_repeats_nulls_and_empty_tables(spark):
    form = "k int, places array<string>"
    wanted = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, None), (5, [])], form)
    got = {r.k: (r.place, r.exists) for r in U.first_existing(wanted, spark.createDataFrame([("b",), ("b",), (None,)], "path string")).collect()}
    assert got == {1: ("b", True), 2: ("b", True), 3: ("c", False), 4: (None, False), 5: (None, False)}
    assert {r.place for r in U.first_existing(wanted, spark.createDataFrame([], "path string")).collect()} == {"a", "c", None}
    assert U.first_existing(spark.createDataFrame([], form), wanted.select(F.lit("a").alias("path"))).count() == 0


def test_a_selected_model_replaces_the_given_ones(spark):
    runs = spark.createDataFrame([("v1", None, 8), ("v1", "own", 8)], "suffix string, model_path string, dimension int")
    names = dict(base="b", normalize="n", layers="l")
    assert {r.model_path for r in U.tested_model(None, runs, "m", **names).collect()} == {"own", "m/b_relu_euclid_n_l_v1_finetuned"}
    best = spark.createDataFrame([(1, "best", 4), (2, "next", 2)], "rank int, model_path string, dimension int")
    assert {(r.model_path, r.dimension) for r in U.tested_model(best, runs, "m", **names).collect()} == {("best", 4)}


def test_study_needs_one_candidate(spark):
    models = spark.createDataFrame([("x/a_b", None), ("x/a", None), ("x/c", "gone"), ("x/d", "s")], "model string, study string")
    studies = spark.createDataFrame([("a_b_1.sqlite3",), ("c_1.sqlite3",), ("c_2.sqlite3",), ("s",), ("plain",)], "name string")
    got = {r.model: r.study for r in U.study_file(models, studies).collect()}
    assert got == {"x/a_b": "a_b_1.sqlite3", "x/a": "a_b_1.sqlite3", "x/c": None, "x/d": "s"}


def plain_scores(policy, question, walked, actions):
    """One LSTM cell, unit by unit, over a path; then the actor's dot products."""
    w = {k: v.tolist() for k, v in policy.weights.items()}
    n = policy.hidden
    h, c = [0.0] * n, [0.0] * n
    line = lambda m, b, x, j: sum(a * y for a, y in zip(m[j], x, strict=True)) + b[j]
    sig = lambda x: 1 / (1 + math.exp(-x))
    for node in walked:
        x = list(question) + list(node)
        g = [line(w["wx"], w["bx"], x, j) + line(w["wh"], w["bh"], h, j) for j in range(4 * n)]
        c = [sig(g[n + j]) * c[j] + sig(g[j]) * math.tanh(g[2 * n + j]) for j in range(n)]
        h = [sig(g[3 * n + j]) * math.tanh(c[j]) for j in range(n)]
    a = [max(0.0, line(w["a1"], w["c1"], h, j)) for j in range(len(w["a1"]))]
    wish = [line(w["a2"], w["c2"], a, j) for j in range(len(w["a2"]))]
    v = [max(0.0, line(w["v1"], w["d1"], h, j)) for j in range(len(w["v1"]))]
    return [sum(p * q for p, q in zip(wish, act, strict=True)) for act in actions], line(w["v2"], w["d2"], v, 0)


def vectors_of(names, dim=3):
    r = np.random.default_rng(7)
    return {n: r.normal(size=dim).tolist() for n in names}


def test_policy_forward_against_a_plain_loop():
    policy = P.seeded(3, 6, 4, 5, 6)
    vec = vectors_of("abcd")
    paths = [["a"], ["a", "b", "c"], ["d", "a"]]
    h = policy.replay(np.array([vec["d"], vec["a"], vec["b"]]), [np.array([vec[n] for n in p]) for p in paths])
    for row, (q, p) in enumerate(zip("dab", paths, strict=True)):
        scores, value = plain_scores(policy, vec[q], [vec[n] for n in p], np.eye(6).tolist())
        assert np.allclose(policy.wish(h)[row], scores) and np.isclose(policy.value(h)[row], value)


def test_policy_scores_in_the_search(spark, tmp_path):
    policy = P.seeded(5, 6, 4, 5, 6)
    np.savez(tmp_path / "p.npz", **{long: policy.weights[n] for n, long in P.NAMES.items()})
    policy = P.loaded(str(tmp_path / "p.npz"))
    ent, rel = vectors_of(["a", "b", "c", P.STOP_ENTITY]), vectors_of(["stop", "a can cause b", "said"])
    table = lambda t: spark.createDataFrame(list(t.items()), "text string, vec array<double>")
    acts = [(1, 0, ["a"], "a", 0, "a", "stop"), (1, 0, ["a"], "a", 1, "b", None), (1, 0, ["a"], "a", 2, "c", "said"), (1, 0, ["a"], "a", 3, "z", "said"), (1, 1, ["a", "b"], "b", 0, "b", "stop"), (1, 2, ["z"], "z", 0, "z", "stop")]
    df = spark.createDataFrame(acts, "query_id long, beam int, path array<string>, node string, action int, next string, sentence string")
    asked = spark.createDataFrame([(1, ent["c"])], "query_id long, vec array<double>")
    got = {(r.beam, r.action): r.score for r in P.scorer(policy, asked, table(ent), table(rel))(df).collect()}
    action = lambda r, e: rel[r] + ent[e]
    first, _ = plain_scores(policy, ent["c"], [ent["a"]], [action("stop", P.STOP_ENTITY), action("a can cause b", "b"), action("said", "c")])
    second, _ = plain_scores(policy, ent["c"], [ent["a"], ent["b"]], [action("stop", P.STOP_ENTITY)])
    assert np.allclose([got[0, i] for i in range(3)], first) and got[0, 3] == 0.0 and np.isclose(got[1, 0], second[0]) and got[2, 0] == 0.0
    edges = spark.createDataFrame([("a", "b", 0, None), ("a", "c", 1, "said")], "cause string, effect string, edge_seq long, sentence string")
    ask = spark.createDataFrame([(1, "a", "c")], "query_id long, source string, target string")
    row = S.beam_search(ask, G.ordered_multigraph(edges), P.scorer(policy, asked, table(ent), table(rel)), rounds=1, width=3).first()
    assert row.found and row.path == ["a", "c"]
