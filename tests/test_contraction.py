"""Components and forests by contraction, against sets of nodes."""

import random

import pytest

from lodepath.operators import contraction as C
from lodepath.operators import graph as G


def classes(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    out = {}
    for n in up:
        out.setdefault(top(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.root, set()).add(r.node)
    assert all(root in nodes for root, nodes in out.items())
    return sorted(map(sorted, out.values()))


def holds(spark, pairs, small, kind="long"):
    edges = spark.createDataFrame(pairs, f"cause {kind}, effect {kind}")
    want = classes(pairs)
    assert grouped(C.components(edges, small=small).collect()) == want
    tree = [tuple(r) for r in C.forest(edges, small=small).collect()]
    assert set(tree) <= set(pairs) and len(tree) == len(set(tree)) == sum(len(c) - 1 for c in want)
    assert classes(tree) == want


@pytest.mark.parametrize("small", [0, 12, C.SMALL])
def test_random_graphs_with_hubs_loops_repeats_and_nulls(spark, small):
    rng = random.Random(small)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(99, i) for i in range(100, 140)]
    holds(spark, [*pairs, *pairs[:9], *((b, a) for a, b in pairs[:5]), (7, 7), (500, 500), (None, 3), (4, None)], small)


def test_names(spark):
    holds(spark, [("b", "a"), ("b", "c"), ("", "x"), ("z", "z"), ("longer " * 500, "x")], C.SMALL, "string")


def test_no_links(spark):
    for pairs in ([], [(3, 3)], [(None, 1)]):
        edges = spark.createDataFrame(pairs, "cause long, effect long")
        assert C.components(edges).collect() == [] and C.forest(edges).collect() == []


def test_a_path_takes_few_rounds(spark, monkeypatch):
    written = []
    kept = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name="step": written.append(name) or kept(df, name))
    edges = spark.range(400).selectExpr("id AS cause", "id + 1 AS effect")
    assert C.forest(edges, small=0).count() == 400 and written.count("step") <= 30


def test_dense_links_are_read_in_few_rounds(spark, monkeypatch):
    """Nodes of many neighbours nearly all go in one round, so dense links are not carried through a round for each halving."""
    written = []
    kept = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name="step": written.append(name) or kept(df, name))
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(8_000)})
    edges = spark.createDataFrame(pairs, "cause long, effect long")
    tree = [tuple(r) for r in C.forest(edges, small=0).collect()]
    assert set(tree) <= set(pairs) and len(tree) == 399 and classes(tree) == classes(pairs)
    assert written.count("step") <= 4


def test_spanning_forest_of_several_trees(spark):
    """Levels are distances from the greatest root; steps have no gaps."""
    pairs = [("r", "a"), ("r", "b"), ("b", "r"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "y"), ("lone", "out")]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "cause string, effect string, pos long")
    nodes = spark.createDataFrame([(n,) for n in "rabcdxy"] + [("lone",)], "node string")
    rows = sorted((r.step, r.tree, r.level, r.source, r.target) for r in G.spanning_forest(edges, nodes).collect())
    assert [r[0] for r in rows] == list(range(5)) and [r[1:3] for r in rows] == sorted(r[1:3] for r in rows)
    degree = {r.node: (r.degree, r.node) for r in G.degrees(edges).collect()}
    roots = sorted((max(degree[n] for n in c) for c in (set("rabcd"), set("xy"), {"lone"})), reverse=True)
    level = {root: (tree, 0) for tree, (_, root) in enumerate(roots, 1)}
    near = {n: {b for a, b in pairs if a == n and b in "rabcdxy"} | {a for a, b in pairs if b == n and a in "rabcdxy"} for n in "rabcdxy"}
    queue = list(level)
    for n in queue:
        for m in near.get(n, set()) - set(level):
            level[m] = (level[n][0], level[n][1] + 1)
            queue.append(m)
    for _, tree, at, a, b in rows:
        assert (a, b) in pairs and sorted((level[a], level[b])) == [(tree, at - 1), (tree, at)]
