"""Searches against independent implementations on small random graphs."""

import heapq
import math
import random
from collections import deque

import pytest
from lodepath.functions import vectors as V
from lodepath.operators import graph as G
from lodepath.operators import search as S
from pyspark.sql import functions as F


def random_graph(seed, nodes=14, edges=34):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    pairs = []
    while len(pairs) < edges:
        e = (rng.choice(names), rng.choice(names))
        if e[0] != e[1] and e not in pairs:
            pairs.append(e)
    vec = {n: [rng.uniform(-1, 1) for _ in range(3)] for n in names}
    return names, pairs, vec


def queue_bfs(adj, s, t, cap):
    if s not in adj or t not in adj:
        return [], 0
    line, parent, visits = deque([s]), {s: None}, 0
    while line:
        node = line.popleft()
        if node == t:
            path = [node]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            return path[::-1], visits
        visits += 1
        if cap != -1 and visits > cap:
            return [], visits
        for n in adj[node]:
            if n not in parent:
                parent[n] = node
                line.append(n)
    return [], visits


def heap_reference(adj, cost, ahead, s, t, cap):
    if s not in adj or t not in adj:
        return [], 0
    best, closed, visits, parent = {s: 0.0}, set(), 0, {}
    heap = [(ahead(s), 0.0, s)]
    while heap:
        _, g, node = heapq.heappop(heap)
        if node in closed or g > best[node]:
            continue
        if node == t:
            path = [node]
            while path[-1] in parent:
                path.append(parent[path[-1]])
            return path[::-1], visits
        closed.add(node)
        visits += 1
        if cap != -1 and visits > cap:
            return [], visits
        for n in adj[node]:
            c = g + cost(node, n)
            if n not in closed and c < best.get(n, math.inf):
                best[n], parent[n] = c, node
                heapq.heappush(heap, (c + ahead(n), c, n))
    return [], visits


def tables(spark, names, pairs, vec):
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, pos long")
    vectors = spark.createDataFrame(list(vec.items()), "node string, vec array<double>")
    ask = [(i * 100 + j, a, b) for i, a in enumerate(names[:5]) for j, b in enumerate([*names, "absent"])]
    return edges, vectors, ask, spark.createDataFrame(ask, "query_id long, source string, target string")


def successors(pairs):
    adj = {n: [] for p in pairs for n in p}
    for a, b in pairs:
        adj[a].append(b)
    return adj


@pytest.mark.parametrize("seed,cap", [(1, -1), (2, 4)])
def test_bfs_matches_a_queue(spark, seed, cap):
    names, pairs, vec = random_graph(seed)
    edges, _, ask, queries = tables(spark, names, pairs, vec)
    adj = successors(pairs)
    got = {r.query_id: (r.path, r.visited) for r in S.bfs(queries, edges, cap).collect()}
    assert got == {q: queue_bfs(adj, s, t, cap) for q, s, t in ask}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_heap_astar_matches_reference_and_edge_order_does_not_matter(spark, metric):
    names, pairs, vec = random_graph(3)
    edges, vectors, ask, queries = tables(spark, names, pairs, vec)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    def d(a, b):
        if metric == "euclidean":
            return math.dist(vec[a], vec[b])
        return 1 - sum(x * y for x, y in zip(vec[a], vec[b])) / norm(vec[a]) / norm(vec[b])
    adj = successors(pairs)
    for cap in (-1, 3):
        got = {r.query_id: (r.path, r.visited) for r in S.astar(queries, edges, vectors, metric, cap).collect()}
        want = {q: heap_reference(adj, d, lambda n, t=t: d(n, t), s, t, cap) if s in adj and t in adj else ([], 0) for q, s, t in ask}
        assert got == want
    mixed = edges.withColumn("pos", -F.col("pos"))
    assert sorted(map(str, S.astar(queries, mixed, vectors, metric).collect())) == sorted(map(str, S.astar(queries, edges, vectors, metric).collect()))


def test_relational_searches_agree_with_heaps(spark):
    names, pairs, vec = random_graph(4)
    edges, vectors, ask, queries = tables(spark, names, pairs, vec)
    costed = V.edge_costs(edges, vectors).cache()
    key = lambda df: {r.query_id: (r.path, r.visited, None if r.path_cost is None else round(r.path_cost, 9)) for r in df.collect()}
    for cap in (-1, 5):
        assert key(S.dijkstra(queries, costed, cap)) == key(S.dijkstra_heap(queries, costed, cap))
    assert key(S.astar_euclidean(queries, costed, vectors)) == key(S.astar(queries, edges, vectors))


def test_zero_costs_go_by_the_heap(spark):
    edges = spark.createDataFrame([("a", "b", 0, 0.0), ("b", "c", 1, 0.0), ("a", "c", 2, 1.0)], "src string, dst string, pos long, cost double")
    q = spark.createDataFrame([(1, "a", "c")], "query_id long, source string, target string")
    assert S.dijkstra_heap(q, edges).first().path == ["a", "b", "c"]
    assert S.dijkstra_best_first(q, edges).first().path == ["a", "b", "c"]


def test_budget_sweep_is_the_capped_search(spark):
    names, pairs, vec = random_graph(5)
    edges, vectors, _, queries = tables(spark, names, pairs, vec)
    swept = S.budget_sweep(S.astar(queries, edges, vectors), [2, 6])
    for cap in (2, 6):
        a = sorted((r.query_id, r.path, r.visited) for r in swept.where(F.col("cap") == cap).collect())
        assert a == sorted((r.query_id, r.path, r.visited) for r in S.astar(queries, edges, vectors, cap=cap).collect())


def test_beam_search_matches_reference(spark):
    names, pairs, vec = random_graph(6)
    adj = successors(pairs)
    edges = spark.createDataFrame([(a, b, i, None) for i, (a, b) in enumerate(pairs)], "cause string, effect string, edge_seq long, sentence string")
    ask = [(i, names[i], names[-1 - i]) for i in range(6)]
    queries = spark.createDataFrame(ask, "query_id long, source string, target string")
    num = lambda c: F.substring(c, F.lit(2), F.lit(9)).cast("int")
    score = lambda df: df.withColumn("score", ((num(F.col("node")) * 5 + num(F.col("next")) * 3) % 7).cast("double"))
    raw = lambda a, b: float((int(a[1:]) * 5 + int(b[1:]) * 3) % 7)
    got = {r.query_id: (r.path, r.visited) for r in S.beam_search(queries, G.ordered_multigraph(edges), score, rounds=2, width=3, max_actions=4).collect()}
    eps = 2.0**-23
    for q, s, t in ask:
        beams, nodes, found = [([s], 0.0)], [s], s == t
        for _ in range(2):
            nxt = []
            for path, prob in beams:
                acts = [path[-1], *adj.get(path[-1], [])[:3]]
                sc = [raw(path[-1], a) for a in acts]
                live = [x for x in sc if x != 0]
                e = [math.exp(x - max(live)) if x != 0 else 0.0 for x in sc] if live else [0.0] * len(sc)
                nxt += [(path + [a], prob + math.log(max(v / sum(e) if sum(e) else eps, eps))) for a, v in zip(acts, e)]
            nxt.sort(key=lambda x: -round(x[1], 12))
            beams = nxt[:3]
            for path, _ in beams:
                if not found:
                    nodes += [n for n in path if n not in nodes]
                found = found or t in nodes
        hit = next((p for p, _ in beams if t in p), [])
        assert got[q] == (hit, len(nodes)), (q, s, t)


def test_diamond_star_and_single_edge(spark):
    edges = spark.createDataFrame([("start", "left", 0), ("start", "right", 1), ("left", "goal", 2), ("right", "goal", 3)], "src string, dst string, pos long")
    vectors = spark.createDataFrame([("start", [0.0]), ("left", [1.0]), ("right", [2.0]), ("goal", [3.0])], "node string, vec array<double>")
    q = spark.createDataFrame([(1, "start", "goal"), (2, "goal", "goal"), (3, "goal", "start"), (4, "start", "x")], "query_id long, source string, target string")
    got = {r.query_id: (r.path, r.visited) for r in S.astar(q, edges, vectors).collect()}
    assert got[1][0] in (["start", "left", "goal"], ["start", "right", "goal"]) and got[2] == (["goal"], 0) and got[3] == ([], 1) and got[4] == ([], 0)
    assert {r.query_id: (r.path, r.visited) for r in S.bfs(q, edges).collect()}[1] == (["start", "left", "goal"], 3)


def test_searches_have_no_limit_of_levels_by_default(spark):
    import inspect

    for f, limit in ((S.bfs_ranks, "max_levels"), (S.bfs, "max_levels"), (S.distances, "max_rounds")):
        assert inspect.signature(f).parameters[limit].default is None
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i, 1.0) for i in range(5)], "src string, dst string, pos long, cost double")
    query = spark.createDataFrame([(1, "n0", "n5")], "query_id long, source string, target string")
    assert S.bfs(query, edges).first().path == [f"n{i}" for i in range(6)]
    assert S.distances(query, edges).where("node = target").first().dist == 5.0


def test_graphs_over_a_bound_are_not_gathered(spark, monkeypatch):
    names, pairs, vec = random_graph(7)
    edges, vectors, _, queries = tables(spark, names, pairs, vec)
    for bound, value in (("BROADCAST_BYTES", 14 * 3 * 8 - 1), ("BROADCAST_NODES", 13), ("BROADCAST_EDGES", 33)):
        with monkeypatch.context() as m:
            m.setattr(S, bound, value)
            with pytest.raises(ValueError, match="relational search"):
                S.astar_heap(queries, edges, vectors)
    # a prefix of the vectors is what is gathered, so it is what counts
    monkeypatch.setattr(S, "BROADCAST_BYTES", 14 * 2 * 8)
    assert S.astar_heap(queries, edges, vectors, dim=2).count() == queries.count()


def test_registered_searches_have_sql():
    from lodepath.plans import catalog

    searches = {"hub_spanning_forest", "bfs_hops", "bfs_visited_capped", "dijkstra_paths", "dijkstra_heap_paths", "astar_l2_paths", "astar_prefix32_budget27", "astar_relational"}
    assert searches <= set(catalog.QUERIES) and searches <= set(catalog.ORACLE_SQL)


def same(one, two):
    key = lambda df: {r.query_id: (r.path, r.visited, None if r.path_cost is None else round(r.path_cost, 9)) for r in df.collect()}
    return key(one) == key(two)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_best_first_rounds_are_the_heap(spark, metric):
    """Paths, visits and costs, with budgets, a prefix of the vectors, and questions that come twice or have no answer."""
    names, pairs, vec = random_graph(8)
    edges, vectors, ask, _ = tables(spark, names, pairs, vec)
    queries = spark.createDataFrame([*ask, *((q + 10_000, s, t) for q, s, t in ask[:7])], "query_id long, source string, target string")
    for cap, dim in ((-1, None), (3, None), (0, None), (-1, 2)):
        assert same(S.astar(queries, edges, vectors, metric, cap, dim), S.astar_heap(queries, edges, vectors, metric, cap, dim))


def test_best_first_in_many_rounds_with_zero_costs_and_hubs(spark, monkeypatch):
    """One node a round, hubs over several blocks, ties of cost and of name."""
    import random

    from lodepath.operators import blocks as B

    rng = random.Random(2)
    rows = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}"): float(rng.choice([0, 0, 1, 1, 2])) for _ in range(90)}
    rows |= {("hub", f"n{i}"): float(i % 2) for i in range(25)} | {("n3", "hub"): 0.0}
    edges = spark.createDataFrame([(a, b, i, c) for i, ((a, b), c) in enumerate(rows.items()) if a != b], "src string, dst string, pos long, cost double")
    queries = spark.createDataFrame([(i * 25 + j, f"n{i}", f"n{j}") for i in range(4) for j in range(25)], "query_id long, source string, target string")
    parts = B.blocks(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "cost"), ["next", "cost"], "node", 4)
    assert parts.where("node = 'hub'").count() > 3 and parts.select(F.explode("edges")).count() == edges.count()
    monkeypatch.setattr(B, "BLOCK", 4)
    want = S.dijkstra_heap(queries, edges)
    assert same(S.dijkstra_best_first(queries, edges), want)
    one = B.BestFirst.wanted
    monkeypatch.setattr(B.BestFirst, "wanted", lambda self: one(self)[:1])
    assert same(S.dijkstra_best_first(queries.where("query_id < 12"), edges, 4), S.dijkstra_heap(queries.where("query_id < 12"), edges, 4))


def test_packed_hops_of_many_sources(spark):
    """More sources than two words hold, on a graph with a hub, parts that don't meet, and ends that aren't nodes."""
    import random

    from lodepath.operators.blocks import numbered, packed_hops

    rng = random.Random(6)
    names = [f"n{i}" for i in range(170)]
    pairs = {(rng.choice(names[:150]), rng.choice(names[:150])) for _ in range(260)} | {(names[i], names[i + 1]) for i in range(150, 169)} | {("n0", n) for n in names[:90:2]}
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(sorted(pairs))], "src string, dst string, pos long")
    ask = [(i, rng.choice(names), rng.choice([*names, "absent"])) for i in range(900)]
    adj = successors(sorted(pairs))
    got = {r.query_id: r.hops for r in packed_hops(spark.createDataFrame(ask, "query_id long, source string, target string"), edges).collect()}
    want = {}
    for q, s, t in ask:
        level, seen, hops = [s], {s}, 0
        while level and t not in level:
            level = list({n for x in level for n in adj.get(x, ())} - seen)
            seen.update(level)
            hops += 1
        want[q] = hops if level and s in adj and t in adj else -1
    assert got == want and {-1, 0, 19} <= {*want.values(), 19}
    assert [r.node for r in numbered(edges).orderBy("id").collect()] == sorted(adj)
    path = spark.createDataFrame([(f"m{i:02}", f"m{i + 1:02}", i) for i in range(12)], "src string, dst string, pos long")
    query = spark.createDataFrame([(1, "m00", "m12"), (2, "m05", "m05")], "query_id long, source string, target string")
    assert {r.query_id: r.hops for r in packed_hops(query, path).collect()} == {1: 12, 2: 0}
    with pytest.raises(ValueError, match="beyond 3 levels"):
        packed_hops(query, path, max_levels=3)
    none = spark.createDataFrame([], "src string, dst string, pos long")
    assert [r.hops for r in packed_hops(query, none).collect()] == [-1, -1]


@pytest.mark.parametrize("held", [1, 1 << 28])
def test_searches_of_a_batch_share_what_they_fetch(spark, held):
    """A node is asked for once for all searches of a batch; a batch that holds too much is split, down to single searches."""
    from lodepath.operators import blocks as B

    b = B.Batch("euclidean", -1)
    b.searches = [(1, "a", "d", None), (2, "a", "e", None), (3, "b", "e", None)]
    assert b.go(held)[0] == [] and [b.names[n] for n in b.asked] == ["a", "b"]
    for src, dst, cost in (("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 1.0)):
        b.near.setdefault(b.place(src), []).append((b.place(dst), cost))
    ended, going = b.go(held)
    assert ended == [] and len(going) == (2 if held == 1 else 1)
    assert all([x.names[n] for n in x.asked] == ["c"] for x in going) and sorted(s[0] for x in going for s in x.searches) == [1, 2, 3]
    names, pairs, vec = random_graph(8)
    edges, vectors, ask, _ = tables(spark, names, pairs, vec)
    queries = spark.createDataFrame(ask[:60], "query_id long, source string, target string")
    assert same(B.best_first(queries, edges, vectors, held=held), S.astar_heap(queries, edges, vectors))
