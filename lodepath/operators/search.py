"""Path searches for batches of queries (query_id, source, target) over edges (src, dst, pos[, cost]).

All queries of a batch advance together. A search gives (query_id, path, visited): visited counts the nodes taken up
before the target, and a search that passes its budget ends with no path and budget + 1 visits. A query whose source is
its target has the path of that node and no visits; one with an endpoint that isn't a node has neither.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import vectors as V
from lodepath.operators.blocks import best_first
from lodepath.plans.session import checkpointed as _cut
from lodepath.plans.session import discard, stored

RESULT = "query_id long, path array<string>, visited long"


def covered(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Queries whose two ends are nodes of the graph."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("n_")).distinct()
    return queries.join(n, queries.source == F.col("n_"), "left_semi").join(n, queries.target == F.col("n_"), "left_semi")


def capped(path: Column, visited: Column, cap: Column) -> tuple[Column, Column]:
    """What a search under a budget gives, from what it gives without one: the same within it, else no path and cap + 1."""
    within = (cap == -1) | (visited <= cap)
    return F.when(within, path).otherwise(F.array().cast("array<string>")), F.when(within, visited).otherwise(cap + 1)


def bfs_ranks(queries: DataFrame, edges: DataFrame, cap: int = -1, max_levels: int | None = None) -> DataFrame:
    """(query_id, target, node, level, rank, path): nodes in the order in which a queue would find them, the source first (rank 0),
    each with the path of first finders that leads to it.

    A level is one join with the edges and one anti-join with what has been found. Nodes of a level rank by their first finder
    and that finder's edge order, as in a queue. Finished queries (target found, or more nodes found than the budget) leave
    the frontier. Only a level's own rows are written at its checkpoint, and they carry the query's count and the path, so
    nothing is counted or rebuilt later. All levels are searched; with max_levels, a search that would go deeper raises.
    """
    start = covered(queries, edges).select("query_id", "target", F.col("source").alias("node"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("rank"), F.array("source").alias("path"))
    levels = [_cut(start)]
    # n: how many nodes a query has found
    frontier = levels[0].where("node <> target").withColumn("n", F.lit(1).cast("long"))
    adj = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "pos")
    for level in count(1):
        by = F.struct("rank", "pos")
        found = frontier.join(adj, "node").groupBy("query_id", F.col("next").alias("node")).agg(F.min(by).alias("by"), F.min_by("path", by).alias("path"), F.first("target").alias("target"), F.first("n").alias("n"))
        seen = reduce(DataFrame.unionByName, [x.select("query_id", "node") for x in levels])
        mine = Window.partitionBy("query_id")
        fresh = found.join(seen, ["query_id", "node"], "left_anti").select(
            "query_id", "target", "node", "n", "path", F.row_number().over(mine.orderBy("by")).alias("r"), F.count("*").over(mine).alias("more"), F.max(F.col("node") == F.col("target")).over(mine).alias("hit")
        )
        rank, path = (F.col("n") + F.col("r") - 1).alias("rank"), F.concat("path", F.array("node")).alias("path")
        fresh = _cut(fresh.select("query_id", "target", "node", F.lit(level).alias("level"), rank, path, (F.col("n") + F.col("more")).alias("n"), "hit"))
        if fresh.isEmpty():
            break
        if max_levels is not None and level > max_levels:
            raise ValueError(f"the search goes beyond {max_levels} levels")
        levels.append(fresh.drop("n", "hit"))
        frontier = fresh.where(~F.col("hit") & (F.lit(cap == -1) | (F.col("n") - 1 <= cap))).drop("hit")
    return reduce(DataFrame.unionByName, levels)


def bfs(queries: DataFrame, edges: DataFrame, cap: int = -1, max_levels: int | None = None) -> DataFrame:
    """Breadth-first search; the path follows first finders."""
    hit = F.max(F.when(F.col("node") == F.col("target"), F.struct("rank", "path")))
    found = bfs_ranks(queries, edges, cap, max_levels).groupBy("query_id").agg(F.count("*").alias("n"), hit.alias("hit"))
    known = queries.select("query_id").join(found, "query_id", "left")  # queries outside the graph visit nothing
    path, visited = capped(F.coalesce("hit.path", F.array().cast("array<string>")), F.coalesce("hit.rank", F.col("n"), F.lit(0)), F.lit(cap))
    return known.select("query_id", path.alias("path"), visited.cast("long").alias("visited"))


def reach(queries: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, hops): nodes within a number of hops of the source and their least distance."""
    seen = _cut(queries.select("query_id", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    adj = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    for level in range(1, hops + 1):
        found = frontier.join(adj, "node").select("query_id", F.col("next").alias("node")).distinct()
        frontier = _cut(found.join(seen, ["query_id", "node"], "left_anti").withColumn("hops", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def distances(queries: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(query_id, node, dist, parent): shortest costs from each source, by relaxation rounds. Costs must not be negative.

    Only nodes whose cost fell in a round go on; a query's nodes that cost more than its target are not followed.
    Rounds go on until no cost falls, unless max_rounds is given: then only paths of so many edges count (a bound on the paths
    that are asked for, not on the work)."""
    start = covered(queries, edges).select("query_id", "target", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("parent"))
    best = stored(start.withColumn("fresh", F.lit(True)), "best")
    adj = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "cost"), "adjacency")
    for _ in count() if max_rounds is None else range(max_rounds):
        goal = best.where("node = target").select("query_id", F.col("dist").alias("goal"))
        # nodes at the target's own cost still count as visited, so they stay
        front = best.where("fresh AND node <> target").join(goal, "query_id", "left").where("goal IS NULL OR dist <= goal")
        step = front.join(adj, "node").select("query_id", "target", F.col("next").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("node").alias("parent"), "goal")
        step = step.where("goal IS NULL OR dist <= goal").drop("goal").withColumn("new", F.lit(True))
        # one aggregation merges a round: what is known stands against an equal cost
        both = best.drop("fresh").withColumn("new", F.lit(False)).unionByName(step)
        both = both.groupBy("query_id", "node").agg(F.min(F.struct("dist", "new", "parent")).alias("d"), F.first("target").alias("target"))
        old, best = best, stored(both.select("query_id", "target", "node", "d.dist", "d.parent", F.col("d.new").alias("fresh")), "best")
        discard(old)
        if best.where("fresh").isEmpty():
            break
    discard(adj)
    return best.drop("fresh")


def within_hops(queries: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, cost): the least cost of a path of at most `hops` edges, for queries that have one.

    Half of the edges are walked from the source and half from the target, and the two sides meet in the middle: of d successors a
    node a query has about d^(hops / 2) rows, not d^hops. A round keeps a node's cheapest walk of exactly so many edges."""
    sides = []
    for start, end, near, rounds in (("source", "src", "dst", hops - hops // 2), ("target", "dst", "src", hops // 2)):
        adj = stored(edges.groupBy(F.col(end).alias("node"), F.col(near).alias("next")).agg(F.min("cost").alias("cost")), "adjacency")
        walks = [stored(queries.select("query_id", F.col(start).alias("node"), F.lit(0.0).alias("dist")), "walks")]
        for _ in range(rounds):
            step = walks[-1].join(adj, "node").select("query_id", F.col("next").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"))
            walks.append(stored(step.groupBy("query_id", "node").agg(F.min("dist").alias("dist")), "walks"))
        sides.append(reduce(DataFrame.unionByName, walks).groupBy("query_id", "node").agg(F.min("dist").alias("dist")))
    met = sides[0].join(sides[1].withColumnRenamed("dist", "rest"), ["query_id", "node"])
    return met.groupBy("query_id").agg(F.min(F.col("dist") + F.col("rest")).alias("cost"))


def dijkstra(queries: DataFrame, edges: DataFrame, cap: int = -1, shortest: Callable[[DataFrame, DataFrame], DataFrame] = distances) -> DataFrame:
    """Cheapest paths: (query_id, path, visited, path_cost), from the costs that `shortest` finds. Visits follow from the costs: a heap takes
    up exactly the nodes before the target in the order of (cost, name). Costs must be positive for that; where some are zero, paths
    and costs hold but nodes as dear as the target may count otherwise than by a heap's course (dijkstra_best_first follows it)."""
    best = shortest(queries, edges)
    goal = best.where("node = target").select("query_id", F.col("dist").alias("goal"))
    counted = best.join(goal, "query_id", "left")
    before = F.col("goal").isNull() | (F.struct("dist", "node") < F.struct(F.col("goal").alias("dist"), F.col("target").alias("node")))
    visits = counted.groupBy("query_id").agg(F.count_if(before).alias("n"), F.first("goal").alias("goal"), F.first("target").alias("target"), F.first(F.lit(1)).alias("one"))
    going = visits.where("goal IS NOT NULL").select("query_id", F.array("target").alias("path"), F.lit(False).alias("end"))
    done = None
    back = best.select(F.col("query_id").alias("q_"), F.col("node").alias("at_"), "parent")
    while True:
        step = going.join(back, (going.query_id == F.col("q_")) & (F.element_at("path", 1) == F.col("at_")))
        step = stored(step.select("query_id", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"), F.col("parent").isNull().alias("end")))
        ended = step.where("end").select("query_id", "path")
        done = ended if done is None else done.unionByName(ended)
        going = step.where("NOT end")
        if going.isEmpty():
            break
    known = visits.join(done.select("query_id", F.col("path").alias("p")), "query_id", "left")
    known = queries.select("query_id").join(known, "query_id", "left")
    path, visited = capped(F.coalesce("p", F.array().cast("array<string>")), F.coalesce("n", F.lit(0)), F.lit(cap))
    return known.select("query_id", path.alias("path"), visited.cast("long").alias("visited"), F.when(F.size(path) > 0, F.col("goal")).alias("path_cost"))


class Graph:
    """A graph in memory for searches that need a priority queue: successors in edge order, and vectors (or costs)."""

    def __init__(self, names: list[str], src: np.ndarray, dst: np.ndarray, vectors: np.ndarray | None, metric: str, cost: np.ndarray | None = None) -> None:
        self.names, self.number = names, {n: i for i, n in enumerate(names)}
        self.start = np.searchsorted(src, np.arange(len(names) + 1))
        self.dst, self.cost, self.metric = dst, cost, metric
        if vectors is not None and metric == "cosine":
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.vectors = vectors

    def between(self, a: int, others: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return 1 - self.vectors[others] @ self.vectors[a]
        return np.sqrt(((self.vectors[others] - self.vectors[a]) ** 2).sum(axis=1))


def heap_search(g: Graph, source: str, target: str, cap: int = -1, guided: bool = True) -> tuple[list[str], int, float | None]:
    """One search by a priority queue on (f, g, name): A* towards the target's vector, or plain cost order. Closed nodes aren't
    opened again; an equal cost doesn't replace an open one."""
    if source not in g.number or target not in g.number:
        return [], 0, None
    s, t = g.number[source], g.number[target]
    ahead = (lambda n: g.between(t, n)) if guided else (lambda n: np.zeros(len(n)))
    best, closed, visited = {s: 0.0}, set(), 0
    queue = [(float(ahead(np.array([s]))[0]), 0.0, source, s, None)]
    while queue:
        _, cost, _, node, link = heapq.heappop(queue)
        if node in closed:
            continue
        if node == t:
            path = [node]
            while link is not None:
                path.append(link[0])
                link = link[1]
            return [g.names[i] for i in reversed(path)], visited, cost
        closed.add(node)
        visited += 1
        if cap != -1 and visited > cap:
            return [], visited, None
        lo, hi = g.start[node], g.start[node + 1]
        near = g.dst[lo:hi]
        if not len(near):
            continue
        costs = (g.cost[lo:hi] if g.cost is not None else g.between(node, near)) + cost
        # the link is the chain of nodes up to this one, never changed afterwards
        chain = (node, link)
        for n, c, h in zip(near.tolist(), costs.tolist(), ahead(near).tolist()):
            if n in closed or c >= best.get(n, np.inf):
                continue
            best[n] = c
            heapq.heappush(queue, (c + h, c, g.names[n], n, chain))
    return [], visited, None


#: A graph of more nodes or edges than this, or of more bytes of vectors, is never broadcast; searches over it use the relational forms.
BROADCAST_NODES, BROADCAST_EDGES, BROADCAST_BYTES = 2_000_000, 20_000_000, 1 << 29


def memory_graph(edges: DataFrame, vectors: DataFrame | None, metric: str, dim: int | None = None, with_cost: bool = False) -> Graph:
    """Gather a graph whose size is checked first. vectors: (node, vec)."""
    n = edges.count()
    if n > BROADCAST_EDGES:
        raise ValueError(f"{n} edges are too many to broadcast; use the relational search")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    if n > BROADCAST_NODES:
        raise ValueError(f"{n} nodes are too many to broadcast; use the relational search")
    if vectors is not None:
        wide = min(vectors.agg(F.max(F.size("vec"))).first()[0] or 1, dim or 1 << 30)
        if n * wide * 8 > BROADCAST_BYTES:
            raise ValueError(f"vectors of {n * wide * 8} bytes are too many to broadcast; use the relational search")
    names = nodes.orderBy("node").toPandas()["node"].tolist()
    number = {x: i for i, x in enumerate(names)}
    e = edges.select("src", "dst", "pos", *(["cost"] if with_cost else [])).toPandas()
    e["s"], e["d"] = e["src"].map(number), e["dst"].map(number)
    e = e.sort_values(["s", "pos"], kind="stable")
    matrix = None
    if vectors is not None:
        v = vectors.join(nodes, "node", "left_semi").select("node", F.slice("vec", 1, dim or 1 << 30).cast("array<double>").alias("vec")).toPandas()
        matrix = np.zeros((len(names), len(v["vec"].iloc[0]) if len(v) else 1))
        for node, vec in zip(v["node"], v["vec"]):
            matrix[number[node]] = vec
    return Graph(names, e["s"].to_numpy(), e["d"].to_numpy(), matrix, metric, e["cost"].to_numpy() if with_cost else None)


def astar(queries: DataFrame, edges: DataFrame, vectors: DataFrame, metric: str = "euclidean", cap: int = -1, dim: int | None = None) -> DataFrame:
    """A* for every query over a graph of any size: (query_id, path, visited, path_cost). See best_first."""
    return best_first(queries, edges, vectors, metric, cap, dim)


def dijkstra_best_first(queries: DataFrame, edges: DataFrame, cap: int = -1) -> DataFrame:
    """Dijkstra in the course of a heap over a graph of any size, for costs that may be zero."""
    return best_first(queries, edges, None, cap=cap)


def astar_heap(queries: DataFrame, edges: DataFrame, vectors: DataFrame, metric: str = "euclidean", cap: int = -1, dim: int | None = None) -> DataFrame:
    """A* for every query, by a heap in the workers over a broadcast graph of checked size: (query_id, path, visited, path_cost).
    Repeated pairs are searched once."""
    return _heap(queries, memory_graph(edges, vectors, metric, dim), cap, True)


def dijkstra_heap(queries: DataFrame, edges: DataFrame, cap: int = -1) -> DataFrame:
    """Dijkstra by a heap, for costs that may be zero."""
    return _heap(queries, memory_graph(edges, None, "euclidean", None, True), cap, False)


def _heap(queries: DataFrame, graph: Graph, cap: int, guided: bool) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [heap_search(shared.value, s, t, cap, guided) for s, t in zip(b["source"], b["target"])]
            yield pd.DataFrame({"source": b["source"], "target": b["target"], "path": [r[0] for r in rows], "visited": [r[1] for r in rows], "path_cost": [r[2] for r in rows]})

    pairs = queries.select("source", "target").distinct()
    n = spark.sparkContext.defaultParallelism
    found = pairs.repartition(n).mapInPandas(run, "source string, target string, path array<string>, visited long, path_cost double")
    out = queries.select("query_id", "source", "target").join(found, ["source", "target"])
    return out.select("query_id", "path", "visited", F.nanvl("path_cost", F.lit(None).cast("double")).alias("path_cost"))


def astar_euclidean(queries: DataFrame, edges: DataFrame, vectors: DataFrame, cap: int = -1) -> DataFrame:
    """A* under Euclidean distance without a heap, for graphs of any size: (query_id, path, visited, path_cost). Edge cost and
    heuristic are the same metric, so costs are those of the cheapest path and visits are the nodes before the target in
    the order of (f, g, name), the source always. edges carry cost (the Euclidean distance of their ends)."""
    best = distances(queries, edges)
    vec = vectors.select("node", V.as_double(F.col("vec")).alias("v"))
    far = best.join(vec, "node").join(vec.select(F.col("node").alias("target"), F.col("v").alias("tv")), "target")
    far = far.select("query_id", "node", "target", F.col("dist").alias("g"), (F.col("dist") + V.euclidean(F.col("v"), F.col("tv"))).alias("f"))
    goal = far.where("node = target").select("query_id", F.col("g").alias("goal"))
    order = F.struct("f", "g", "node") < F.struct(F.col("goal").alias("f"), F.col("goal").alias("g"), F.col("target").alias("node"))
    counted = far.join(goal, "query_id", "left").groupBy("query_id").agg(F.count_if(F.col("goal").isNull() | ((F.col("g") == 0) & (F.col("node") != F.col("target"))) | ((F.col("g") > 0) & order)).alias("n"))
    plain = dijkstra(queries, edges, shortest=lambda *_: best)
    joined = plain.join(counted, "query_id", "left")
    path, visited = capped(F.col("path"), F.coalesce("n", F.lit(0)), F.lit(cap))
    return joined.select("query_id", path.alias("path"), visited.cast("long").alias("visited"), F.when(F.size(path) > 0, F.col("path_cost")).alias("path_cost"))


def budget_sweep(results: DataFrame, budgets: list[int]) -> DataFrame:
    """(…, cap, path, visited) of every search under every budget, from one uncapped run."""
    caps = F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])).alias("cap")
    path, visited = capped(F.col("path"), F.col("visited"), F.col("cap"))
    rest = [c for c in results.columns if c not in ("path", "visited")]
    return results.select("*", caps).select(*rest, "cap", path.alias("path"), visited.alias("visited"))


def kept(rows: DataFrame, keys: list[str], order: list[Column], width: int) -> DataFrame:
    """The first `width` rows of each group by order, with their rank r."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= width)


def beam_search(queries: DataFrame, multigraph: DataFrame, score, rounds: int = 2, width: int = 50, max_actions: int = 5000) -> DataFrame:
    """Beam search: (query_id, path, visited, found). score(df) adds `score` to rows with query_id, beam, path, node, action,
    next, sentence; action 0 stays at the node. multigraph: (src, edges array of (seq, dst, sentence)) in file order.

    In each round scores become log-softmax over a beam item's actions (exact zeros are masked), sums are ranked, ties by
    item and action, and `width` stay. Visits are the nodes of the kept paths, in rank order, until the target is seen."""
    eps = float(np.finfo(np.float32).eps)
    items = queries.select("query_id", "target", F.lit(0).alias("beam"), F.array("source").alias("path"), F.lit(0.0).alias("prob"))
    seen = queries.select("query_id", F.array("source").alias("nodes"), (F.col("source") == F.col("target")).alias("found"))
    for _ in range(rounds):
        at = items.withColumn("node", F.element_at("path", -1)).join(multigraph.withColumnRenamed("src", "node"), "node", "left")
        stay = F.struct(F.lit(-1).cast("long").alias("seq"), F.col("node").alias("dst"), F.lit("stop").alias("sentence"))
        moves = F.concat(F.array(stay), F.slice(F.coalesce("edges", F.array().cast("array<struct<seq:bigint,dst:string,sentence:string>>")), 1, max_actions - 1))
        acts = at.select("query_id", "target", "beam", "path", "prob", "node", F.posexplode(moves).alias("action", "m"))
        acts = acts.select("query_id", "target", "beam", "path", "prob", "node", "action", F.col("m.dst").alias("next"), F.col("m.sentence").alias("sentence"))
        scored = score(acts)
        item = Window.partitionBy("query_id", "beam")
        raw = F.when(F.col("score") != 0, F.col("score"))
        e = F.coalesce(F.exp(raw - F.max(raw).over(item)), F.lit(0.0))
        scored = scored.withColumn("e_", e).withColumn("p_", F.log(F.greatest(F.col("e_") / F.sum("e_").over(item), F.lit(eps))))
        best = kept(scored, ["query_id"], [(F.col("prob") + F.col("p_")).desc(), F.col("beam"), F.col("action")], width)
        items = _cut(best.select("query_id", "target", (F.col("r") - 1).alias("beam"), F.concat("path", F.array("next")).alias("path"), (F.col("prob") + F.col("p_")).alias("prob")))
        ordered = items.groupBy("query_id", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("beam", "path"))), lambda x: x["path"]).alias("paths"))
        merged = seen.join(ordered, "query_id")
        state = F.aggregate(
            "paths",
            F.struct("nodes", "found"),
            lambda acc, p: F.struct(
                F.when(acc["found"], acc["nodes"]).otherwise(F.array_union(acc["nodes"], p)).alias("nodes"),
                (acc["found"] | F.array_contains(p, F.col("target"))).alias("found"),
            ),
        )
        seen = _cut(merged.select("query_id", state.alias("s")).select("query_id", "s.nodes", "s.found"))
    hit = items.where(F.array_contains("path", F.col("target"))).groupBy("query_id").agg(F.min_by("path", "beam").alias("p"))
    out = seen.join(hit, "query_id", "left")
    return out.select("query_id", F.coalesce("p", F.array().cast("array<string>")).alias("path"), F.size("nodes").cast("long").alias("visited"), F.col("p").isNotNull().alias("found"))


#: name -> search(queries, edges, **settings), all with (query_id, path, visited).
STRATEGIES = {"bfs": bfs, "dijkstra": dijkstra, "dijkstra_best_first": dijkstra_best_first, "dijkstra_heap": dijkstra_heap, "astar": astar, "astar_heap": astar_heap, "astar_euclidean": astar_euclidean}


def run_strategies(queries: DataFrame, edges: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Every query by every named strategy: (algorithm, query_id, path, visited)."""
    parts = [STRATEGIES[n](queries, edges, **s).select(F.lit(n).alias("algorithm"), "query_id", "path", "visited") for n, s in settings.items()]
    return reduce(DataFrame.unionByName, parts)
