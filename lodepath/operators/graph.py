"""Graph tables: dedup, nodes, adjacency, degrees, neighbourhoods, previews."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import text as X
from lodepath.operators.contraction import components, greatest_of
from lodepath.plans.session import checkpointed as _cut
from lodepath.plans.session import stored
from lodepath.sources.readers import dense_ids


def dedup_edges(edges: DataFrame, attributes: list[str], inverse: bool = False) -> DataFrame:
    """One row for each (cause, effect): pos is its first edge_seq, attributes are those of its last. With inverse, reverse edges
    are added right after their own and the flag stays on a pair that ever was one."""
    rows = edges.select("cause", "effect", "edge_seq", *attributes)
    if inverse:
        back = rows.select(F.col("effect").alias("cause"), F.col("cause").alias("effect"), (F.col("edge_seq") * 2 + 1).alias("edge_seq"), *attributes, F.lit(True).alias("inverse"))
        rows = rows.withColumn("edge_seq", F.col("edge_seq") * 2).withColumn("inverse", F.lit(False)).unionByName(back)
    last = F.max_by(F.struct(*attributes), "edge_seq").alias("a_") if attributes else F.lit(None).alias("a_")
    more = [F.bool_or("inverse").alias("inverse")] if inverse else []
    out = rows.groupBy("cause", "effect").agg(F.min("edge_seq").alias("pos"), last, *more)
    return out.select("cause", "effect", "pos", *[F.col(f"a_.{a}").alias(a) for a in attributes], *(["inverse"] if inverse else []))


def nodes_of(edges: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()


def union_nodes(*tables: DataFrame) -> DataFrame:
    """The merged universe of several graphs' nodes."""
    out = tables[0].select("node")
    for t in tables[1:]:
        out = out.union(t.select("node"))
    return out.distinct()


def ordered_multigraph(edges: DataFrame) -> DataFrame:
    """(src, dsts): neighbours in file order, repeats kept, and the sentence that the last edge of a pair gives."""
    last = Window.partitionBy("cause", "effect").orderBy("edge_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = edges.withColumn("sentence", F.coalesce(F.last("sentence").over(last), F.concat_ws(" can cause ", "cause", "effect")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("edge_seq").alias("seq"), F.col("effect").alias("dst"), "sentence")))
    return rows.groupBy(F.col("cause").alias("src")).agg(listed.alias("edges"))


def adjacency(edges: DataFrame, nodes: DataFrame | None = None, src: str = "cause", dst: str = "effect", pos: str = "pos") -> DataFrame:
    """(src, dsts): successors by position; only of listed nodes if nodes are given."""
    if nodes is not None:
        keep = nodes.select(F.col("node").alias("n_"))
        edges = edges.join(keep, edges[src] == F.col("n_"), "left_semi").join(keep, edges[dst] == F.col("n_"), "left_semi")
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(dst).alias("dst"))))
    return edges.groupBy(F.col(src).alias("src")).agg(F.transform(listed, lambda x: x["dst"]).alias("dsts"))


def degrees(edges: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    """(node, out_degree, in_degree, degree) in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    out = ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def graph_stats(edges: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    """One row: nodes, edges, distinct edges, average degree."""
    pairs = edges.groupBy(src, dst).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("edges"), F.count("*").alias("distinct_edges"))
    n = nodes_of(edges, src, dst).agg(F.count("*").alias("nodes"))
    return n.crossJoin(pairs).withColumn("avg_degree", F.when(F.col("nodes") > 0, F.col("distinct_edges") / F.col("nodes")).otherwise(0.0))


def without_nodes(edges: DataFrame, gone: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    g = gone.select(F.col("node").alias("n_"))
    return edges.join(g, edges[src] == F.col("n_"), "left_anti").join(g, edges[dst] == F.col("n_"), "left_anti")


def induced(edges: DataFrame, nodes: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    n = nodes.select(F.col("node").alias("n_"))
    return edges.join(n, edges[src] == F.col("n_"), "left_semi").join(n, edges[dst] == F.col("n_"), "left_semi")


def hub(deg: DataFrame) -> DataFrame:
    """The node of the greatest degree; the least name among equals."""
    return deg.agg(F.min_by("node", F.struct((-F.col("degree")).alias("d"), "node")).alias("node"))


def two_hop_pairs(edges: DataFrame, src: str = "cause", dst: str = "effect") -> DataFrame:
    """(src, dst) two edges apart, without a direct edge and not a node with itself."""
    a = edges.select(F.col(src).alias("src"), F.col(dst).alias("mid"))
    b = edges.select(F.col(src).alias("mid"), F.col(dst).alias("dst"))
    direct = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return a.join(b, "mid").where("src <> dst").select("src", "dst").distinct().join(direct, ["src", "dst"], "left_anti")


def warm_up_pair(edges: DataFrame, wanted: int = 16) -> DataFrame:
    """A pair for a warm-up search: the source with a two-hop target whose out-degree is closest above `wanted` (else the
    greatest), and its first such target; the least edge if there is no such pair."""
    out = edges.groupBy(F.col("cause").alias("src")).agg(F.countDistinct("effect").alias("n"))
    best = two_hop_pairs(edges).groupBy("src").agg(F.min("dst").alias("dst")).join(out, "src")
    rank = F.struct((F.col("n") < wanted).alias("below"), F.abs(F.col("n") - wanted).alias("off"), "src")
    one = best.agg(F.min_by(F.struct("src", "dst"), rank).alias("p"))
    first = edges.agg(F.min(F.struct(F.col("cause").alias("src"), F.col("effect").alias("dst"))).alias("f"))
    return one.crossJoin(first).select(F.coalesce("p", "f").alias("p")).select("p.src", "p.dst")


def neighbourhood(edges: DataFrame, centres: DataFrame, depth: int, limit: int) -> DataFrame:
    """Nodes within depth steps either way, (node, round), at most limit; of a round's candidates those of greater degree, then
    out-degree, in-degree and name come first. A round's limit is a top-k, so no task sorts all candidates."""
    deg = degrees(edges)
    both = edges.select(F.col("cause").alias("a"), F.col("effect").alias("b")).union(edges.select("effect", "cause")).distinct()
    picked = centres.select("node").distinct().join(deg.select("node"), "node", "left_semi").withColumn("round", F.lit(0))
    size = picked.count()
    frontier = picked
    for k in range(1, depth + 1):
        if size >= limit:
            break
        near = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = near.join(picked, "node", "left_anti").join(deg, "node")
        fresh = fresh.orderBy(F.desc("degree"), F.desc("out_degree"), F.desc("in_degree"), F.desc("node")).limit(limit - size)
        frontier = _cut(fresh.select("node", F.lit(k).alias("round")))
        size += frontier.count()
        picked = picked.unionByName(frontier)
    return picked


def overview(edges: DataFrame, budget: int) -> DataFrame:
    """A preview: the hub and its neighbours, two steps out if one doesn't fill the budget."""
    seed = hub(degrees(edges))
    near = neighbourhood(edges, seed, 1, budget)
    return near if near.count() >= budget else neighbourhood(edges, seed, 2, budget)


def result_neighbourhood(edges: DataFrame, path: list[str], source: str, target: str, least: int = 240) -> DataFrame:
    centres = path or [source, target]
    given = edges.sparkSession.createDataFrame([(c,) for c in centres], "node string")
    near = neighbourhood(edges, given, 1, max(least, len(centres) + 40)).select("node")
    return near.union(given).distinct()


def spanning_forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, tree, level, step): undirected breadth-first trees over selected nodes, with the edges that reach a node
    first. A tree's root is its node of the greatest (degree, name); nodes of a level go by their finder's place, then by
    degree, out-degree, in-degree and name, greatest first; step numbers the edges by tree, level and that order.

    Roots are found by contraction, in rounds logarithmic in the nodes, and all trees then grow by a level a round, as the
    levels are what is asked for (`contraction.forest` has no levels and needs no such rounds). Places and steps are numbered
    by ranges and offsets, so no task orders a whole level or table. An edge both ways counts as its lesser one.
    """
    deg = degrees(edges).join(nodes.select("node").distinct(), "node", "left_semi")
    keys = deg.select("node", F.struct("degree", "out_degree", "in_degree", "node").alias("key"), F.struct("degree", "node").alias("own"))
    inside = induced(edges, nodes).where("cause <> effect").select("cause", "effect").distinct()
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.struct("cause", "effect").alias("edge")) for a, b in (("cause", "effect"), ("effect", "cause"))]
    links = stored(inside.select(F.explode(F.array(*ends)).alias("l")).groupBy("l.a", "l.b").agg(F.min("l.edge").alias("edge")))
    known = stored(greatest_of(keys, components(links, "a", "b"), F.col("own")).select("node", "root", "key"))
    seen = stored(known.where("root.node = node").select("node", "root", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"), F.lit(None).cast(links.schema["edge"].dataType).alias("edge")))
    frontier = seen
    for level in count(1):
        reached = frontier.join(links.withColumnRenamed("edge", "by"), frontier.node == links.a).select(F.col("b").alias("node"), "place", "by")
        found = reached.groupBy("node").agg(F.min_by(F.struct("place", "by"), "place").alias("f")).join(seen.select("node"), "node", "left_anti").join(known, "node")
        found = stored(found.select("node", "root", "key", F.col("f.place").alias("from"), F.col("f.by").alias("edge")))
        if found.isEmpty():
            break
        frontier = stored(dense_ids(found, [F.col("from"), F.desc("key")], "place").select("node", "root", F.lit(level).alias("level"), "place", "edge"))
        seen = seen.unionByName(frontier)
    numbered = dense_ids(known.select("root").distinct(), [F.desc("root")], "tree").select("root", (F.col("tree") + 1).cast("int").alias("tree"))
    made = stored(seen.where("level > 0").join(numbered, "root"))
    out = dense_ids(made, [F.col("tree"), F.col("level"), F.col("place")], "step")
    return out.select("edge.cause", "edge.effect", "tree", "level", F.col("step").cast("int")).toDF("source", "target", "tree", "level", "step")


def visual_links(edges: DataFrame, nodes: DataFrame, path: list[str], limit: int) -> DataFrame:
    """(source, target, stage, is_path) for a drawing: the path's edges, then a spanning forest, then others by source and
    position until the limit. Only the last stage stops there."""
    spark = edges.sparkSession
    steps = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(zip(path, path[1:]))], "source string, target string, step int")
    rest = induced(edges, nodes).select(F.col("cause").alias("source"), F.col("effect").alias("target"), F.row_number().over(Window.orderBy("cause", "pos")).cast("int").alias("step"))
    all_ = steps.withColumn("stage", F.lit(0)).unionByName(spanning_forest(edges, nodes).select("source", "target", "step").withColumn("stage", F.lit(1))).unionByName(rest.withColumn("stage", F.lit(2)))
    first = all_.groupBy("source", "target").agg(F.min(F.struct("stage", "step")).alias("f")).select("source", "target", "f.stage", "f.step")
    ranked = first.withColumn("r", F.row_number().over(Window.orderBy("stage", "step")))
    return ranked.where((F.col("stage") < 2) | (F.col("r") <= limit)).select("source", "target", "stage", (F.col("stage") == 0).alias("is_path"))


def payload(nodes: DataFrame, links: DataFrame, deg: DataFrame, path: list[str], source: str | None, target: str | None) -> DataFrame:
    """One row of JSON: nodes with label, degree and status, and links."""
    known = nodes.join(deg, "node", "left")
    status = X.node_status(F.col("node"), F.lit(source).cast("string"), F.lit(target).cast("string"), F.array(*[F.lit(p) for p in path]).cast("array<string>"))
    n = known.select(F.struct(F.col("node").alias("id"), F.col("node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"), status.alias("status")).alias("n"))
    a = n.agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    b = links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "is_path"))).alias("links"))
    return a.crossJoin(b).select(F.to_json(F.struct("nodes", "links")).alias("payload"))


def path_quadruples(paths: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(query_id, step, start, end, positive, negative): for each step of a path, every other successor of the node left is a
    negative. paths: (query_id, path)."""
    steps = paths.select("query_id", F.posexplode(X.path_edges(F.col("path"))).alias("step", "e"), F.element_at("path", -1).alias("end"))
    e = edges.select(F.col(src).alias("s_"), F.col(dst).alias("negative")).distinct()
    joined = steps.join(e, (F.col("e.source") == F.col("s_")) & (F.col("negative") != F.col("e.target")))
    return joined.select("query_id", "step", F.col("e.source").alias("start"), "end", F.col("e.target").alias("positive"), "negative")
