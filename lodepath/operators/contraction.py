"""Connected components and spanning forests by contraction: rounds grow with the logarithm of the nodes, not with the diameter."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.plans.session import discard, stored

#: Links that one task may finish.
SMALL = 50_000


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, to) and the columns of the link: what is left, joined up by sets of nodes; u goes to the least node of its component."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    gone, at = [], []
    for i, (a, b) in enumerate(zip(pdf["a"], pdf["b"])):
        x, y = sorted((top(a), top(b)))
        if x != y:
            up[y] = x
            gone.append(y)
            at.append(i)
    out = pdf.drop(columns=["a", "b"]).iloc[at].reset_index(drop=True)
    out.insert(0, "u", gone)
    out.insert(1, "to", [top(u) for u in gone])
    return out


def _tops(step: DataFrame) -> DataFrame:
    """(u, to) that lead on without a cycle -> the same u, each with the last node of its way; every pass doubles the ways."""
    up, moved = step.select("u", "to"), True
    old = None
    while moved:
        on = up.select(F.col("u").alias("to"), F.col("to").alias("on"))
        ways = up.join(on, "to", "left").select("u", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"))
        ways = stored(ways, "up")
        if old is not None:
            discard(old)
        old, up, moved = ways, ways.select("u", "to"), not ways.where("moved").isEmpty()
    return old


def contract(links: DataFrame, small: int = SMALL, edges: bool = True) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) -> for each round the nodes that went (u, to) and, with `edges`, the links (cause, effect) by which they went:
    all of these are a spanning forest, each in its own direction.

    A round ranks the nodes by a hash; a node goes to its neighbour of the least rank if that is less than its own. Ways so made
    descend, so they have no cycle and end at nodes that are least among their neighbours; each node goes to the end of its way,
    and the links between the ends go on. A node of d neighbours stays with probability 1 / (d + 1), so a round leaves at most
    half of the nodes in expectation, a third on a path and few of a dense graph: rounds are logarithmic whatever the shape, and
    dense links are read in few of them. Hubs are aggregated on the map side, in columns of fixed width where nodes are numbers.
    At most `small` links are finished by one task. Loops are left out and repeated links count once; null ends are left
    out; no links: no rows.
    """
    ends = ["cause", "effect"] if edges else []
    now = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "links")
    kind = now.schema["a"].dataType.simpleString()
    ups: list[DataFrame] = []
    steps: list[DataFrame] = []
    while left := now.count():
        links = now if steps or not edges else now.select("a", "b", F.col("a").alias("cause"), F.col("b").alias("effect"))
        if left <= small:
            step = up = stored(links.groupBy().applyInPandas(_merged, ", ".join(f"{c} {kind}" for c in ("u", "to", *ends))), "step")
        else:
            rank = lambda c: F.xxhash64(F.lit(len(steps)), c)
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), *ends))
            least = both.groupBy(F.col("a").alias("u")).agg(F.min_by("b", rank("b")).alias("to"), *[F.min_by(c, rank("b")).alias(c) for c in ends])
            step = stored(least.where(rank("to") < rank("u")), "step")
            up = _tops(step)
        ups, steps, old = [*ups, up], [*steps, step], now
        image = lambda c: up.select(F.col("u").alias(c), F.col("to").alias(f"{c}_"))
        moved = links.join(image("a"), "a", "left").join(image("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"), *ends)
        moved = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        one = [F.min_by(c, F.xxhash64(*ends)).alias(c) for c in ends] or [F.lit(0).alias("n_")]
        now = stored(moved.agg(*one).select("a", "b", *ends), "links")
        discard(old)
    discard(now)
    return ups, steps


def components(edges: DataFrame, a: str = "cause", b: str = "effect", small: int = SMALL) -> DataFrame:
    """(node, root): one root for each component of the undirected edges, for every node of an edge that is no loop.

    The rounds' maps are composed backwards, so all of it reads each node a bounded number of times in expectation."""
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    gone = None
    for up in reversed(contract(links, small, edges=False)[0]):
        here = up.select(F.col("u").alias("node"), F.col("to").alias("root"))
        if gone is not None:
            further = gone.select(F.col("node").alias("root"), F.col("root").alias("further"))
            here = gone.unionByName(here.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
        old, gone = gone, stored(here, "gone")
        if old is not None:
            discard(old)
    if gone is None:
        return edges.sparkSession.createDataFrame([], links.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    return gone.unionByName(gone.select("root").distinct().select(F.col("root").alias("node"), "root"))


def forest(edges: DataFrame, a: str = "cause", b: str = "effect", small: int = SMALL) -> DataFrame:
    """The edges (a, b) of a spanning forest: of each component of n nodes n - 1 edges without a cycle, in their own direction."""
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if steps := contract(links, small)[1]:
        return reduce(DataFrame.unionByName, [s.select(F.col("cause").alias(a), F.col("effect").alias(b)) for s in steps])
    return edges.sparkSession.createDataFrame([], edges.select(a, b).schema)


def greatest_of(keys: DataFrame, names: DataFrame, key: Column) -> DataFrame:
    """keys (node, ...) with root: the greatest key of the node's component; a node without links is its own component."""
    named = keys.join(names.withColumnRenamed("root", "name_"), "node", "left").withColumn("name_", F.coalesce("name_", "node"))
    best = named.groupBy("name_").agg(F.max(key).alias("root"))
    return named.join(best, "name_").drop("name_")
