"""Connected components by contraction, with a bounded number of rounds in expectation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (node, root): one root for each component, for every node of a link.

    A round sends each node to whichever of itself and its neighbours has the least hash, and replaces the links by
    those between the images. Images of linked nodes stay linked, and nodes of different components stay apart, so
    once no link is left the composed maps name the components. Hash order makes the number of nodes fall by a
    constant factor in expectation, whatever the shape (a path in id order would take as many rounds as nodes).
    Hubs are pre-aggregated on the map side; nothing is collected but one count a round. No links: no rows.
    """
    pair = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    # both directions from one evaluation of the links, which may be dear
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")
    links = stored(pair.select(ways).select("w.u", "w.v").distinct(), "links")
    names = stored(links.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "names")
    while not links.isEmpty():
        old = links, names
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("to"))
        other = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("to")))
        step = stored(links.groupBy("u").agg(other.alias("o")).select("u", F.least(own, F.col("o"))["to"].alias("to")), "step")
        names = stored(
            names.join(step, names.root == step.u, "left").select("node", F.coalesce("to", "root").alias("root")), "names"
        )
        left, right = step.toDF("u", "a"), step.toDF("v", "b")
        links = stored(
            links.join(left, "u").join(right, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(),
            "links",
        )
        discard(*old, step)
    discard(links)
    return names
