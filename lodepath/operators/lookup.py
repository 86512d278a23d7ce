"""Finding nodes by text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.plans.session import stored

#: Rows of a block of the prefix index are two to this power.
BLOCK_BITS = 12
#: A prefix index of more blocks than this (4 billion nodes) is refused, as their bounds are sent to every task.
MOST_BLOCKS = 1_000_000
#: Texts that no node begins with are looked up by their first so many characters.
GRAM = 3


def autocomplete(nodes: DataFrame, query: str, limit: int = 20, exact_case: bool = False) -> DataFrame:
    """Nodes that begin with the query, else nodes that hold it, by name; the first ones for an empty query. Case doesn't count
    unless exact_case, where nodes are compared as they are with the lower-case query."""
    q = query.strip().lower()
    text = F.col("node") if exact_case else F.lower("node")
    if not q:
        return nodes.select("node").orderBy("node").limit(limit)
    hit = F.when(F.startswith(text, F.lit(q)), 0).when(F.contains(F.lower("node"), F.lit(q)), 1)
    rows = nodes.select("node", hit.alias("kind")).where("kind IS NOT NULL")
    best = rows.agg(F.min("kind").alias("best"))
    return rows.join(F.broadcast(best), F.col("kind") == F.col("best")).orderBy("node").limit(limit).select("node")


def folded(nodes: DataFrame) -> DataFrame:
    """(folded, node): for each text in lower case, its least node."""
    order = Window.partitionBy(F.lower("node")).orderBy("node")
    return nodes.select(F.lower("node").alias("folded"), "node", F.row_number().over(order).alias("r")).where("r = 1").drop("r")


def canonical(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text, node): the node itself, else one that differs in case only, else null."""
    w = wanted.select(F.trim("text").alias("text")).distinct()
    exact = nodes.select(F.col("node").alias("text"), F.col("node").alias("e_")).distinct()
    out = w.join(exact, "text", "left").join(folded(nodes), F.lower("text") == F.col("folded"), "left")
    return out.select("text", F.coalesce("e_", "node").alias("node"))


def suggestions(nodes: DataFrame, missing: str) -> DataFrame:
    return autocomplete(nodes, missing, 5)


def write_prefix_index(nodes: DataFrame, path: str) -> None:
    """Nodes in the order of their lower-case texts, in numbered blocks, as Parquet with small row groups whose statistics name the blocks;
    beside it each block's first and last text. Null nodes and repeats don't count; other columns are not kept."""
    rows = nodes.select(F.lower("node").alias("folded"), "node").where("node IS NOT NULL").distinct()
    ordered = rows.repartitionByRange("folded", "node").sortWithinPartitions("folded", "node")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    ordered.select(block.alias("block"), "folded", "node").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/nodes")
    made = nodes.sparkSession.read.parquet(f"{path}/nodes")
    made.groupBy("block").agg(F.min("folded").alias("first"), F.max("folded").alias("last")).write.mode("overwrite").parquet(f"{path}/blocks")


def _routes(spark: SparkSession, texts: DataFrame, path: str) -> DataFrame:
    """(query_id, q, block): the blocks that can hold texts beginning with q, found by bisection in the blocks' bounds."""
    blocks = spark.read.parquet(f"{path}/blocks")
    n = blocks.count()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks are too many; split the index")
    bounds = blocks.orderBy("block").toPandas()
    shared = spark.sparkContext.broadcast((bounds["block"].tolist(), bounds["first"].tolist(), bounds["last"].tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, first, last = shared.value
        for b in batches:
            for i, q in zip(b["query_id"], b["q"]):
                lo = bisect_left(last, q)
                hi = bisect_left(first, True, lo, key=lambda f, q=q: f > q and not f.startswith(q))
                if hi > lo:
                    yield pd.DataFrame({"query_id": i, "q": q, "block": number[lo:hi]})

    kind = texts.schema["query_id"].dataType.simpleString()
    return texts.mapInPandas(run, f"query_id {kind}, q string, block long")


def _grams(k: int) -> Column:
    """All runs of k characters of the text, none if it has fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.length("folded") - (k - 1)), lambda i: F.substring(F.col("folded"), i, F.lit(k)))
    return F.when(F.length("folded") >= k, runs).otherwise(F.array().cast("array<string>"))


def complete(spark: SparkSession, path: str, texts: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, node) for a batch of texts (query_id, text) over an index of write_prefix_index: what `autocomplete` finds for each, the
    first `limit` nodes by name that begin with it, case aside, else those that hold it. A null text counts as empty; ids must be
    unique and not null.

    Each text is sent to the blocks whose bounds let it in, and meets their rows by block number; the least and greatest block of
    the batch are filters on the scan. Only for texts that nothing begins with is the index read whole, once for all of them: nodes
    meet them on their first three characters (all, if fewer)."""
    asked = stored(texts.select("query_id", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("q")), "texts")
    index = spark.read.parquet(f"{path}/nodes")
    routes = stored(_routes(spark, asked, path), "routes")
    least, most = routes.agg(F.min("block"), F.max("block")).first()
    near = index.where(F.col("block").between(F.lit(least).cast("long"), F.lit(most).cast("long")))
    order = Window.partitionBy("query_id").orderBy("node")
    top = lambda df: df.select("query_id", F.row_number().over(order).alias("rank"), "node").where(F.col("rank") <= limit)
    found = stored(top(routes.join(near, "block").where(F.startswith("folded", "q"))), "found")
    missed = stored(asked.join(found, "query_id", "left_anti").where("q <> ''").withColumn("gram", F.substring("q", 1, GRAM)), "missed")
    sizes = [r[0] for r in missed.select(F.length("gram")).distinct().collect()]
    if not sizes:
        return found
    grams = [_grams(k) for k in sizes]
    each = index.select("folded", "node", F.explode(F.array_distinct(F.concat(*grams))).alias("gram"))
    return found.unionByName(top(each.join(missed, "gram").where(F.contains("folded", "q"))))
