"""Graphs and questions derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with n, the number of rows, on each."""
    e = table(spark, sf_dir, "embeddings")
    return e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n"))))


def graph_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector ring: (src, dst, pos, support, s, d)."""
    e = vector_rows(spark, sf_dir).select(F.col("vec_id").alias("s"), "n", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("k"))
    e = e.withColumn("d", (F.col("s") * 7 + F.col("k") * 13 + 1) % F.col("n")).where("s <> d")
    return e.select(F.concat(F.lit("v"), "s").alias("src"), F.concat(F.lit("v"), "d").alias("dst"), (F.col("s") * 3 + F.col("k")).alias("pos"), (F.col("k") + 1).alias("support"), "s", "d")


def vectors_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"))


def questions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, source, target): every node asks for one other."""
    e = vector_rows(spark, sf_dir)
    return e.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("v"), "vec_id").alias("source"), F.concat(F.lit("v"), (F.col("vec_id") * 37 + 11) % F.col("n")).alias("target"))


def raw_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part successions, one row for each: (cause, effect, edge_seq, graph_source). Equal rows of edge_seq have equal attributes."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    b = item.select("l_orderkey", F.col("l_partkey").alias("next"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    rows = item.join(b, ["l_orderkey", "l_linenumber"]).where("l_partkey <> next")
    return rows.select(F.col("l_partkey").alias("cause"), F.col("next").alias("effect"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_seq"), F.concat(F.lit("o"), "l_orderkey").alias("graph_source"))


def graph_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_p(spark, sf_dir).groupBy("cause", "effect").agg(F.count("*").alias("support"), F.min("edge_seq").alias("pos"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, path): the parts of each order by line."""
    item = table(spark, sf_dir, "lineitem")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return item.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(listed, lambda x: x["l_partkey"]).alias("path"))


V_SQL = """n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id AS s, (vec_id * 7 + k * 13 + 1) % n AS d, vec_id * 3 + k AS pos, k + 1 AS support
      FROM embeddings, n, (SELECT unnest([0, 1, 2]) AS k) WHERE vec_id <> (vec_id * 7 + k * 13 + 1) % n),
q AS (SELECT vec_id AS query_id, vec_id AS source, (vec_id * 37 + 11) % n AS target FROM embeddings, n)"""
RAW_P_SQL = """raw AS (SELECT a.l_partkey AS cause, b.l_partkey AS effect, a.l_orderkey * 100 + a.l_linenumber AS edge_seq, 'o' || a.l_orderkey AS graph_source
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
p AS (SELECT cause, effect, count(*) AS support, min(edge_seq) AS pos FROM raw GROUP BY ALL)"""
PATH_SQL = """steps AS (SELECT l_orderkey AS query_id, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
pairs AS (SELECT query_id, i, node, lead(node) OVER (PARTITION BY query_id ORDER BY i) AS next FROM steps)"""
