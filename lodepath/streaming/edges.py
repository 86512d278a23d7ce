"""Incremental ingestion of edges, as an extension: new files of edges are deduplicated and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cause string, effect string, support bigint, seen_at timestamp"


def edge_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Edges from Parquet files that arrive in a folder; a pair that comes again within the delay is dropped."""
    rows = spark.readStream.schema(SCHEMA).parquet(path).where("cause <> effect")
    return rows.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["cause", "effect"])


def support_stream(edges: DataFrame, window: str = "1 hour") -> DataFrame:
    """Support by pair and window."""
    return edges.groupBy(F.window("seen_at", window), "cause", "effect").agg(F.sum("support").alias("support"))
