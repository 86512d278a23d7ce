"""Line dedup by spread over sites: lines that many sites have are boilerplate and go.

Each line hash gathers a HyperLogLog sketch of the sites it is on; sketches merge in the aggregation, on the map side first,
so a line that is everywhere costs a sketch for each task. Lines whose estimate is near the threshold (within four
standard errors of the sketch, and two sites at least) get an exact distinct count, and no other line does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import stored


def line_key(line: Column) -> tuple[Column, Column]:
    """128 bits of a line, trimmed of ASCII white space: two hashes of different bytes."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def lines_of(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(row_id, row_hash, at, h1, h2, site) of every line that isn't blank. A row is known by its id and text; rows that are
    alike in both have the same lines and share their fate."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(text).alias("row_hash"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.transform(F.split(text, "\n", -1), trimmed)).alias("at", "line"))
    return rows.where("line <> ''").select("row_id", "row_hash", "at", *line_key(F.col("line")), "site")


def boilerplate(lines: DataFrame, sites: int = 8, lg_k: int = 10) -> DataFrame:
    """(h1, h2) of the lines on at least `sites` sites. A null site is no site."""
    near = max(2.0, 4 * 1.04 / math.sqrt(1 << lg_k) * sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites - near)
    spread = stored(spread, "spread")
    unsure = spread.where(F.col("estimate") < sites + near)
    exact = lines.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= sites)
    return spread.where(F.col("estimate") >= sites + near).select("h1", "h2").union(exact.select("h1", "h2"))


def cleaned(docs: DataFrame, sites: int = 8, lg_k: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with clean_text (the text without boilerplate lines, other lines untouched and in order), n_lines (lines that aren't
    blank) and n_removed.

    Null texts are empty, so are texts of which all lines go; blank lines stay. Repeated rows are cleaned alike. Null sites
    don't count. An empty table gives an empty result. Columns of docs other than id, text and site are carried along in
    the struct row_ and never clash.
    """
    lines = lines_of(docs, text_col, site_col)
    bad = stored(boilerplate(lines, sites, lg_k), "boilerplate")
    gone = lines.join(bad, ["h1", "h2"], "left_semi").groupBy("row_id", "row_hash").agg(F.collect_set("at").alias("gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("i"), text.alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.join(gone, F.col("i").eqNullSafe(F.col("row_id")) & (F.col("h") == F.col("row_hash")), "left")
    parts = F.split("t", "\n", -1)
    kept = F.filter(parts, lambda x, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    return rows.select(
        "row_",
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.size(F.filter(parts, lambda x: trimmed(x) != "")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))


#: DuckDB's form of op5: exact counts for every line.
SQL = """
WITH rows AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
parts AS (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS part, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM rows),
lines AS (SELECT *, regexp_replace(part, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM parts),
bad AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.line = b.line)
SELECT doc_id,
       count(*) FILTER (line <> '')::INTEGER AS n_lines,
       count(*) FILTER (gone)::INTEGER AS n_removed,
       md5(coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS clean_md5
FROM marked GROUP BY r, doc_id
"""
