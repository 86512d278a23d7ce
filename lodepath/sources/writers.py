"""Sinks: tables that are replaced, extended or laid out for readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_empty(df: DataFrame, message: str) -> None:
    """An error that names a row, if df has any."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def save_vectors(old: DataFrame | None, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Overlay new (node, vec) on old: the table for all nodes (node_id, node, vec). Unknown or repeated texts, and nodes that
    neither table has, are errors."""
    require_empty(new.join(nodes, "node", "left_anti"), "text is not a node")
    require_empty(new.groupBy("node").count().where("count > 1"), "text is given twice")
    rows = nodes.join(new.select("node", F.col("vec").alias("new_")), "node", "left")
    if old is not None:
        rows = rows.join(old.select("node", F.col("vec").alias("old_")), "node", "left")
    vec = F.coalesce("new_", "old_") if old is not None else F.col("new_")
    out = rows.select("node_id", "node", vec.alias("vec"))
    require_empty(out.where("vec IS NULL"), "node has no vector")
    return out


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet; null keys (a baseline's dimension) match each other."""
    cond = None
    for k in keys:
        c = wanted[k].eqNullSafe(done[k])
        cond = c if cond is None else cond & c
    return wanted.join(done, cond, "left_anti")


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't there yet are added; the others stay as they are, so a repeated run changes nothing."""
    return existing.unionByName(pending(new, existing, keys))


def replace_rows(existing: DataFrame, new: DataFrame, replaced: Column) -> DataFrame:
    """Drop the rows for which `replaced` holds, then append the new ones."""
    return existing.where(~F.coalesce(replaced, F.lit(False))).unionByName(new)


def write_verified(df: DataFrame, path: str, keys: list[str], tolerance: float = 1e-12, sep: str = ";") -> None:
    """Write df as Parquet at path/table and CSV at path/csv, read both back, and fail unless they agree on every row."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/table")
    table = spark.read.schema(df.schema).parquet(f"{path}/table")
    table.write.mode("overwrite").options(header=True, sep=sep).csv(f"{path}/csv")
    back = spark.read.schema(df.schema).options(header=True, sep=sep).csv(f"{path}/csv")
    a, b = table.alias("a"), back.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    differs = F.lit(False)
    for name, kind in df.dtypes:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        same = (F.abs(x - y) <= tolerance) if kind in ("double", "float") else (x == y)
        differs = differs | ~F.coalesce(same, x.isNull() & y.isNull())
    joined = a.join(b, cond, "full_outer")
    lost = F.lit(False)
    if keys:
        lost = F.col(f"a.{keys[0]}").isNull() != F.col(f"b.{keys[0]}").isNull()
    require_empty(joined.where(differs | lost).select("a.*"), "the files disagree")


def metrics_csv(runs: DataFrame, path: str) -> None:
    """One line for each run and algorithm, with ; between the fields."""
    flat = runs.select("model", "model_path", "dimension", F.explode("evaluation").alias("algorithm", "e")).select("model", "model_path", "dimension", "algorithm", "e.metrics.*")
    flat.write.mode("overwrite").options(header=True, sep=";").csv(path)


def write_ceg(edges: DataFrame, path: str) -> None:
    """The lexical graph's four-field lines."""
    line = F.concat_ws("\t", F.concat("cause", F.lit("->"), "effect"), *[F.col(c).cast("string") for c in ("count", "necessity_score", "sufficiency_score")])
    edges.select(line.alias("value")).write.mode("overwrite").text(path)


def write_by_run(per_example: DataFrame, root: str) -> None:
    """Partitioned by graph, dataset and run, so that a reader of one run opens one folder; only folders with new rows change."""
    per_example.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph", "dataset", "run_suffix").parquet(root)


def long_form(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids, metric, value): one row for each value column."""
    return df.unpivot(ids, values, "metric", "value")


def latex_cell(value: Column, is_number: bool = False, digits: int = 0) -> Column:
    """A cell of a LaTeX table: thousands as {,}, -- for null, special characters escaped."""
    if is_number:
        return F.coalesce(F.replace(F.format_number(value, digits), F.lit(","), F.lit("{,}")), F.lit("--"))
    escaped = F.regexp_replace(value, r"([&%$#_{}])", r"\\$1")
    return F.coalesce(escaped, F.lit("--"))


def write_report(df: DataFrame, path: str, numeric: list[str]) -> None:
    """The same rows as JSON, CSV and LaTeX lines in one folder."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").options(header=True).csv(f"{path}/csv")
    cells = [latex_cell(F.col(c), c in numeric) if c in numeric else latex_cell(F.col(c).cast("string")) for c in df.columns]
    df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("value")).write.mode("overwrite").text(f"{path}/latex")


def signature(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files below a path: a cache made from them is valid while this stays."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
