"""Typed readers for graph, question, embedding and result files. No schema is ever inferred.

Paths are read by Spark alone, compressed ones (bz2, gz) included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.functions import text as X
from lodepath.plans.session import stored
from lodepath.sources.vector_files import read_vectors

RELATION = (
    "causal_relation struct<cause:struct<concept:string>,effect:struct<concept:string>>, support bigint, "
    "sources array<struct<type:string,payload:struct<sentence:string,list_toc_section_heading:string,infobox_argument:string>>>"
)
MSMARCO = "`id` string, question string, `answer:Extracted` array<string>, query array<array<int>>, `question:POS` array<array<string>>"
SEMEVAL = "id string, cause string, effect string, causal string"
PER_EXAMPLE = "id string, cause string, effect string, `true` boolean, pred boolean, correct boolean, nodes_visited int, path_length int, time_sec double, time_ms double, path_cost double"
METRICS = (
    "num_examples int, tp int, fp int, fn int, tn int, accuracy double, f1_score double, recall double, precision double, avg_nodes_visited double, avg_time_ms double, "
    "avg_time_sec double, avg_path_length double, avg_path_cost double, avg_cost_per_hop double"
)
RUN = f"model string, model_path string, dimension int, evaluation map<string, struct<metrics:struct<{', '.join(x.replace(' ', ':', 1) for x in METRICS.split(', '))}>, per_example:array<struct<id:string,`true`:boolean,pred:boolean>>>>"
BUDGET_ROW = (
    "model string, dimension int, distance string, budget int, num_examples int, accuracy double, f1_score double, precision double, recall double, avg_nodes_visited double, "
    "avg_time_ms double, num_positive int, num_negative int"
)


def graph_format(path: str, given: str | None = None) -> str:
    """causenet or lexical_ceg: as given, else by the file's ending."""
    if given is not None:
        if given not in ("causenet", "lexical_ceg"):
            raise ValueError(f"unknown graph format {given}")
        return given
    bare = path.removesuffix(".bz2")
    if bare.endswith(".jsonl"):
        return "causenet"
    if bare.endswith(".txt"):
        return "lexical_ceg"
    raise ValueError(f"no graph format for {path}")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(edge_seq, value): lines numbered in file order; paths in the order given, a folder's files by name. Numbers ascend but
    have gaps: the file's place, then where the line's split begins (16 numbers for each byte), then the line's place.

    Spark deals splits to tasks by size, not by name, so a task's number alone would not follow the files. The list of files
    is the one that Spark's own scan holds; up to 65,536 files of up to 8 TB."""
    given = [paths] if isinstance(paths, str) else paths
    files = [f for p in given for f in sorted(spark.read.text(p).inputFiles())]
    if len(files) > 1 << 16:
        raise ValueError(f"{len(files)} files are too many to number; compact them first")
    meta, line = F.col("_metadata"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.text(list(dict.fromkeys(given))).select("value", F.input_file_name().alias("f_"), (meta["file_block_start"] * 16 + line).alias("at_"))
    if len(files) <= 1:
        return rows.select(F.col("at_").alias("edge_seq"), "value")
    place = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "f_ string, n_ long")
    return rows.join(F.broadcast(place), "f_").select((F.col("n_") * (1 << 47) + F.col("at_")).alias("edge_seq"), "value")


def causenet_edges(spark: SparkSession, path: str | list[str], self_loops: bool = False, valid_only: bool = True) -> DataFrame:
    """edge_seq, cause, effect, support, sentence, graph_source. Blank lines are skipped; a line that isn't JSON is an error."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.select("edge_seq", F.from_json("value", RELATION, {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.select(
        "edge_seq",
        X.concept(F.col("d.causal_relation.cause.concept")).alias("cause"),
        X.concept(F.col("d.causal_relation.effect.concept")).alias("effect"),
        F.coalesce("d.support", F.lit(0)).alias("support"),
        F.col("d.sources").alias("sources"),
    )
    rows = _filtered(rows, self_loops, valid_only)
    return rows.withColumn("sentence", X.source_sentence(F.col("sources"), F.col("cause"), F.col("effect"))).withColumn("graph_source", F.lit("causenet")).drop("sources")


def ceg_edges(spark: SparkSession, path: str | list[str], self_loops: bool = False, valid_only: bool = True, normalize: bool = True, numbers: bool = True) -> DataFrame:
    """The lexical graph's lines: cause->effect, count, necessity, sufficiency. Lines with fewer than four fields, without an arrow
    or (numbers) with other than numbers are skipped. normalize and valid_only turn the loader's rules for concepts off."""
    f = F.split("value", "\t")
    lines = numbered_lines(spark, path).where((F.size(f) >= 4) & F.contains(f[0], F.lit("->")))
    pair = F.split(f[0], "->", 2)
    tidy = (lambda c: X.concept(c, lower=True)) if normalize else X.strip
    rows = lines.select(
        "edge_seq",
        tidy(pair[0]).alias("cause"),
        tidy(pair[1]).alias("effect"),
        X.strip(f[1]).try_cast("bigint").alias("count"),
        X.strip(f[2]).try_cast("double").alias("necessity_score"),
        X.strip(f[3]).try_cast("double").alias("sufficiency_score"),
    )
    if numbers:
        rows = rows.where("count IS NOT NULL AND necessity_score IS NOT NULL AND sufficiency_score IS NOT NULL")
    rows = _filtered(rows, self_loops, valid_only)
    return rows.select(
        "edge_seq", "cause", "effect", F.col("count").alias("support"), F.concat_ws(" can cause ", "cause", "effect").alias("sentence"), F.lit("lexical_ceg").alias("graph_source"),
        "count", "necessity_score", "sufficiency_score", X.causality_score(F.col("necessity_score"), F.col("sufficiency_score")).alias("causality_score"),
    )


def _filtered(rows: DataFrame, self_loops: bool, valid_only: bool) -> DataFrame:
    ok = X.is_valid_node if valid_only else (lambda c: F.coalesce(F.length(c) > 0, F.lit(False)))
    rows = rows.where(ok(F.col("cause")) & ok(F.col("effect")))
    return rows if self_loops else rows.where("cause <> effect")


def graph_edges(spark: SparkSession, path: str, fmt: str | None = None, self_loops: bool = False) -> DataFrame:
    return (causenet_edges if graph_format(path, fmt) == "causenet" else ceg_edges)(spark, path, self_loops)


def msmarco_questions(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Questions of a JSON list: id, question, cause, effect, answer. Rows without a label or a concept are skipped."""
    raw = spark.read.schema(MSMARCO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    pos, row = F.col("`question:POS`"), F.monotonically_increasing_id()
    span = lambda k: X.span_text(pos, F.col("query")[k][0], F.col("query")[k][1])
    out = raw.where(F.size("query") >= 2).select(
        X.record_id(dataset, F.col("id"), row).alias("id"),
        X.question_text(F.col("question"), pos).alias("question"),
        X.question_concept(span(0)).alias("cause"),
        X.question_concept(span(1)).alias("effect"),
        X.msmarco_label(F.col("`answer:Extracted`"), dataset in X.EVAL_SPLITS).alias("answer"),
    )
    return out.where("answer IS NOT NULL AND cause <> '' AND effect <> ''")


def semeval_questions(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    raw = spark.read.schema(SEMEVAL).option("header", True).csv(path)
    rows = raw.select(
        X.record_id(dataset, F.col("id"), F.monotonically_increasing_id()).alias("id"),
        X.question_concept(F.col("cause")).alias("cause"),
        X.question_concept(F.col("effect")).alias("effect"),
        X.semeval_label(F.col("causal")).alias("answer"),
    ).where("answer IS NOT NULL AND cause <> '' AND effect <> ''")
    return rows.select("id", F.concat(F.lit("can "), "cause", F.lit(" cause "), "effect", F.lit("?")).alias("question"), "cause", "effect", "answer")


def normal_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, question string, cause string, effect string, answer boolean").option("multiLine", True).json(path)


def node_universe(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, node): one JSON string a line; ids are places in the file, without gaps."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    text = F.from_json(F.concat(F.lit('{"s":'), "value", F.lit("}")), "s string")["s"]
    return dense_ids(rows.select("edge_seq", text.alias("node")), "edge_seq", "node_id").select("node_id", "node")


def dense_ids(rows: DataFrame, order: str | list[Column], out: str) -> DataFrame:
    """Number rows 0, 1, ... in an order, in two steps, so no single task orders all rows: ranks within ranges, then offsets.

    The dealt rows are stored: a second run of the plan, as adaptive execution joins small partitions, gives other ranges."""
    order = [F.col(order)] if isinstance(order, str) else order
    parts = stored(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "dealt")
    parts = parts.withColumn("in_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_"))
    return parts.join(base, "part_").withColumn(out, (F.col("base_") + F.col("in_") - 1).cast("long")).drop("part_", "in_", "base_")


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, vec) of a matrix in a .npy file of any size, read by ranges of bytes."""
    return read_vectors(spark, path)


def embedding_status(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: counts of both tables, dimensions, and the reason why the vectors don't fit the nodes (null if they do)."""
    v = vectors.agg(F.count("*").alias("vectors"), F.min(F.size("vec")).alias("least_dim"), F.max(F.size("vec")).alias("most_dim"))
    n = nodes.agg(F.count("*").alias("nodes"))
    reason = F.when(F.col("vectors") == 0, "missing").when(F.col("vectors") != F.col("nodes"), "row count differs").when(F.col("least_dim") != F.col("most_dim"), "mixed dimensions")
    return v.crossJoin(n).withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def glove(spark: SparkSession, path: str, dim: int = 300) -> DataFrame:
    """(word, vec): white space parts; the last dim are numbers, the first is the word."""
    parts = F.split(X.strip(F.col("value")), X.SPACE + "+")
    rows = spark.read.text(path).where(F.size(parts) == dim + 1)
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("float")).alias("vec")).where(~F.exists("vec", lambda x: x.isNull()))


def glove_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.substring_index("value", " ", 1).alias("word")).where("word <> ''").distinct()


def runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """Result files; where there are none, no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else schema)


def result_sets(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Per-example tables below graph=/dataset=/run_suffix= folders: partition columns come from the paths and prune reads."""
    return spark.read.schema(f"{schema}, graph string, dataset string, run_suffix string").parquet(root)


def budget_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUDGET_ROW).option("header", True).option("sep", ";").csv(path)


def flat_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, value) of a file of key: value lines; comments and lines without a colon are skipped."""
    rows = spark.read.text(path).where(F.contains("value", F.lit(":")) & ~F.startswith(F.ltrim("value"), F.lit("#")))
    t = X.typed_scalar(F.regexp_replace("value", "^[^:]*:", ""))
    return rows.select(X.strip(F.substring_index("value", ":", 1)).alias("key"), t["kind"].alias("kind"), t["value"].alias("value"))
