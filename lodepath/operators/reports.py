"""Coverage, statistics and summary reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import text as X


def label_counts(member: DataFrame, keys: list[str]) -> DataFrame:
    """Positive, negative and covered questions; rows without a label are counted apart. member: membership() rows or questions."""
    aggs = [F.count_if(F.col("answer")).alias("positive"), F.count_if(~F.col("answer")).alias("negative"), F.count_if(F.col("answer").isNull()).alias("invalid")]
    if "covered" in member.columns:
        aggs += [F.count_if(F.col("covered") & F.col("answer")).alias("covered_positive"), F.count_if(F.col("covered") & ~F.col("answer")).alias("covered_negative")]
    return member.groupBy(*keys).agg(*aggs)


def counts_by_graph(member: DataFrame, graphs: list[str]) -> DataFrame:
    """One row for each dataset: covered positives and negatives in a column for each graph."""
    rows = member.groupBy("dataset").pivot("graph", graphs).agg(F.count_if(F.col("covered") & F.col("answer")).alias("positive"), F.count_if(F.col("covered") & ~F.col("answer")).alias("negative"))
    return rows.na.fill(0)


def path_length_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Average and greatest hops of reached pairs, overall and by label, and how many hit the cap. rows: (answer, path, visited, cap)."""
    hops = F.when(F.size("path") > 0, X.hops(F.col("path")))
    cut = (F.col("cap") != -1) & (F.size("path") == 0) & (F.col("visited") > F.col("cap"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count(hops).alias("reached"), F.avg(hops).alias("avg_hops"), F.avg(F.when(F.col("answer"), hops)).alias("avg_hops_positive"),
        F.avg(F.when(~F.col("answer"), hops)).alias("avg_hops_negative"), F.max(hops).alias("max_hops"), F.count_if(cut).alias("cut_off"),
    )


def token_rows(nodes: DataFrame, vocab: DataFrame, lower: bool = True) -> DataFrame:
    """(node, token, known): each token of each node, and whether the vocabulary has it. A large vocabulary is joined, not sent."""
    each = nodes.select("node", F.explode_outer(X.tokens(F.col("node"), lower)).alias("token"))
    v = vocab.select(F.col("word").alias("token"), F.lit(True).alias("in_")).distinct()
    return each.join(v, "token", "left").select("node", "token", F.coalesce("in_", F.lit(False)).alias("known"))


def node_coverage(nodes: DataFrame, vocab: DataFrame, lower: bool = True) -> DataFrame:
    """(node, n_tokens, n_known, exact, coverage): all, partial or none; exact if the whole text is one word of the vocabulary."""
    by = token_rows(nodes, vocab, lower).groupBy("node").agg(F.count("token").alias("n_tokens"), F.count_if(F.col("known")).alias("n_known"))
    v = vocab.select("word", F.lit(True).alias("in_")).distinct()
    text = F.lower("node") if lower else F.col("node")
    out = by.join(v, text == F.col("word"), "left")
    kind = F.when((F.col("n_tokens") > 0) & (F.col("n_known") == F.col("n_tokens")), "all").when(F.col("n_known") > 0, "partial").otherwise("none")
    return out.select("node", "n_tokens", "n_known", F.coalesce("in_", F.lit(False)).alias("exact"), kind.alias("coverage"))


def coverage_summary(nodes: DataFrame, vocab: DataFrame, lower: bool = True) -> DataFrame:
    """One row: nodes by coverage, percentages, and how many different tokens are missing."""
    c = node_coverage(nodes, vocab, lower).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("exact")).alias("exact"), F.count_if(F.col("n_known") > 0).alias("any_known"),
        *[F.count_if(F.col("coverage") == k).alias(k + "_known") for k in ("all", "partial", "none")],
    )
    gone = token_rows(nodes, vocab, lower).where("NOT known AND token IS NOT NULL").agg(F.countDistinct("token").alias("missing_tokens"))
    return c.crossJoin(gone).withColumn("all_percent", X.percent(F.col("all_known"), F.col("nodes"), 2))


def endpoint_rows(questions: DataFrame) -> DataFrame:
    """(dataset, id, role, node): each question's two concepts as rows."""
    roles = F.array(F.struct(F.lit("cause").alias("role"), F.col("cause").alias("node")), F.struct(F.lit("effect").alias("role"), F.col("effect").alias("node")))
    return questions.select("dataset", "id", F.explode(roles).alias("r")).select("dataset", "id", "r.role", "r.node")


def endpoint_coverage(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """By dataset: endpoint occurrences and different endpoints, and those that the vocabulary covers wholly."""
    rows = endpoint_rows(questions)
    known = node_coverage(rows.select("node").distinct(), vocab)
    ok = F.col("coverage") == "all"
    return rows.join(known, "node").groupBy("dataset").agg(
        F.count("*").alias("occurrences"), F.count_if(ok).alias("covered_occurrences"), F.countDistinct("node").alias("endpoints"), F.countDistinct(F.when(ok, F.col("node"))).alias("covered_endpoints")
    )


def missing_endpoints(questions: DataFrame, vocab: DataFrame, examples: int = 5) -> DataFrame:
    """(dataset, node, roles, occurrences, example_ids, missing): endpoints that aren't covered. Ids are a few examples, by name."""
    rows = endpoint_rows(questions)
    lost = token_rows(rows.select("node").distinct(), vocab).where("NOT known").groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("missing"))
    first = Window.partitionBy("dataset", "node").orderBy("id", "role")
    rows = rows.join(lost, "node").withColumn("n_", F.row_number().over(first))
    return rows.groupBy("dataset", "node").agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set(F.when(F.col("n_") <= examples, F.col("id")))).alias("example_ids"), F.first("missing").alias("missing"),
    )


def membership_summary(member: DataFrame) -> DataFrame:
    """(graph, dataset, reason, questions, percent): why questions are skipped."""
    reason = F.when(F.col("covered"), "covered").when(~F.col("cause_in_graph") & ~F.col("effect_in_graph"), "both missing").when(~F.col("cause_in_graph"), "cause missing").otherwise("effect missing")
    by = member.groupBy("graph", "dataset", reason.alias("reason")).agg(F.count("*").alias("questions"))
    total = F.sum("questions").over(Window.partitionBy("graph", "dataset"))
    return by.withColumn("percent", X.percent(F.col("questions"), total, 2))


def family_rollup(rows: DataFrame, family: str, member: str, item: str) -> DataFrame:
    """Occurrences and different items by family, by member and in all. Items of a family are counted once, however many of its
    members have them."""
    return rows.rollup(family, member).agg(F.count(item).alias("occurrences"), F.countDistinct(item).alias("items"), F.grouping_id().alias("level"))


def cap_pivot(caps: DataFrame, dims: list[int]) -> DataFrame:
    """Caps by model (rows) and dimension (columns d<dim>)."""
    out = caps.groupBy("model").pivot("dimension", dims).agg(F.max("cap"))
    return out.select("model", *[F.col(f"`{d}`").alias(f"d{d}") for d in dims])


def histogram(rows: DataFrame, column: str, bins: int = 30, log: bool = True) -> DataFrame:
    """(bin, low, high, n): equal bins of the values, or of their logarithms; rows that are null (or not positive) don't count. All
    equal: 10 bins around the value. The last bin holds its upper end."""
    v = F.col(column).cast("double")
    good = rows.where((v > 0) if log else v.isNotNull()).select((F.log10(v) if log else v).alias("x"))
    ends = good.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = F.when(F.col("lo") == F.col("hi"), 10).otherwise(bins)
    ends = ends.select(n.alias("n_bins"), F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n_bins")), F.col("n_bins") - 1)
    edge = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / F.col("n_bins")
    back = (lambda e: F.pow(F.lit(10.0), e)) if log else (lambda e: e)
    by = good.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "lo", "hi", "n_bins").agg(F.count("*").alias("n"))
    return by.select("bin", back(edge(F.col("bin"))).alias("low"), back(edge(F.col("bin") + 1)).alias("high"), "n")


def quantile_bands(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    q = rows.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return q.select(*keys, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))


def bands(values: DataFrame, most: int = 3) -> DataFrame:
    """(value, band): values parted at their most - 1 largest gaps. For axes: a handful of values."""
    order = Window.orderBy("value")
    g = values.select("value").distinct().withColumn("gap", F.col("value") - F.lag("value").over(order))
    g = g.withColumn("r", F.row_number().over(Window.orderBy(F.desc_nulls_last("gap"), "value")))
    cut = F.when(F.col("gap").isNotNull() & (F.col("r") < most), 1).otherwise(0)
    return g.select("value", F.sum(cut).over(order).alias("band"))


def medians(samples: DataFrame, keys: list[str], column: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.median(column).alias("median"), F.avg(column).alias("mean"))


def ordered(rows: DataFrame, order: DataFrame, key: str, then: list[str | Column]) -> DataFrame:
    """Rows in the order of a small table (key, ordinal); those it doesn't list go last."""
    o = order.select(F.col(key).alias("k_"), "ordinal")
    return rows.join(F.broadcast(o), rows[key] == F.col("k_"), "left").orderBy(F.col("ordinal").asc_nulls_last(), *then).drop("k_", "ordinal")


def selected_systems(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the systems listed (system, ordinal) with that order, and the listed ones without a row."""
    return rows.join(F.broadcast(wanted), "system"), wanted.join(rows.select("system").distinct(), "system", "left_anti")


def preload_status(graphs: DataFrame) -> DataFrame:
    """(universe, graphs): graphs that share a node universe, in order. graphs: (graph, universe, ordinal)."""
    return graphs.groupBy("universe").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "graph"))), lambda x: x["graph"]).alias("graphs"))
