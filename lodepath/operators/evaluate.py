"""From per-question results to metrics, percentiles, budgets and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import models as M
from lodepath.functions import text as X
from lodepath.sources.readers import dense_ids


#: What a family summary says of a family.
DECISIONS = {
    "rejected": "rejected: best F1 is below {:.2f}",
    "selected": "selected: effective enough and fastest viable",
    "better": "more effective, but slower",
    "slower": "effective enough, but slower",
}


def covered_questions(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Questions of which both concepts are nodes."""
    n = nodes.select(F.col("node").alias("n_"))
    return questions.join(n, questions.cause == F.col("n_"), "left_semi").join(n, questions.effect == F.col("n_"), "left_semi")


def membership(questions: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Each question with each graph of graph_nodes (graph, node): cause_in_graph, effect_in_graph, covered."""
    graphs = graph_nodes.select("graph").distinct()
    n = graph_nodes.select("graph", F.col("node").alias("n_"), F.lit(True).alias("in_")).distinct()
    rows = questions.crossJoin(F.broadcast(graphs))  # graphs are a handful, stated by the caller
    rows = rows.join(n.toDF("graph", "cause", "cause_in_graph"), ["graph", "cause"], "left").join(n.toDF("graph", "effect", "effect_in_graph"), ["graph", "effect"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("cause_in_graph", "effect_in_graph")})
    return rows.withColumn("covered", F.col("cause_in_graph") & F.col("effect_in_graph"))


def missing_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    return wanted.select("node").distinct().join(nodes.select("node"), "node", "left_anti")


def per_example(questions: DataFrame, results: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """questions (id, cause, effect, answer) with results (id, algorithm, path, visited[, time_sec]) in the per-example form."""
    rows = questions.join(results, "id")
    seconds = F.col("time_sec") if "time_sec" in results.columns else F.lit(None).cast("double")
    cost = F.col("path_cost") if "path_cost" in results.columns else F.lit(None).cast("double")
    pred = F.size("path") > 0
    return rows.select(
        "algorithm", "id", "cause", "effect", F.col("answer").alias("true"), pred.alias("pred"), (F.col("answer") == pred).alias("correct"),
        F.col("visited").cast("int").alias("nodes_visited"), F.size("path").alias("path_length"), seconds.alias("time_sec"), (seconds * 1000).alias("time_ms"), cost.alias("path_cost"),
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, scores and means for each group of keys (null keys are groups too). rows: the per-example form."""
    t, p = F.col("true"), F.col("pred")
    counts = [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]
    means = [
        F.coalesce(F.avg("nodes_visited"), F.lit(0.0)).alias("avg_nodes_visited"),
        F.coalesce(F.avg("time_ms"), F.lit(0.0)).alias("avg_time_ms"),
        F.coalesce(F.avg(F.when(F.col("path_length") > 0, F.col("path_length"))), F.lit(0.0)).alias("avg_path_length"),
        F.avg("path_cost").alias("avg_path_cost"),
        F.avg(F.when(F.col("path_length") > 1, F.col("path_cost") / (F.col("path_length") - 1))).alias("avg_cost_per_hop"),
    ]
    agg = [F.count("*").alias("num_examples"), *counts, *means]
    out = rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1_score": f1(tp, fp, fn)})


def percentile(c: Column, share: float) -> Column:
    """Exact, by linear interpolation; 0 of nothing."""
    return F.coalesce(F.percentile(c, F.lit(share)), F.lit(0.0))


def visited_analysis(rows: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Percentiles and maxima of visits, of all searches and of those that found a path. Counts are aggregated by value first
    (percentile with frequencies), so a group's rows never meet in one task; raw counts stay as rows of `rows`."""
    by_value = rows.groupBy(*keys, "nodes_visited", (F.col("path_length") > 0).alias("ok")).agg(F.count("*").alias("n"))
    ok = F.when(F.col("ok"), F.col("nodes_visited"))
    q = lambda c: F.coalesce(F.call_function("percentile", c, F.lit(share), F.col("n")), F.lit(0.0))
    return by_value.groupBy(*keys).agg(
        F.sum("n").alias("num_examples"),
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("num_successful_paths"),
        q(F.col("nodes_visited")).alias("p95_visited"),
        q(ok).alias("p95_visited_successful_only"),
        F.coalesce(F.max("nodes_visited"), F.lit(0)).alias("max_visited"),
        F.coalesce(F.max(ok), F.lit(0)).alias("max_visited_successful_only"),
    )


def budgets(analyses: DataFrame) -> DataFrame:
    """(model, dimension, strategy, cap): the budget that the 95th percentile of successful searches rounds up to."""
    return analyses.select("model", "dimension", "strategy", X.budget_of(F.col("p95_visited_successful_only")).alias("cap"))


def with_budget(runs: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Each run (model, dimension, strategy) with the cap of the first source that has one; null dimensions match. A run without
    any is an error when its cap is read."""
    listed = None
    for n, s in enumerate(sources):
        one = s.select(F.col("model").alias("m_"), F.col("dimension").alias("d_"), F.col("strategy").alias("s_"), "cap", F.lit(n).alias("n_"))
        listed = one if listed is None else listed.unionByName(one)
    first = listed.groupBy("m_", "d_", "s_").agg(F.min_by("cap", "n_").alias("cap"))
    same = (runs.model == first.m_) & runs.dimension.eqNullSafe(first.d_) & (runs.strategy == first.s_)
    out = runs.join(first, same, "left").drop("m_", "d_", "s_")
    return out.withColumn("cap", F.coalesce("cap", F.raise_error(F.concat(F.lit("no budget for "), "model")).cast("bigint")))


def aligned(reference: DataFrame, comparison: DataFrame) -> DataFrame:
    """(id, true, a, b): predictions of two runs for the examples that both have. Repeated ids and differing truths are errors."""
    from lodepath.sources.writers import require_empty

    for df in (reference, comparison):
        require_empty(df.groupBy("id").count().where("count > 1"), "id is given twice")
    both = reference.select("id", F.col("true").alias("true"), F.col("pred").alias("a")).join(comparison.select("id", F.col("true").alias("t_"), F.col("pred").alias("b")), "id")
    require_empty(both.where("`true` <> t_"), "truths differ")
    return both.drop("t_")


def select_run(runs: DataFrame, contains: list[str], dimension: int | None = None, algorithm: str | None = None) -> DataFrame:
    """The one run that fits a selector (every part in model and path whatever the case); none or several is an error."""
    text = F.lower(F.concat_ws(" ", "model", "model_path"))
    cond = F.lit(True)
    for part in contains:
        cond = cond & F.contains(text, F.lit(part.lower()))
    if dimension is not None:
        cond = cond & F.col("dimension").eqNullSafe(F.lit(dimension))
    if algorithm is not None:
        cond = cond & (F.col("algorithm") == algorithm)
    found = runs.where(cond)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no run' if n == 0 else 'several runs'} for {contains}, {dimension}, {algorithm}")
    return found


def parse_selector(text: str) -> dict[str, list[str]]:
    """key=value,key=value; keys may repeat."""
    out: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, sep, value = part.partition("=")
        if not sep:
            raise ValueError(f"no = in {part}")
        out.setdefault(key.strip(), []).append(value.strip())
    return out


def by_variant(rows: DataFrame, wanted: str | None) -> DataFrame:
    if wanted is None or wanted.strip().lower() in ("", "all", "*"):
        return rows
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "model", "model_path")), F.lit(wanted.strip().lower())))


def candidates(runs: DataFrame) -> DataFrame:
    """Candidates for selection from flat runs (model, model_path, dimension, algorithm and metrics): A* runs that name all three.
    Runs may have a place in their list, which then decides between equals; else the path does."""
    rows = runs.where((F.col("algorithm") == "astar") & F.col("model").isNotNull() & F.col("model_path").isNotNull() & F.col("dimension").isNotNull())
    return rows.select(
        "model", "model_path", "dimension", M.family(F.col("model"), F.col("model_path")).alias("family"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("f1_score", "accuracy")],
        X.time_ms(F.col("avg_time_ms"), F.col("avg_time_sec")).alias("avg_time_ms"), F.coalesce("avg_nodes_visited", F.lit(float("inf"))).alias("avg_nodes_visited"),
        *[c for c in ("place",) if c in runs.columns],
    )


def _fast(*prefix: Column) -> list[Column]:
    return [*prefix, F.col("avg_time_ms"), F.col("avg_nodes_visited"), -F.col("f1_score"), F.col("family"), F.col("dimension")]


def _tie(rows: DataFrame) -> str:
    return "place" if "place" in rows.columns else "model_path"


def ranked(rows: DataFrame, least_f1: float = 0.8) -> DataFrame:
    """Candidates that are good enough, fastest first: rank 1 is selected. No task orders all of them."""
    order = [*_fast(), F.col(_tie(rows))]
    return dense_ids(rows.where(F.col("f1_score") >= least_f1), order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def family_summary(rows: DataFrame, least_f1: float = 0.8) -> DataFrame:
    """For each family: its best, its fastest and its fastest good enough candidate, and why it was selected or not."""
    tie = _tie(rows)
    key = F.struct("avg_time_ms", "avg_nodes_visited", (-F.col("f1_score")).alias("f"), "family", "dimension", tie)
    what = F.struct("model_path", "dimension", "f1_score")
    viable = F.col("f1_score") >= least_f1
    by = rows.groupBy("family").agg(
        F.count("*").alias("num_candidates"),
        F.min_by(what, F.struct((-F.col("f1_score")).alias("f"), (-F.col("accuracy")).alias("a"), "avg_time_ms", tie)).alias("best"),
        F.min_by(what, key).alias("fastest"),
        F.min_by(F.when(viable, what), F.when(viable, key)).alias("fastest_viable"),
    )
    chosen = rows.where(viable).agg(F.min_by(what, key).alias("chosen"))
    decision = (
        F.when(F.col("fastest_viable").isNull(), DECISIONS["rejected"].format(least_f1))
        .when((X.normal_path(F.col("fastest_viable.model_path")) == X.normal_path(F.col("chosen.model_path"))) & (F.col("fastest_viable.dimension") == F.col("chosen.dimension")), DECISIONS["selected"])
        .when(F.col("fastest_viable.f1_score") > F.col("chosen.f1_score"), DECISIONS["better"])
        .otherwise(DECISIONS["slower"])
    )
    return by.crossJoin(chosen).select("family", "num_candidates", "best", "fastest", "fastest_viable", decision.alias("decision"))


def expected_missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a result matrix lacks, has too much, and has twice."""
    e, f = expected.select(*keys).distinct(), found.select(*keys)
    return e.join(f, keys, "left_anti"), f.distinct().join(e, keys, "left_anti"), f.groupBy(*keys).count().where("count > 1")


def budget_matrix_faults(rows: DataFrame, models: DataFrame, caps: list[int]) -> DataFrame:
    """(fault, model, budget) of every rule that a budget table breaks; no rows if it is sound."""
    expected = models.select("model").crossJoin(F.broadcast(models.sparkSession.createDataFrame([(c,) for c in caps], "budget int")))
    lacks, extra, twice = expected_missing(expected, rows, ["model", "budget"])
    score = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)
    bad = rows.where(score("accuracy") | score("f1_score") | score("precision") | score("recall") | (F.col("avg_nodes_visited") < 0) | (F.col("num_positive") + F.col("num_negative") != F.col("num_examples")))
    parts = [("missing", lacks), ("unexpected", extra), ("repeated", twice), ("out of range", bad)]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("fault"), "model", "budget")
        out = one if out is None else out.unionByName(one)
    return out


def check_budgets(caps: list[int], names: list[str]) -> None:
    if sorted(set(caps)) != list(caps) or min(caps, default=1) <= 0:
        raise ValueError("budgets must be positive, ascending and different")
    if len(set(names)) != len(names):
        raise ValueError("names must differ")


def running_best(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that are strictly better (smaller) than every one before, within keys, by order."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min("value").over(before)
    return history.withColumn("previous_best", prev).where(F.col("previous_best").isNull() | (F.col("value") < F.col("previous_best")))


def best_epoch(history: DataFrame, checkpoint_epoch: Column, stopped_epoch: Column, patience: Column) -> DataFrame:
    """(run, epoch, source): the last improving epoch of the history, else the checkpoint's, else where training stopped less
    its patience. history: (run, step, epoch, value); rows without an epoch don't count."""
    last = running_best(history.where("epoch IS NOT NULL"), ["run"], "step").groupBy("run").agg(F.max_by("epoch", "step").alias("h"))
    runs = history.select("run").distinct().join(last, "run", "left")
    source = F.when(F.col("h").isNotNull(), "history").when(checkpoint_epoch.isNotNull(), "checkpoint").when((stopped_epoch - patience).isNotNull(), "early_stopping")
    return runs.select("run", F.coalesce("h", checkpoint_epoch, stopped_epoch - patience).alias("epoch"), source.alias("source"))


def best_trial(trials: DataFrame, values: DataFrame, params: DataFrame, minimize: bool = True) -> DataFrame:
    """(trial_id, value, param, choice): the best completed trial with its parameters, categorical ones decoded."""
    done = trials.where("state = 'COMPLETE'").join(values, "trial_id")
    best = done.orderBy(F.col("value").asc() if minimize else F.col("value").desc(), "trial_id").limit(1).select("trial_id", "value")
    choice = F.coalesce(X.categorical_choice(F.col("choices"), F.col("param_value")), F.col("param_value").cast("string"))
    return best.join(params, "trial_id").select("trial_id", "value", "param", choice.alias("choice"))


def repaired_trials(trials: DataFrame) -> DataFrame:
    """Trials that were left running count as failed."""
    return trials.withColumn("state", F.when(F.col("state") == "RUNNING", "FAIL").otherwise(F.col("state")))


def agrees(a: Column, b: Column, c: Column, relative: float | None = None) -> Column:
    """Three sources say the same, numbers within a relative tolerance."""
    if relative is None:
        return a.eqNullSafe(b) & b.eqNullSafe(c)
    near = lambda x, y: F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y))
    return near(a, b) & near(b, c)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each group of keys: the first by order."""
    cond = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("r_", F.row_number().over(cond)).where("r_ = 1").drop("r_")


def shared_caps(reference: DataFrame, variants: DataFrame) -> DataFrame:
    """Ablation variants under the one reference run's cap; none or several reference rows are an error."""
    n = reference.limit(2).count()
    if n != 1:
        raise ValueError("the reference must have one cap")
    return variants.crossJoin(F.broadcast(reference.select("cap")))


def budget_index(entries: DataFrame) -> DataFrame:
    """(model, dim, cap) of listed analyses (ordinal, model, dimension text, p95): the last entry of a pair counts, and dimensions
    that aren't whole numbers are left out."""
    rows = entries.withColumn("dim", F.col("dimension").try_cast("int")).where("dim IS NOT NULL AND p95 IS NOT NULL")
    return rows.groupBy("model", "dim").agg(X.budget_of(F.max_by("p95", "ordinal")).alias("cap"))


def step_epochs(history: DataFrame, value_tag: str, epoch_tag: str = "epoch") -> DataFrame:
    """(run, step, epoch, value): scalars of one tag with the epoch logged at the same step, null if there is none."""
    values = history.where(F.col("tag") == value_tag).select("run", "step", "value")
    epochs = history.where(F.col("tag") == epoch_tag).groupBy("run", "step").agg(F.max("value").cast("int").alias("epoch"))
    return values.join(epochs, ["run", "step"], "left").select("run", "step", "epoch", "value")


def latest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest file (path, modified) of each group; the greater path among equals."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def metric_of(models: DataFrame, metadata: DataFrame) -> DataFrame:
    """(model, metric): as the metadata (model, distance) says, cosine without metadata; a row without the field is an error."""
    known = metadata.select("model", F.coalesce(M.distance(F.col("distance")), F.raise_error(F.concat(F.lit("no distance for "), "model"))).alias("d_"))
    return models.join(known, "model", "left").select("model", F.coalesce("d_", F.lit("cosine")).alias("metric"))


def universe_of(runs: DataFrame, universes: DataFrame) -> DataFrame:
    """runs (graph, …) with the node universe of their graph; an unknown graph is an error when read."""
    u = F.broadcast(universes.select("graph", F.col("universe").alias("u_")))  # a registry of a few rows
    return runs.join(u, "graph", "left").withColumn("universe", F.coalesce("u_", F.raise_error(F.concat(F.lit("no universe for "), "graph")))).drop("u_")


def per_batch_average(pairs: DataFrame) -> DataFrame:
    """(distinct_avg, batch_avg) of visits: over different pairs, and over batches as a validation that repeats a pair in each of its
    batches counts it. pairs: (batch, source, target, visited)."""
    one = pairs.groupBy("source", "target").agg(F.first("visited").alias("v")).agg(F.avg("v").alias("distinct_avg"))
    two = pairs.dropDuplicates(["batch", "source", "target"]).groupBy("batch").agg(F.avg("visited").alias("v")).agg(F.avg("v").alias("batch_avg"))
    return one.crossJoin(two)
