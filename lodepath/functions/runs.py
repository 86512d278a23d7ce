"""Where runs, models and caches lie, what they are called, and what their settings must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.functions import models as M

#: The setting that caps each algorithm's visits, by the name that a run states.
CAP_SETTING = {"BFS": "bfs_max_visits", "RL": "rl_max_visits", "Dijkstra": "dijkstra_max_visits", "A*": "astar_max_visits"}
#: The compared activations and distances, the reference first, in the order of tables and plots.
ABLATION = (("relu", "euclid"), ("relu", "cosine"), ("gelu", "euclid"), ("gelu", "cosine"))
#: Short labels of models in tables.
COMPACT = {"Qwen3-Embedding-0.6B": "Qwen", "all-mpnet-base-v2": "MPNet", "bge-large-en-v1.5": "BGE", "granite-embedding-english-r2": "Granite Emb.", "mxbai-embed-large-v1": "MXBAI Emb."}
#: Fields of an aggregated budget row and the metrics that they rename.
BUDGET_FIELDS = {
    "evaluated_examples": "num_examples", "true_positives": "tp", "false_positives": "fp", "true_negatives": "tn", "false_negatives": "fn",
    "precision": "precision", "recall": "recall", "f1": "f1_score", "accuracy": "accuracy", "average_visited_nodes": "avg_nodes_visited", "average_runtime_ms": "avg_time_ms",
}
#: The batch that gradients are accumulated to; batches must divide it.
EFFECTIVE_BATCH = 128


def required(value: Column, message: Column) -> Column:
    """value, or an error where it is null."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message))


def used_cap(algorithm: Column, settings: Column) -> Column:
    """The cap that a run's settings (a map) give its algorithm; null for an algorithm without one."""
    return F.try_element_at(settings, F.element_at(F.create_map(*[F.lit(x) for p in CAP_SETTING.items() for x in p]), algorithm))


def public_settings(settings: Column) -> Column:
    """Settings without those that are private to a process (names with a leading underscore); null is none."""
    return F.coalesce(F.map_filter(settings, lambda k, _: ~F.startswith(k, F.lit("_"))), F.create_map().cast("map<string,string>"))


def dataset_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(M.short_name(path), r"(?<=.)\.[^.]*$", ""), F.lit("_filtered"), F.lit(""))


def run_folder(root: str, graph: Column, dataset: Column, suffix: Column, ablation: bool = False) -> Column:
    return F.concat_ws("/", F.lit(f"{root}/ablation" if ablation else root), graph, dataset, suffix)


def run_files(root: str, graph: Column, dataset_path: Column, suffix: Column, ablation: bool = False) -> Column:
    """The folder of a run and its files: dataset, folder, json, csv, analysis."""
    folder = run_folder(root, graph, dataset_name(dataset_path), suffix, ablation)
    at = lambda name: F.concat(folder, F.lit("/" + name))
    return F.struct(
        dataset_name(dataset_path).alias("dataset"), folder.alias("folder"), at("evaluation_results.json").alias("json"),
        at("evaluation_results.csv").alias("csv"), at("visited_nodes_analysis.json").alias("analysis"),
    )


def first_existing(wanted: DataFrame, listing: DataFrame, places: str = "places", out: str = "place") -> DataFrame:
    """wanted with the first of its places (an array) that the listing (path) holds, and whether there is one; else its first place.

    Serves canonical names with aliases, several spellings of a dataset's file, and recorded files before found ones. Rows of wanted
    may repeat; each has one result. Without places there is none.
    """
    lists = wanted.select(F.col(places).alias("l_")).distinct()
    tried = lists.select("l_", F.posexplode("l_").alias("i_", "path_"))
    found = tried.join(listing.select(F.col("path").alias("path_")).distinct(), "path_", "left_semi").groupBy("l_").agg(F.min_by("path_", "i_").alias("path_"))
    met = wanted.join(found, F.col(places) == F.col("l_"), "left")
    return met.withColumn("exists", F.col("path_").isNotNull()).withColumn(out, F.coalesce("path_", F.try_element_at(F.col(places), F.lit(1)))).drop("l_", "path_")


def alias_folders(graph: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a graph, then its aliases in the order stated (alias -> name)."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in aliases.items() for x in p]), graph), graph)
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in aliases.items()])
    return F.concat(F.array(name), F.transform(F.filter(known, lambda x: x["n"] == name), lambda x: x["a"]))


def run_label(algorithm: Column, model: Column, dimension: Column) -> Column:
    size = F.coalesce(F.concat(F.lit("dim "), dimension.cast("string")), F.lit("baseline"))
    return F.concat_ws(" | ", F.coalesce(algorithm, F.lit("None")), F.coalesce(model, F.lit("None")), size)


def run_listing(runs: DataFrame, order: list[str]) -> DataFrame:
    """One line for each run (algorithm, model, dimension, f1_score), numbered by order: a list for a reader, hence of few rows."""
    score = F.when(F.col("f1_score").isNull(), F.lit("n/a")).otherwise(F.format_string("%.6f", F.col("f1_score").cast("double")))
    label = run_label(F.col("algorithm"), F.col("model"), F.col("dimension"))
    n = F.row_number().over(Window.orderBy(*order))
    return runs.select(n.alias("number"), F.concat(F.format_string("%02d. ", n), label, F.lit(" | F1="), score).alias("line"))


def budget_rows(metrics: DataFrame) -> DataFrame:
    """Metrics of a model at a budget under the thirteen names of an aggregated row."""
    return metrics.select("model", "budget", *[F.col(c).alias(n) for n, c in BUDGET_FIELDS.items()])


def budget_document(rows: DataFrame, configurations: DataFrame, **head: str) -> DataFrame:
    """One JSON document (document) of aggregated rows by model and budget, the configurations by model, and what the run states in
    head. Rows are models times budgets; results by example are tables of their own."""
    aggregated = rows.agg(F.array_sort(F.collect_list(F.struct("model", "budget", *[c for c in rows.columns if c not in ("model", "budget")]))).alias("aggregated_results"))
    models = configurations.agg(F.array_sort(F.collect_list(F.struct("model", *[c for c in configurations.columns if c != "model"]))).alias("model_configurations"))
    budgets = F.array_sort(F.array_distinct(F.col("aggregated_results.budget"))).alias("selected_budgets")
    stated = [F.lit(v).alias(k) for k, v in head.items()]
    body = F.to_json(F.struct(*stated, budgets, F.col("model_configurations"), F.col("aggregated_results")))
    return aggregated.crossJoin(models).select(body.alias("document"))


def checkpoint_faults(configurations: DataFrame, listing: DataFrame, metadata: DataFrame) -> DataFrame:
    """What keeps a run from starting, by model: (model, fault). configurations: (model, checkpoint, activation, distance);
    listing: (path); metadata: (checkpoint, activation, distance) as training wrote it."""
    files = listing.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("checkpoint"), F.rlike("path", F.lit(r"\.(safetensors|bin)$")).alias("w"), F.endswith("path", F.lit("/training_metadata.json")).alias("m"))
    files = files.groupBy("checkpoint").agg(F.max("w").alias("w"), F.max("m").alias("m"))
    told = metadata.select("checkpoint", F.lower("activation").alias("a_"), F.lower("distance").alias("d_")).dropDuplicates(["checkpoint"])
    told = told.withColumn("d_", F.when(F.col("d_") == "euclid", "euclidean").otherwise(F.col("d_")))
    met = configurations.join(files, "checkpoint", "left").join(told, "checkpoint", "left")
    unlike = ~(F.lower("activation").eqNullSafe(F.col("a_")) & F.lower("distance").eqNullSafe(F.col("d_")))
    fault = F.when(F.col("w").isNull(), "no checkpoint").when(~F.col("w"), "no weights").when(~F.col("m"), "no metadata").when(unlike, "other settings")
    return met.select("model", fault.alias("fault")).where("fault IS NOT NULL")


def evaluation_command(python: Column, module: str, dataset: Column, graph: Column, suffix: Column, device: Column, batch: Column, force: Column, skip_dijkstra: Column) -> Column:
    """The command line of one evaluation, as an array."""
    fixed = [python, F.lit("-m"), F.lit(module), dataset, F.lit("--run-suffix"), suffix, F.lit("--graph"), graph, F.lit("--embedding-device"), device, F.lit("--embedding-batch-size"), batch.cast("string")]
    none = F.array().cast("array<string>")
    forced = F.when(force, F.array(F.lit("--force-baselines"), F.lit("--force-model-results"))).otherwise(none)
    return F.concat(F.array(*fixed), forced, F.when(skip_dijkstra, F.array(F.lit("--skip-dijkstra"))).otherwise(none))


def tested_model(selected: DataFrame | None, runs: DataFrame, models_root: str, **base: str) -> DataFrame:
    """The model that each run (suffix, model_path, dimension) tests: the selected one (one row, of evaluate.ranked) if there is a
    selection, else the run's own, else the reference of its suffix."""
    given = F.coalesce("model_path", F.concat(F.lit(models_root + "/"), trained_name(F.col("suffix"), **base)))
    if selected is None:
        return runs.withColumn("model_path", given)
    best = selected.where("rank = 1").select(F.col("model_path").alias("model_path"), F.col("dimension").alias("dimension"))
    return runs.drop("model_path", "dimension").crossJoin(best)


def trained_name(suffix: Column, base: str, normalize: str, layers: str, activation: str = ABLATION[0][0], distance: str = ABLATION[0][1], ablation: bool = False) -> Column:
    end = F.concat(suffix, F.lit("_ablation")) if ablation else suffix
    return F.concat_ws("_", F.lit(base), F.lit(activation), F.lit(distance), F.lit(normalize), F.lit(layers), end, F.lit("finetuned"))


def ablation_names(suffixes: DataFrame, base: str, normalize: str, layers: str) -> DataFrame:
    """(suffix, ordinal, model) of the compared models; ordinal 0 is the reference."""
    names = F.array(*[trained_name(F.col("suffix"), base, normalize, layers, a, d, ablation=i > 0) for i, (a, d) in enumerate(ABLATION)])
    return suffixes.select("suffix", F.posexplode(names).alias("ordinal", "model"))


def trained_models(folders: DataFrame, suffix: str) -> DataFrame:
    """Folders (path) of models that this run trained."""
    return folders.where(F.endswith(F.col("path"), F.lit(f"_{suffix}_finetuned")) & (M.short_name(F.col("path")) != "old"))


def preload_texts(nodes: DataFrame, valid: Column, questions: DataFrame, stop: str = "stop", stop_entity: str = "stop stop action") -> DataFrame:
    """Distinct texts to embed before a timed run: (kind, text) of valid nodes (node) and the stop entity, of questions (cause, effect,
    question) whose ends are nodes, with a default text, and of the stop relation."""
    say = F.coalesce("question", F.concat(F.lit("can "), "cause", F.lit(" cause "), "effect", F.lit("?")))
    known = nodes.select("node").distinct()
    both = questions.join(known.withColumnRenamed("node", "cause"), "cause", "left_semi").join(known.withColumnRenamed("node", "effect"), "effect", "left_semi")
    one = nodes.sparkSession.range(1)
    parts = [
        nodes.where(valid).select(F.lit("entity").alias("kind"), F.col("node").alias("text")), one.select(F.lit("entity").alias("kind"), F.lit(stop_entity).alias("text")),
        both.select(F.lit("question").alias("kind"), say.alias("text")), one.select(F.lit("relation").alias("kind"), F.lit(stop).alias("text")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.distinct()


def example_id(given: Column, index: Column) -> Column:
    """The id as text; a missing or empty one is the row's index."""
    text = given.cast("string")
    return F.when(text != "", text).otherwise(index.cast("string"))


def of_family(path: Column, wanted: str) -> Column:
    if wanted not in ("finetuned", "base", "all"):
        raise ValueError(f"no family {wanted}")
    return F.lit(True) if wanted == "all" else (M.variant(path) == "base") == F.lit(wanted == "base")


def compact_label(path: Column) -> Column:
    name = M.base_name(path)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in COMPACT.items() for x in p]), name), name)


def checkpoint_evidence(files: DataFrame, metadata: DataFrame, epoch) -> DataFrame:
    """For each run of metadata (run, best): its best and its last checkpoint. files: (run, file, modified); epoch(column) reads an
    epoch from a file's name or gives null. The recorded file is best if it is there, else the first by name that tells an epoch;
    the last is last.ckpt, else the newest, ties by name."""
    ckpt = files.where(F.endswith("file", F.lit(".ckpt")))
    seen = metadata.select("run", M.short_name(F.col("best")).alias("b_"), "best").join(ckpt, "run", "left")
    named = F.col("file").eqNullSafe(F.col("b_")) & F.col("file").isNotNull()
    told = F.when(named | epoch(F.col("file")).isNotNull(), F.struct((~named).alias("n"), F.col("file")))
    final = F.struct((F.col("file") == "last.ckpt").alias("l"), "modified", "file")
    return seen.groupBy("run").agg(F.min(told)["file"].alias("best_file"), F.max(F.when(F.col("file").isNotNull(), final))["file"].alias("last_file"), F.first(epoch(F.col("b_"))).alias("recorded_epoch"), F.count("file").alias("n_files"))


def study_file(models: DataFrame, studies: DataFrame) -> DataFrame:
    """models (model, study) with the study's file of studies (name): the recorded one, else the only one that starts with the model's
    name and an underscore, else null."""
    own = models.join(studies.select(F.col("name").alias("study"), F.lit(True).alias("there_")).distinct(), "study", "left")
    parts = F.split("name", "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    begun = studies.distinct().where(F.contains("name", F.lit("_"))).select("name", F.explode(starts).alias("m_"))
    like = models.select("model", M.short_name(F.col("model")).alias("m_")).join(begun, "m_")
    only = like.groupBy("model").agg(F.countDistinct("name").alias("k_"), F.min("name").alias("o_")).where("k_ = 1")
    return own.join(only, "model", "left").select("model", F.when(F.col("there_"), F.col("study")).otherwise(F.col("o_")).alias("study"))


def flag(text: Column) -> Column:
    """A yes or no as people write it; anything else is an error."""
    low = F.lower(F.trim(text))
    said = F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)
    return F.when(text.isNotNull(), required(said, F.concat(F.lit("not a yes or no: "), text)))


def training_fault(batch: Column, epochs: Column, patience: Column, effective: int = EFFECTIVE_BATCH) -> Column:
    """Why training can't start with these, or null."""
    return (
        F.when(batch <= 0, "batch is not positive").when(batch > effective, "batch is too large").when(F.lit(effective) % batch != 0, "batch does not divide")
        .when(epochs <= 0, "epochs are not positive").when(patience < 0, "patience is negative")
    )


def algorithm_key(text: Column) -> Column:
    """The key of an algorithm by one of its spellings; an unknown one is an error."""
    low = F.lower(F.trim(text))
    key = F.when(low.isin("a*", "a-star", "astar"), "astar").when(low.isin("bfs", "rl"), low)
    return required(key, F.concat(F.lit("no algorithm "), F.coalesce(text, F.lit("null"))))


def graph_options(graphs: DataFrame, enabled: list[str]) -> DataFrame:
    """Graphs (id, label, nodes, edges, algorithms) as choices: sizes in words, and the algorithms that are enabled, in order."""
    size = F.concat(F.format_number("nodes", 0), F.lit(" nodes · "), F.format_number("edges", 0), F.lit(" edges"))
    return graphs.withColumn("size_label", size).withColumn("algorithms", F.filter("algorithms", lambda a: a.isin(*enabled)))


def model_dimension(recorded_path: Column, path: Column, hidden_size: Column, hints: dict[str, int]) -> Column:
    """A model's dimension: by the path that training recorded, by its own path, or by its configuration (0 is unknown)."""
    known = F.create_map(*[F.lit(x) for p in hints.items() for x in p])
    return F.coalesce(F.try_element_at(known, recorded_path), F.try_element_at(known, path), F.when(hidden_size != 0, hidden_size))


def vector_cache(root: str, checkpoint: Column, dim: Column, full: Column) -> Column:
    """The vectors' file of a model: a slice's own below the full dimension; a larger dimension or an unknown model is an error."""
    stem = F.concat(F.lit(root + "/"), M.short_name(checkpoint), F.lit("_embeddings"))
    place = F.when(dim < full, F.concat(stem, F.lit("_dim"), dim.cast("string"), F.lit("_vectors.npy"))).when(dim == full, F.concat(stem, F.lit("_vectors.npy")))
    return required(place, F.concat(F.lit("no cache of this dimension: "), checkpoint))
