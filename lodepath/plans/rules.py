"""Queries of the rules for runs, models and caches, and of the recurrent policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodepath.functions import runs as U
from lodepath.functions import text as X
from lodepath.operators import graph as G
from lodepath.operators import policy as P
from lodepath.operators import search as S
from lodepath.plans import fixtures as D
from lodepath.plans.catalog import query
from lodepath.plans.fixtures import table


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_nationkey::VARCHAR WHEN 1 THEN '7' END AS cap, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 3 END AS n_settings FROM customer""")
def caps_and_settings(spark, sf):
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(a) for a in ("A*", "BFS", "RL", "Dijkstra", "other")]), (k % 5 + 1).cast("int"))
    settings = F.create_map(F.lit("astar_max_visits"), F.col("c_nationkey").cast("string"), F.lit("_model"), F.lit("x"), F.lit("bfs_max_visits"), F.lit("7"), F.lit("z"), F.lit("1"))
    kept = U.public_settings(F.when(k % 4 != 0, settings))
    return table(spark, sf, "customer").select("c_custkey", U.used_cap(name, settings).alias("cap"), F.size(kept).alias("n_settings"))


@query("""SELECT p_partkey, 'set_' || p_size AS dataset, 'out/ablation/' || p_brand || '/set_' || p_size || '/v' || p_partkey % 3 || '/evaluation_results.json' AS json,
  'out/' || p_brand || '/set_' || p_size || '/v' || p_partkey % 3 || '/visited_nodes_analysis.json' AS analysis FROM part""")
def run_places(spark, sf):
    args = (F.col("p_brand"), F.concat(F.lit("data/set_"), "p_size", F.lit("_filtered.json")), F.concat(F.lit("v"), F.col("p_partkey") % 3))
    rows = table(spark, sf, "part").select("p_partkey", U.run_files("out", *args).alias("f"), U.run_files("out", *args, ablation=True).alias("a"))
    return rows.select("p_partkey", "f.dataset", "a.json", "f.analysis")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'old/' ELSE 'new/' END || s_suppkey AS place, s_suppkey % 4 <= 2 AS "exists" FROM supplier""")
def first_places(spark, sf):
    """Canonical folders before their aliases: some suppliers have both, some one, some none."""
    k = F.col("s_suppkey")
    folders = F.transform(U.alias_folders(F.lit("old"), {"old": "new"}), lambda g: F.concat(g, F.lit("/"), k))
    s = table(spark, sf, "supplier")
    there = s.where(k % 4 != 3).select(F.explode(F.when(k % 4 == 0, F.slice(folders, 1, 1)).when(k % 4 == 1, F.slice(folders, 2, 1)).otherwise(folders)).alias("path"))
    return U.first_existing(s.select("s_suppkey", folders.alias("places")), there).select("s_suppkey", "place", "exists")


@query("""SELECT (row_number() OVER (ORDER BY n_name))::INTEGER AS number, printf('%02d. ', row_number() OVER (ORDER BY n_name)) || 'A* | ' || n_name || CASE WHEN n_regionkey = 0 THEN ' | baseline' ELSE ' | dim ' || n_regionkey END
  || ' | F1=' || CASE WHEN n_nationkey % 4 = 0 THEN 'n/a' ELSE printf('%.6f', n_nationkey / 32.0::DOUBLE) END AS line FROM nation""")
def run_lines(spark, sf):
    rows = table(spark, sf, "nation").select(F.lit("A*").alias("algorithm"), F.col("n_name").alias("model"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("dimension"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") / 32.0).alias("f1_score"))
    return U.run_listing(rows, ["model"])


def _measured(spark, sf):
    n = F.col("n_nationkey").cast("long")
    values = {"num_examples": n * 4, "tp": n, "fp": n + 1, "tn": n + 2, "fn": n + 3, "precision": n / 8.0, "recall": n / 16.0, "f1_score": n / 32.0, "accuracy": n / 64.0, "avg_nodes_visited": n * 1.5, "avg_time_ms": n * 0.5}
    return table(spark, sf, "nation").select(F.col("n_name").alias("model"), F.col("n_regionkey").cast("long").alias("budget"), *[v.alias(k) for k, v in values.items()])


@query("""SELECT n_name AS model, n_regionkey::BIGINT AS budget, n_nationkey * 4::BIGINT AS evaluated_examples, n_nationkey::BIGINT AS true_positives, n_nationkey + 1::BIGINT AS false_positives, n_nationkey + 2::BIGINT AS true_negatives,
  n_nationkey + 3::BIGINT AS false_negatives, n_nationkey / 8.0::DOUBLE AS precision, n_nationkey / 16.0::DOUBLE AS recall, n_nationkey / 32.0::DOUBLE AS f1, n_nationkey / 64.0::DOUBLE AS accuracy, (n_nationkey * 1.5)::DOUBLE AS average_visited_nodes,
  (n_nationkey * 0.5)::DOUBLE AS average_runtime_ms FROM nation""")
def aggregated_budget_rows(spark, sf):
    return U.budget_rows(_measured(spark, sf))


@query("""SELECT 'caps' AS experiment, n_name AS model, n_regionkey::BIGINT AS budget, (n_nationkey / 32.0)::DOUBLE AS f1, (SELECT count(DISTINCT n_regionkey) FROM nation)::INTEGER AS n_budgets, (SELECT count(*) FROM region)::INTEGER AS n_models FROM nation""")
def budget_document(spark, sf):
    """The document, parsed again."""
    configurations = table(spark, sf, "region").select(F.col("r_name").alias("model"), F.col("r_regionkey").alias("dimension"))
    made = U.budget_document(U.budget_rows(_measured(spark, sf)), configurations, experiment="caps", run_suffix="v1")
    form = "experiment string, selected_budgets array<long>, model_configurations array<struct<model:string>>, aggregated_results array<struct<model:string,budget:long,f1:double>>"
    d = made.select(F.from_json("document", form).alias("d")).select("d.*")
    return d.select("experiment", F.explode("aggregated_results").alias("r"), F.size("selected_budgets").alias("n_budgets"), F.size("model_configurations").alias("n_models")).select("experiment", "r.model", "r.budget", "r.f1", "n_budgets", "n_models")


@query("""SELECT s_name AS model, CASE s_suppkey % 5 WHEN 0 THEN 'no checkpoint' WHEN 1 THEN 'no weights' WHEN 2 THEN 'no metadata' WHEN 3 THEN 'other settings' END AS fault FROM supplier WHERE s_suppkey % 5 < 4""")
def checkpoint_faults(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("checkpoint", F.concat(F.lit("models/m"), k))
    configurations = s.select(F.col("s_name").alias("model"), "checkpoint", F.lit("ReLU").alias("activation"), F.lit("euclidean").alias("distance"))
    names = F.array_compact(F.array(F.when(k % 5 > 1, "a.safetensors"), F.when((k % 5 == 1) | (k % 5 > 2), "training_metadata.json"), F.when(k % 5 > 0, "config.json")))
    listing = s.select(F.explode(F.transform(names, lambda n: F.concat("checkpoint", F.lit("/"), n))).alias("path"))
    told = s.select("checkpoint", F.when(k % 5 == 3, "gelu").otherwise("relu").alias("activation"), F.lit("euclid").alias("distance"))
    return U.checkpoint_faults(configurations, listing, told)


@query("""SELECT c_custkey, 'py -m lodepath.run set.json --run-suffix v' || c_nationkey || ' --graph g --embedding-device cpu --embedding-batch-size ' || c_custkey
  || CASE WHEN c_custkey % 2 = 0 THEN ' --force-baselines --force-model-results' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' --skip-dijkstra' ELSE '' END AS command,
  CASE WHEN c_custkey % 4 = 0 THEN 'mine' ELSE 'models/base_relu_euclid_norm_mrl_v' || c_nationkey || '_finetuned' END AS model_path FROM customer""")
def evaluation_commands(spark, sf):
    k = F.col("c_custkey")
    runs = table(spark, sf, "customer").withColumn("suffix", F.concat(F.lit("v"), "c_nationkey")).withColumn("model_path", F.when(k % 4 == 0, "mine")).withColumn("dimension", F.lit(8))
    runs = U.tested_model(None, runs, "models", base="base", normalize="norm", layers="mrl")
    line = U.evaluation_command(F.lit("py"), "lodepath.run", F.lit("set.json"), F.lit("g"), F.col("suffix"), F.lit("cpu"), k, k % 2 == 0, k % 3 == 0)
    return runs.select("c_custkey", F.array_join(line, " ").alias("command"), "model_path")


@query("""SELECT suffix, a.i::INTEGER AS ordinal, 'base_' || a.c || '_norm_mrl_' || suffix || CASE WHEN a.i > 0 THEN '_ablation' ELSE '' END || '_finetuned' AS model, a.i = 0 AND suffix = 'v3' AS mine
  FROM (SELECT DISTINCT 'v' || n_regionkey AS suffix FROM nation), (VALUES (0, 'relu_euclid'), (1, 'relu_cosine'), (2, 'gelu_euclid'), (3, 'gelu_cosine')) a(i, c)""")
def ablation_models(spark, sf):
    names = U.ablation_names(table(spark, sf, "nation").select(F.concat(F.lit("v"), "n_regionkey").alias("suffix")).distinct(), "base", "norm", "mrl")
    mine = U.trained_models(names.select(F.concat(F.lit("models/"), "model").alias("path")), "v3").select(F.substring("path", 8, 200).alias("model"), F.lit(True).alias("m"))
    return names.join(mine, "model", "left").select("suffix", "ordinal", "model", F.coalesce("m", F.lit(False)).alias("mine"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 9 = 0 THEN '--' || p_partkey % 2 ELSE p_name END AS node FROM part WHERE p_partkey % 5 <> 0)
SELECT 'entity' AS kind, node AS text FROM n UNION SELECT 'entity', 'stop stop action' UNION SELECT 'relation', 'stop'
UNION SELECT 'question', CASE WHEN p_partkey % 2 = 0 THEN 'q' || p_partkey ELSE 'can ' || p_name || ' cause ' || p_name || '?' END FROM part WHERE p_name IN (SELECT node FROM n)""")
def policy_preload(spark, sf):
    p = table(spark, sf, "part")
    nodes = p.where("p_partkey % 5 <> 0").select(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("--"), F.col("p_partkey") % 2)).otherwise(F.col("p_name")).alias("node"))
    nodes = nodes.unionByName(spark.createDataFrame([("--",), (" ",)], "node string"))
    asked = p.select(F.col("p_name").alias("cause"), F.col("p_name").alias("effect"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("q"), "p_partkey")).alias("question"))
    return U.preload_texts(nodes, X.is_valid_node(F.col("node")), asked)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE 'e' || p_partkey END AS example, p_partkey % 4 <> 0 AS tuned, CASE WHEN p_partkey % 4 < 2 THEN 'BGE' ELSE 'other' END AS label,
  p_partkey % 5 < 3 AS said, CASE WHEN p_partkey % 2 = 0 THEN 'rl' ELSE 'astar' END AS algorithm, CASE WHEN p_size = 0 THEN 'batch is not positive' WHEN p_size > 128 THEN 'batch is too large' WHEN 128 % p_size <> 0 THEN 'batch does not divide'
  WHEN p_partkey % 7 = 0 THEN 'epochs are not positive' WHEN p_partkey % 11 = 0 THEN 'patience is negative' END AS fault,
  CASE WHEN p_partkey % 3 = 0 THEN 768 WHEN p_partkey % 3 = 1 THEN 384 WHEN p_size % 2 = 1 THEN p_size END AS dimension, 'c/m' || p_partkey || '_embeddings' || CASE WHEN p_size < 50 THEN '_dim' || p_size ELSE '' END || '_vectors.npy' AS cache FROM part WHERE p_size <= 50""")
def rules_of_models(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/bge-large-en-v1.5", "a/bge-large-en-v1.5_relu_cos", "b/other_best_finetuned", "other_gelu_l2")]), (k % 4 + 1).cast("int"))
    said = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "1", "TRUE ", "no", "0")]), (k % 5 + 1).cast("int"))
    dim = U.model_dimension(F.when(k % 3 == 0, "known"), F.when(k % 3 == 1, "near").otherwise("far"), F.when(size % 2 == 1, size).otherwise(0), {"known": 768, "near": 384})
    return table(spark, sf, "part").where("p_size <= 50").select(
        "p_partkey", U.example_id(F.when(k % 3 != 0, F.concat(F.lit("e"), k)).otherwise(""), k).alias("example"), U.of_family(path, "finetuned").alias("tuned"), U.compact_label(path).alias("label"), U.flag(said).alias("said"),
        U.algorithm_key(F.when(k % 2 == 0, " RL").otherwise("A-Star")).alias("algorithm"), U.training_fault(size, F.when(k % 7 == 0, 0).otherwise(3), F.when(k % 11 == 0, -1).otherwise(2)).alias("fault"), dim.alias("dimension"),
        U.vector_cache("c", F.concat(F.lit("models/m"), k), size, F.lit(50)).alias("cache"),
    )


@query("""SELECT user_id AS run, CASE WHEN user_id % 3 = 0 THEN 'best-' || min(event_id) || '-0.ckpt' ELSE min('best-' || event_id || '-0.ckpt') END AS best_file,
  CASE WHEN user_id % 2 = 0 THEN 'last.ckpt' ELSE arg_max('best-' || event_id || '-0.ckpt', row(ts, 'best-' || event_id || '-0.ckpt')) END AS last_file, count(*) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS n_files FROM events GROUP BY user_id""")
def checkpoint_files(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    name = F.concat(F.lit("best-"), "event_id", F.lit("-0.ckpt"))
    last = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("run")).agg(F.lit("last.ckpt").alias("file"), F.min("ts").alias("modified"))
    files = e.select(F.col("user_id").alias("run"), name.alias("file"), F.col("ts").alias("modified")).unionByName(last)
    recorded = e.groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("m")).select("run", F.when(F.col("run") % 3 == 0, F.concat(F.lit("checkpoints/best-"), "m", F.lit("-0.ckpt"))).alias("best"))
    return U.checkpoint_evidence(files, recorded, X.checkpoint_epoch).select("run", "best_file", "last_file", "n_files")


@query("""SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 4 = 0 THEN 'named' || s_suppkey || '.sqlite3' WHEN s_suppkey % 4 = 1 THEN 'm' || s_suppkey || '_a.sqlite3' END AS study FROM supplier""")
def study_files(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    models = s.select(F.concat(F.lit("x/m"), k).alias("model"), F.when(k % 4 != 2, F.concat(F.lit("named"), k, F.lit(".sqlite3"))).alias("study"))
    at = lambda end: F.concat(F.lit("m"), k, F.lit(end))
    names = F.when(k % 4 == 0, F.array(F.concat(F.lit("named"), k, F.lit(".sqlite3")))).when(k % 4 == 1, F.array(at("_a.sqlite3"))).when(k % 4 == 2, F.array(at("_a.sqlite3"), at("_b.sqlite3")))
    return U.study_file(models, s.select(F.explode(names).alias("name"))).select(F.substring("model", 4, 20).cast("long").alias("supplier"), "study")


@query("""SELECT n_name AS id, format('{:,}', n_nationkey * 1234567) || ' nodes · ' || n_regionkey || ' edges' AS size_label, CASE WHEN n_nationkey % 2 = 0 THEN 'astar,rl' ELSE 'astar' END AS algorithms FROM nation""")
def graph_choices(spark, sf):
    k = F.col("n_nationkey")
    able = F.when(k % 2 == 0, F.array(F.lit("bfs"), F.lit("astar"), F.lit("rl"))).otherwise(F.array(F.lit("astar"), F.lit("bfs")))
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("id"), (k.cast("long") * 1234567).alias("nodes"), F.col("n_regionkey").cast("long").alias("edges"), able.alias("algorithms"))
    return U.graph_options(rows, ["astar", "rl"]).select("id", "size_label", F.array_join("algorithms", ",").alias("algorithms"))


@query()
def beam_search_policy(spark, sf):
    """Beam search by the recurrent policy, with seeded weights and the vectors' own dimension."""
    vectors = D.vectors_v(spark, sf)
    edges = D.graph_v(spark, sf).select(F.col("src").alias("cause"), F.col("dst").alias("effect"), F.col("pos").alias("edge_seq"), F.lit(None).cast("string").alias("sentence"))
    entities = vectors.select(F.col("node").alias("text"), "vec")
    stop = vectors.where("node = 'v0'").select(F.lit(P.STOP_RELATION).alias("text"), "vec")
    says = edges.select(F.concat("cause", F.lit(" can cause "), "effect").alias("text"), F.col("effect").alias("node")).join(vectors, "node").select("text", "vec")
    asked = D.questions_v(spark, sf)
    wanted = asked.join(vectors.withColumnRenamed("node", "target"), "target").select("query_id", "vec")
    score = P.scorer(P.seeded(1, 128, 64, 128, 128), wanted, entities.unionByName(stop.withColumn("text", F.lit(P.STOP_ENTITY))), says.unionByName(stop))
    return S.beam_search(asked, G.ordered_multigraph(edges), score, rounds=2)
