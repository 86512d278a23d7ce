"""Queries of the readers, the sinks and the rules for single values: tables are written in the raw formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.functions import models as M
from lodepath.functions import text as X
from lodepath.functions import vectors as V
from lodepath.operators import evaluate as E
from lodepath.operators import reports as R
from lodepath.plans.catalog import query
from lodepath.plans.fixtures import table, vectors_v
from lodepath.plans.session import new_path, stored
from lodepath.sources import readers, vector_files, writers

# graph files

#: Parts of a compressed file: their lines take a task some seconds to write, whatever the bytes of the table that they come from.
PARTS_A_FILE = 10_000


@query("""SELECT trim(p_name) AS cause, p_brand AS effect, p_size::BIGINT AS support, 'causenet' AS graph_source,
  CASE WHEN p_partkey % 3 = 0 THEN 'said ' || p_partkey WHEN p_partkey % 3 = 2 THEN trim(p_name) || ' risks ' || p_brand
       WHEN p_partkey % 4 = 0 THEN trim(p_name) || ' causes ' || p_brand WHEN p_partkey % 4 = 1 THEN p_brand || ' is a symptom of ' || trim(p_name)
       WHEN p_partkey % 4 = 2 THEN trim(p_name) || ' is a risk factor for ' || p_brand ELSE trim(p_name) || ' can cause ' || p_brand END AS sentence FROM part""")
def relation_file_edges(spark, sf):
    """Relations as compressed JSON lines, some of them loops, blank or without letters; the format follows from the name.

    Rows are dealt to files by their count: the table has few bytes for the work of its rows, so its splits would be too few."""
    k = F.col("p_partkey")
    heading = F.element_at(F.array(*[F.lit(h) for h in ("causes", "Symptoms", "Risk factor", "other")]), (k % 4 + 1).cast("int"))
    kind = F.when(k % 3 == 0, "clueweb12_sentence").when(k % 3 == 1, "wikipedia_list").otherwise("wikipedia_infobox")
    payload = F.struct(F.when(k % 3 == 0, F.concat(F.lit("said "), k)).alias("sentence"), heading.alias("list_toc_section_heading"), F.lit("risks").alias("infobox_argument"))
    sources = F.array(F.struct(F.lit("other").alias("type"), payload.alias("payload")), F.struct(kind.alias("type"), payload.alias("payload")))
    line = lambda a, b: F.to_json(F.struct(F.struct(F.struct(a.alias("concept")).alias("cause"), F.struct(b.alias("concept")).alias("effect")).alias("causal_relation"), F.col("p_size").alias("support"), sources.alias("sources")))
    name = F.concat(F.lit(" "), F.translate("p_name", " ", "_"))
    lines = F.array(line(name, F.col("p_brand")), line(name, name), F.lit("  "), line(F.lit("--"), name))
    path = new_path(spark, "relations") + ".jsonl"
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    dealt = parts.repartition(max(1, -(-parts.count() // PARTS_A_FILE)), "p_partkey")
    dealt.select(F.explode(lines).alias("value")).write.option("compression", "bzip2").text(path)
    return readers.graph_edges(spark, path).select("cause", "effect", "support", "graph_source", "sentence")


@query("""SELECT lower(p_name) AS cause, 'x ' || p_partkey % 7 AS effect, p_size::BIGINT AS support, lower(p_name) || ' can cause x ' || p_partkey % 7 AS sentence,
  greatest(p_size / 100.0, (p_partkey % 10) / 10.0)::DOUBLE AS causality_score FROM part WHERE p_partkey % 5 <> 0""")
def lexical_file_edges(spark, sf):
    """The lexical graph's lines, written and read back; loops and lines of other forms are skipped."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.upper("p_name").alias("cause"), F.when(k % 5 == 0, F.lower("p_name")).otherwise(F.concat(F.lit("X_"), k % 7)).alias("effect"), F.col("p_size").alias("count"), (F.col("p_size") / 100.0).alias("necessity_score"), (k % 10 / 10.0).alias("sufficiency_score"))
    path = new_path(spark, "lexical") + ".txt"
    writers.write_ceg(rows, path)
    spark.createDataFrame([("no arrow\t1\t0.5\t0.5",), ("a->b\t1",), ("a->b\tx\t0.1\t0.1",)], "value string").write.mode("append").text(path)
    return readers.graph_edges(spark, path).select("cause", "effect", "support", "sentence", "causality_score")


@query("""SELECT row_number() OVER (ORDER BY node) - 1 AS node_id, node FROM (SELECT DISTINCT p_name AS node FROM part)""")
def node_file_ids(spark, sf):
    path = new_path(spark, "nodes")
    nodes = table(spark, sf, "part").select(F.col("p_name").alias("node")).distinct()
    text = F.to_json(F.struct(F.col("node").alias("s")))  # {"s":...}
    nodes.repartitionByRange(3, "node").sortWithinPartitions("node").select(F.substring(text, F.lit(6), F.length(text) - 6).alias("value")).write.text(path)
    return readers.node_universe(spark, path)


# question files


@query("""SELECT 'msmarco_valid_' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Q ' || s_suppkey || '?' ELSE 'does Big ' || s_name || ' cause Bad_Thing?' END AS question,
  'big ' || lower(s_name) AS cause, 'bad_thing' AS effect, s_suppkey % 3 = 0 AS answer FROM supplier WHERE s_suppkey % 3 <> 2""")
def question_list_file(spark, sf):
    """JSON lists of tagged questions, one for 1,000 keys at most, as a reader takes a list whole: ids, texts, spans, labels; rows
    without a label go."""
    k = F.col("s_suppkey")
    tagged = F.array(*[F.array(w, F.lit("X")) for w in (F.lit("does"), F.lit("Big"), F.col("s_name"), F.lit("cause"), F.lit("Bad_Thing"))])
    answers = F.when(k % 3 == 0, F.array(F.lit(" Yes "))).when(k % 3 == 1, F.array(F.lit("No"))).otherwise(F.array(F.lit("?")))
    spans = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(4), F.lit(4)))
    one = F.to_json(F.struct(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("Q "), k)).alias("question"), answers.alias("answer:Extracted"), spans.alias("query"), tagged.alias("question:POS")))
    path = new_path(spark, "questions")
    lists = table(spark, sf, "supplier").groupBy(F.floor(k / 1000).alias("list")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    lists.write.partitionBy("list").text(path)
    return readers.msmarco_questions(spark, path, "msmarco_valid")


@query("""SELECT 'sem_' || c_custkey AS id, 'can ' || lower(c_name) || ' cause a b?' AS question, lower(c_name) AS cause, 'a b' AS effect, c_custkey % 3 = 0 AS answer FROM customer WHERE c_custkey % 3 <> 2""")
def question_csv_file(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, " Causal").when(k % 3 == 1, "non-causal").otherwise("unsure")
    path = new_path(spark, "semeval")
    table(spark, sf, "customer").select(k.cast("string").alias("id"), F.concat(F.lit(" "), "c_name").alias("cause"), F.lit("A  b").alias("effect"), said.alias("causal")).write.options(header=True, quoteAll=True).csv(path)
    return readers.semeval_questions(spark, path, "sem")


# vectors, results, settings


@query("""SELECT 'w' || vec_id AS word, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS total, true AS known FROM embeddings WHERE vec_id % 5 <> 0""")
def word_vector_file(spark, sf):
    """Word vectors as text; lines of another length are skipped, their words are still in the vocabulary."""
    path = new_path(spark, "glove")
    e = table(spark, sf, "embeddings")
    numbers = F.array_join(F.transform(F.slice("embedding", 1, F.when(F.col("vec_id") % 5 == 0, 7).otherwise(8)), lambda x: x.cast("string")), " ")
    e.select(F.concat(F.lit("w"), "vec_id", F.lit(" "), numbers).alias("value")).write.text(path)
    vocab = readers.glove_vocab(spark, path).withColumn("known", F.lit(True))
    made = readers.glove(spark, path, 8).join(vocab, "word", "left")
    return made.select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), "known")


def _budget_rows(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    score = (k % 11 / 10.0).alias
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.when(k % 4 != 0, F.col("p_size")).alias("dimension"), F.lit("cosine").alias("distance"), k.cast("int").alias("budget"), F.lit(10).alias("num_examples"), score("accuracy"),
        (k % 10 / 10.0).alias("f1_score"), F.lit(0.5).alias("precision"), F.lit(0.25).alias("recall"), (k * 1.5).alias("avg_nodes_visited"), F.lit(None).cast("double").alias("avg_time_ms"), (k % 10).cast("int").alias("num_positive"), F.lit(5).alias("num_negative"),
    )


@query("""SELECT p_brand AS model, CASE WHEN p_partkey % 4 <> 0 THEN p_size ELSE -1 END AS dimension, p_partkey::INTEGER AS budget, (p_partkey % 11) / 10 AS accuracy, p_partkey * 1.5::DOUBLE AS avg_nodes_visited, NULL::DOUBLE AS avg_time_ms FROM part""")
def budget_file_rows(spark, sf):
    path = new_path(spark, "budgets")
    _budget_rows(spark, sf).write.options(header=True, sep=";").csv(path)
    return readers.budget_rows(spark, path).select("model", F.coalesce("dimension", F.lit(-1)).alias("dimension"), "budget", "accuracy", "avg_nodes_visited", "avg_time_ms")


@query("""SELECT p_brand AS model, p_partkey::INTEGER AS budget, 'out of range' AS fault FROM part WHERE p_partkey % 11 > 10 OR p_partkey % 10 + 5 <> 10
UNION ALL SELECT p_brand, p_partkey::INTEGER, 'unexpected' FROM part WHERE p_partkey NOT IN (1, 2, 3)
UNION ALL SELECT m.p_brand, c.b::INTEGER, 'missing' FROM (SELECT DISTINCT p_brand FROM part) m, (SELECT unnest([1, 2, 3]) AS b) c WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = m.p_brand AND p.p_partkey = c.b)""")
def budget_matrix_faults(spark, sf):
    rows = _budget_rows(spark, sf)
    return E.budget_matrix_faults(rows, rows.select("model").distinct(), [1, 2, 3]).select("model", "budget", "fault")


@query("""SELECT 'k' || p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'bool' WHEN 2 THEN 'quoted' WHEN 3 THEN 'float' ELSE 'str' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN p_name WHEN 3 THEN p_size || '.5' ELSE p_brand END AS value FROM part""")
def settings_file(spark, sf):
    m = F.col("p_partkey") % 5
    value = F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, "True").when(m == 2, F.concat(F.lit("'"), "p_name", F.lit("'"))).when(m == 3, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_brand"))
    lines = F.array(F.concat(F.lit("k"), "p_partkey", F.lit(": "), value), F.lit("# a: comment"), F.lit("no colon"))
    path = new_path(spark, "settings")
    table(spark, sf, "part").select(F.explode(lines).alias("value")).write.text(path)
    return readers.flat_settings(spark, path)


# sinks


@query("""SELECT replace(p_brand, '#', '\\#') || ' & ' || replace(format('{:,}', p_partkey * 1000), ',', '{,}') || ' \\\\' AS line FROM part""")
def report_lines(spark, sf):
    path = new_path(spark, "report")
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_partkey") * 1000).alias("n"))
    writers.write_report(rows, path, ["n"])
    return spark.read.text(f"{path}/latex").select(F.col("value").alias("line"))


@query("""SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier""")
def verified_write(spark, sf):
    path = new_path(spark, "verified")
    writers.write_verified(table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), path, ["s_suppkey"])
    back = spark.read.schema("s_suppkey long, s_name string, s_acctbal double").options(header=True, sep=";").csv(f"{path}/csv")
    return back.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("""SELECT event_type AS graph, 'd' || user_id % 3 AS dataset, 'r1' AS run_suffix, event_id, value FROM events WHERE event_type = 'click' OR user_id % 3 = 1""")
def result_folders(spark, sf):
    """Results by folders of graph, dataset and run; a reader of some runs opens those folders only."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("graph"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("dataset"), F.lit("r1").alias("run_suffix"), "event_id", "value")
    path = new_path(spark, "runs")
    writers.write_by_run(rows, path)
    found = readers.result_sets(spark, path, "event_id long, value double")
    return found.where("graph = 'click' OR dataset = 'd1'").select("graph", "dataset", "run_suffix", "event_id", "value")


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT s_suppkey, 3 FROM supplier""")
def replaced_rows(spark, sf):
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(3).cast(table(spark, sf, "customer").schema["c_nationkey"].dataType).alias("c_nationkey"))
    return writers.replace_rows(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), new, F.col("c_nationkey") == 3)


# rules for single values


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' ELSE 'unknown' END AS split, CASE WHEN p_partkey % 2 = 0 THEN 'msmarco' ELSE 'semeval' END AS family,
  CASE WHEN p_size = 1 THEN 'uncapped' WHEN p_size = 7 THEN 'default_p95' ELSE 'custom' END AS cap_mode, CASE WHEN p_size < 5 THEN 'source' WHEN p_size < 9 THEN 'target' WHEN p_size < 30 THEN 'path' ELSE 'normal' END AS status,
  p_size % 4 AS hops, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE -1 END AS epoch, CASE p_partkey % 3 WHEN 0 THEN 'relu' WHEN 1 THEN 'gelu' END AS choice,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '__row_' || p_size END AS row_id FROM part""")
def value_rules(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(k % 2 == 0, "msmarco_").otherwise("sem_"), F.element_at(F.array(*[F.lit(x) for x in ("train", "valid", "test", "all")]), (k % 4 + 1).cast("int")))
    cap = F.when(n == 1, -1).otherwise(n)
    node = F.when(n < 5, "a").when(n < 9, "b").when(n < 30, "c").otherwise("d")
    path = F.when(k % 3 == 0, F.concat(F.lit("runs\\x/best-"), n, F.lit("-0.5.ckpt"))).otherwise("last.ckpt")
    return table(spark, sf, "part").select(
        "p_partkey", X.split_of(name).alias("split"), X.dataset_family(name).alias("family"), X.cap_mode(cap, F.lit(7)).alias("cap_mode"), X.node_status(node, F.lit("a"), F.lit("b"), F.array(F.lit("c"))).alias("status"),
        X.hops(F.slice(F.array(*[F.lit(i) for i in range(4)]), 1, (n % 4 + 1).cast("int"))).alias("hops"), F.coalesce(X.checkpoint_epoch(path), F.lit(-1)).alias("epoch"),
        X.categorical_choice(F.lit('["relu", "gelu"]'), k % 3).alias("choice"), X.row_id(F.when(k % 2 == 0, k), n).alias("row_id"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Base One' WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'Two' END AS name, p_brand || '|' || p_size || '|' AS identity, p_brand || '_' || p_size AS slug, CASE WHEN p_size > 25 THEN 'euclidean' ELSE 'cosine' END AS metric FROM part""")
def model_names(spark, sf):
    k = F.col("p_partkey")
    aliases = M.registry(spark, [{"alias": "one", "name": "Base One"}, {"alias": "TWO", "name": "Two"}], "alias string, name string")
    rows = table(spark, sf, "part").withColumn("given", F.when(k % 3 == 0, "ONE").when(k % 3 == 1, F.col("p_brand")).otherwise("two"))
    named = M.canonical(rows, "given", aliases, "name")
    meta = rows.where("p_size > 25").select(k.alias("model"), F.lit("l2").alias("distance"))
    metric = E.metric_of(rows.select(k.alias("model")), meta).withColumnRenamed("model", "p_partkey")
    named = named.select("p_partkey", "name", M.identity(F.col("p_brand"), F.col("p_size"), F.lit(None)).alias("identity"), M.slug(F.col("p_brand"), F.col("p_size").cast("string")).alias("slug"))
    return named.join(metric, "p_partkey")


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings""")
def unit_vectors(spark, sf):
    v = vectors_v(spark, sf).withColumn("u", V.unit(F.col("vec")))
    norm = lambda c: F.round(F.sqrt(V.dot(F.col(c), F.col(c))), 6)
    return v.select(F.substring("node", F.lit(2), F.lit(20)).cast("long").alias("vec_id"), norm("vec").alias("norm"), norm("u").alias("unit_norm"))


# joins and checks of runs


def _scored(spark, sf) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    return rows.select((F.col("doc_id") % 5).alias("model"), (F.col("quality") == 1).alias("true"), (F.col("toxic") == 1).alias("pred"), (F.col("toxic") == 1).alias("answer"), n.cast("int").alias("nodes_visited"), (n % 7).cast("int").alias("path_length"), (n / 4.0).alias("time_ms"), F.when(n % 3 != 0, n / 8.0).alias("path_cost"), n.alias("n"))


@query("""WITH r AS (SELECT doc_id % 5 AS model, quality = 1 AS t, toxic = 1 AS p, n_chars AS n FROM labels JOIN documents USING (doc_id)),
c AS (SELECT model, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, round(avg(n / 4), 6) AS avg_time_ms, round(avg(n / 8) FILTER (n % 3 <> 0), 6) AS avg_path_cost FROM r GROUP BY 1)
SELECT model, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall, avg_time_ms, avg_path_cost FROM c""")
def scores_and_means(spark, sf):
    made = E.metrics(_scored(spark, sf), ["model"])
    return made.select("model", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("avg_time_ms", 6).alias("avg_time_ms"), F.round("avg_path_cost", 6).alias("avg_path_cost"))


@query("""WITH r AS (SELECT doc_id % 5 AS model, toxic = 1 AS answer, CASE WHEN n_chars % 7 > 0 THEN n_chars % 7 - 1 END AS hops, n_chars % 7 = 0 AND n_chars > 900 AS cut FROM labels JOIN documents USING (doc_id))
SELECT model, count(*) AS pairs, count(hops) AS reached, round(avg(hops), 6) AS avg_hops, round(avg(hops) FILTER (answer), 6) AS avg_hops_positive, round(avg(hops) FILTER (NOT answer), 6) AS avg_hops_negative, max(hops)::INTEGER AS max_hops, count(*) FILTER (cut) AS cut_off FROM r GROUP BY 1""")
def path_lengths(spark, sf):
    rows = _scored(spark, sf).select("model", "answer", F.slice(F.array(*[F.lit(i) for i in range(7)]), 1, F.col("path_length")).alias("path"), F.col("n").alias("visited"), F.lit(900).alias("cap"))
    made = R.path_length_summary(rows, ["model"])
    return made.select("model", "pairs", "reached", *[F.round(c, 6).alias(c) for c in ("avg_hops", "avg_hops_positive", "avg_hops_negative")], "max_hops", "cut_off")


@query("""SELECT q.doc_id AS id, q.quality = 1 AS "true", q.toxic = 1 AS a, q.doc_id % 2 = 0 AS b FROM labels q WHERE q.doc_id % 3 <> 0""")
def aligned_runs(spark, sf):
    one = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("true"), (F.col("toxic") == 1).alias("pred"))
    two = one.where("id % 3 <> 0").withColumn("pred", F.col("id") % 2 == 0)
    return E.aligned(one, two)


@query("""SELECT p_brand AS model, p_size AS dimension, p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 10 ELSE p_size END::BIGINT AS cap FROM part""")
def budgets_by_run(spark, sf):
    """Each run's cap from the first list that has one, else from its alias in the second."""
    runs = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("dimension"), F.lit("bfs").alias("strategy"), "p_partkey")
    keys = runs.select("model", "dimension", "strategy").distinct()
    first = keys.where("dimension % 2 = 0").withColumn("cap", (F.col("dimension") * 10).cast("long"))
    return E.with_budget(runs, [first, keys.withColumn("cap", F.col("dimension").cast("long"))]).select("model", "dimension", "p_partkey", "cap")


@query("""SELECT user_id AS run, arg_max(epoch, event_id)::INTEGER AS epoch, 'history' AS source FROM (SELECT user_id, event_id, event_id % 100 AS epoch, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events WHERE event_id % 4 <> 0) WHERE prev IS NULL OR value < prev GROUP BY 1
UNION ALL SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 7 ELSE 20 - 5 END, CASE WHEN user_id % 2 = 0 THEN 'checkpoint' ELSE 'early_stopping' END FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 4 <> 0) = 0""")
def best_epochs(spark, sf):
    e = table(spark, sf, "events")
    history = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100).cast("int").alias("epoch"), "value")
    return E.best_epoch(history, F.when(F.col("run") % 2 == 0, 7), F.lit(20), F.lit(5))


@query("""SELECT c_nationkey AS brand, arg_max(c_name, row(round(c_acctbal, 2), c_name)) AS path FROM customer GROUP BY 1""")
def latest_files(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("brand"), F.col("c_name").alias("path"), F.round(F.col("c_acctbal").cast("double"), 2).alias("modified"))
    return E.latest(rows, ["brand"])


@query("""SELECT n_regionkey AS universe, string_agg(n_name, ' ' ORDER BY n_nationkey) AS graphs FROM nation GROUP BY 1""")
def universe_groups(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("graph"), F.col("n_regionkey").alias("universe"), F.col("n_nationkey").alias("ordinal"))
    return R.preload_status(rows).select("universe", F.array_join("graphs", " ").alias("graphs"))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 = 0 ELSE true END AS same, abs(c_acctbal - c_acctbal * 1.001) <= 0.01 * greatest(abs(c_acctbal), abs(c_acctbal * 1.001)) AS near FROM customer""")
def three_agree(spark, sf):
    k, a = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    other = F.when((k % 3 == 0) & (k % 5 != 0), "x").otherwise("y")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", E.agrees(F.lit("y"), F.lit("y"), other).alias("same"), E.agrees(a, a * 1.001, a, 0.01).alias("near"))


@query("""SELECT p_brand AS model, 'runs/' || p_name AS model_path, p_size AS dimension FROM part WHERE lower(p_brand || ' ' || 'runs/' || p_name) LIKE '%#1%'""")
def runs_of_variant(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.concat(F.lit("runs/"), "p_name").alias("model_path"), F.col("p_size").alias("dimension"))
    return E.by_variant(rows, " #1 ")


@query("""SELECT p_brand AS model, 'runs/' || p_partkey || '/' AS model_path, p_size AS dimension FROM part WHERE lower(p_brand || ' runs/' || p_partkey || '/') LIKE '%brand%runs/7/%'""")
def selected_run(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.concat(F.lit("runs/"), "p_partkey", F.lit("/")).alias("model_path"), F.col("p_size").alias("dimension"))
    wanted = E.parse_selector("path=RUNS/7/ , path=brand")
    return E.select_run(rows, wanted["path"])


@query("""SELECT n_name AS system, n_regionkey, r_regionkey AS ordinal FROM nation JOIN region ON n_nationkey = r_regionkey * 3""")
def selected_rows(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("system"), "n_regionkey", "n_nationkey")
    wanted = rows.join(table(spark, sf, "region"), F.col("n_nationkey") == F.col("r_regionkey") * 3).select("system", F.col("r_regionkey").alias("ordinal"))
    found, lost = R.selected_systems(rows.drop("n_nationkey"), wanted)
    return found.unionByName(lost.withColumn("n_regionkey", F.lit(None).cast(rows.schema["n_regionkey"].dataType)))


@query("""WITH q AS (SELECT p_partkey AS id, p_brand AS dataset, p_name AS node FROM part), tok AS (SELECT DISTINCT node, unnest(string_split(lower(node), ' ')) AS token FROM q),
lost AS (SELECT node, string_agg(DISTINCT token, ' ' ORDER BY token) AS missing FROM tok WHERE token <> '' AND length(token) % 4 = 0 GROUP BY 1)
SELECT dataset, node, 2 * count(*) AS occurrences, any_value(missing) AS missing FROM q JOIN lost USING (node) GROUP BY ALL""")
def missing_endpoints(spark, sf):
    questions = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("dataset"), F.col("p_name").alias("cause"), F.col("p_name").alias("effect"))
    vocab = questions.select(F.explode(X.tokens(F.col("cause"), lower=True)).alias("word")).distinct().where(F.length("word") % 4 != 0)
    return R.missing_endpoints(questions, vocab).select("dataset", "node", "occurrences", F.array_join("missing", " ").alias("missing"))


@query("""WITH v AS (SELECT DISTINCT round(s_acctbal, 2) AS value FROM supplier), g AS (SELECT value, value - lag(value) OVER (ORDER BY value) AS gap FROM v), r AS (SELECT *, row_number() OVER (ORDER BY gap DESC NULLS LAST, value) AS r FROM g)
SELECT value, sum(CASE WHEN gap IS NOT NULL AND r < 3 THEN 1 ELSE 0 END) OVER (ORDER BY value)::BIGINT AS band FROM r""")
def axis_bands(spark, sf):
    return R.bands(table(spark, sf, "supplier").select(F.round(F.col("s_acctbal").cast("double"), 2).alias("value")))


@query("""WITH w AS (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS dim FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0), d AS (SELECT max(dim) AS most FROM w)
SELECT vec_id, dim::INTEGER AS dim, round(list_sum(v), 5) AS total, round(list_sum(list_transform(v, lambda x, i: x * i)), 4) AS weighted FROM w, d WHERE dim = most""")
def vector_file_ranges(spark, sf):
    """All vectors of full length as a store of binary matrices, and what a reader of byte ranges finds in it."""
    whole = table(spark, sf, "embeddings").where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    most = whole.agg(F.max(F.size("embedding")).alias("most"))
    even = whole.crossJoin(F.broadcast(most)).where(F.size("embedding") == F.col("most")).select("vec_id", F.col("embedding").alias("vec"))
    numbered = stored(readers.dense_ids(even, "vec_id", "node_id"), "vectors")
    path = new_path(spark, "matrices")
    vector_files.write_vectors(numbered, path, rows_per_file=1 << 16)
    back = vector_files.read_vectors(spark, path, task_bytes=1 << 20).join(numbered.select("node_id", "vec_id"), "node_id")
    v = F.col("vec").cast("array<double>")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return back.select("vec_id", F.size("vec").alias("dim"), F.round(add(v), 5).alias("total"), F.round(add(F.transform(v, lambda x, i: x * (i + 1))), 4).alias("weighted"))
