"""Evaluation, statistics, reports, lookups and graph tables on small rows with known answers."""

import itertools
import math

import numpy as np
import pytest
from lodepath.functions import text as X
from lodepath.operators import evaluate as E
from lodepath.operators import graph as G
from lodepath.operators import lookup as L
from lodepath.operators import reports as R
from lodepath.operators import stats
from pyspark.sql import functions as F


def examples(spark):
    rows = [("m", None, "1", True, True, 5, 3, 2.0), ("m", None, "2", True, False, 9, 0, None), ("m", None, "3", False, True, 2, 1, 0.0), ("k", 8, "1", False, False, 4, 0, None)]
    return spark.createDataFrame(rows, "model string, dimension int, id string, true boolean, pred boolean, nodes_visited int, path_length int, path_cost double").withColumn("time_ms", F.lit(1.5))


def test_metrics_keep_null_groups_and_empty_denominators(spark):
    got = {(r.model, r.dimension): r for r in E.metrics(examples(spark), ["model", "dimension"]).collect()}
    m, k = got[("m", None)], got[("k", 8)]
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 0) and m.f1_score == 0.5 and m.avg_path_length == 2.0 and m.avg_path_cost == 1.0 and m.avg_cost_per_hop == 1.0
    assert (k.precision, k.recall, k.f1_score, k.accuracy, k.avg_path_length) == (0.0, 0.0, 0.0, 1.0, 0.0)


def test_percentiles_budgets_and_lookup(spark):
    rows = spark.createDataFrame([("a", 4, "astar", v, int(v % 3 > 0)) for v in range(1, 30)] + [("b", None, "bfs", 5, 0)], "model string, dimension int, strategy string, nodes_visited int, path_length int")
    done = E.visited_analysis(rows, ["model", "dimension", "strategy"])
    a = done.where("model = 'a'").first()
    ok = [v for v in range(1, 30) if v % 3]
    assert a.p95_visited == pytest.approx(np.percentile(range(1, 30), 95)) and a.p95_visited_successful_only == pytest.approx(np.percentile(ok, 95)) and a.max_visited_successful_only == 29
    caps = E.budgets(done)
    assert {r.model: r.cap for r in caps.collect()} == {"a": math.ceil(np.percentile(ok, 95)), "b": 0}
    runs = rows.select("model", "dimension", "strategy").distinct()
    first = spark.createDataFrame([("b", None, "bfs", 99)], "model string, dimension int, strategy string, cap long")
    assert {r.model: r.cap for r in E.with_budget(runs, [first, caps]).collect()}["b"] == 99
    with pytest.raises(Exception):
        E.with_budget(runs, [first]).collect()
    assert spark.createDataFrame([(889.7,)], "p double").select(X.budget_of(F.col("p"))).first()[0] == 890


def test_alignment_and_selectors_are_guarded(spark):
    a = spark.createDataFrame([("1", True, True), ("2", False, True)], "id string, true boolean, pred boolean")
    b = spark.createDataFrame([("2", False, False), ("3", True, True)], "id string, true boolean, pred boolean")
    assert [tuple(r) for r in E.aligned(a, b).select("id", "a", "b").collect()] == [("2", True, False)]
    for bad in (b.union(b), spark.createDataFrame([("2", True, True)], b.schema)):
        with pytest.raises(ValueError):
            E.aligned(a, bad)
    runs = spark.createDataFrame([("BGE", "x/bge_relu", 8, "astar"), ("BGE", "x/bge", None, "astar")], "model string, model_path string, dimension int, algorithm string")
    assert E.select_run(runs, ["bge", "RELU"], 8).first().dimension == 8
    for parts, dim in ((["bge"], None), (["none"], None), (["bge"], 9)):
        with pytest.raises(ValueError):
            E.select_run(runs, parts, dim)
    assert E.parse_selector("model_contains=a, model_contains=b,dim=3") == {"model_contains": ["a", "b"], "dim": ["3"]}


def test_running_best_and_epoch_sources(spark):
    h = spark.createDataFrame([("r", 1, 0, 5.0), ("r", 2, 1, 3.0), ("r", 3, 2, 3.0), ("r", 4, 3, 4.0), ("s", 1, None, 1.0)], "run string, step long, epoch int, value double")
    got = {r.run: (r.epoch, r.source) for r in E.best_epoch(h, F.lit(None).cast("int"), F.lit(20), F.lit(5)).collect()}
    assert got == {"r": (1, "history"), "s": (15, "early_stopping")}


def test_budget_matrix_faults(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    row = lambda m, b, f=0.5, n=3: (m, b, n, f, f, f, f, 1.0, 2, 1)
    rows = spark.createDataFrame([row("a", 1), row("a", 1), row("b", 1, 1.5), row("c", 1), row("a", 2, 0.5, 9)], "model string, budget int, num_examples int, accuracy double, f1_score double, precision double, recall double, avg_nodes_visited double, num_positive int, num_negative int")
    got = sorted((r.fault, r.model, r.budget) for r in E.budget_matrix_faults(rows, models, [1, 2]).collect())
    assert got == [("missing", "b", 2), ("out of range", "a", 2), ("out of range", "b", 1), ("repeated", "a", 1), ("unexpected", "c", 1)]
    with pytest.raises(ValueError):
        E.check_budgets([3, 2], ["a"])


def test_bootstraps_agree_with_each_other_and_with_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, bool(rng.random() < 0.6), bool(rng.random() < 0.8), bool(rng.random() < 0.6)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, true boolean, a boolean, b boolean")
    one = stats.bootstrap(df, draws=800).first()
    cells = df.groupBy("true", "a", "b").agg(F.count("*").alias("n")).withColumn("comparison", F.lit("x"))
    two = stats.bootstrap_numpy(cells, draws=4000).first()
    t, a, b = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    f1 = lambda p, i: 2 * (t[i] & p[i]).sum() / max(1, 2 * (t[i] & p[i]).sum() + (t[i] != p[i]).sum())
    everyone = np.arange(150)
    assert one.delta == pytest.approx(f1(a, everyone) - f1(b, everyone)) and two.delta == pytest.approx(one.delta)
    draws = []
    for _ in range(2000):
        i = np.concatenate([rng.choice(np.flatnonzero(t == c), (t == c).sum()) for c in (True, False)])
        draws.append(f1(a, i) - f1(b, i))
    for r in (one, two):
        assert abs(r.ci_low - np.percentile(draws, 2.5)) < 0.02 and abs(r.ci_high - np.percentile(draws, 97.5)) < 0.02
    same = stats.bootstrap(df.withColumn("b", F.col("a")), draws=50).first()
    assert (same.delta, same.p_value) == (0.0, 1.0)
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.02), ("z", 0.9)], "c string, p_value double")
    assert [(r.c, round(r.p_adjusted, 9), r.significant) for r in stats.bonferroni(tests).orderBy("c").collect()] == [("x", 0.03, True), ("y", 0.06, False), ("z", 1.0, False)]


def test_coverage_reports(spark):
    nodes = spark.createDataFrame([("heavy rain",), ("Rain",), ("??",), ("sun  dog",), ("",)], "node string")
    vocab = spark.createDataFrame([("rain",), ("sun",), ("rain",)], "word string")
    got = {r.node: (r.n_tokens, r.n_known, r.exact, r.coverage) for r in R.node_coverage(nodes, vocab).collect()}
    assert got == {"heavy rain": (2, 1, False, "partial"), "Rain": (1, 1, True, "all"), "??": (1, 0, False, "none"), "sun  dog": (2, 1, False, "partial"), "": (0, 0, False, "none")}
    s = R.coverage_summary(nodes, vocab).first()
    assert (s.nodes, s.exact, s.any_known, s.all_known, s.partial_known, s.none_known, s.missing_tokens, s.all_percent) == (5, 1, 3, 1, 2, 2, 3, 20.0)
    q = spark.createDataFrame([("d", "1", "rain", "dog"), ("d", "2", "dog", "sun")], "dataset string, id string, cause string, effect string")
    m = R.missing_endpoints(q, vocab, 1).collect()
    assert [tuple(r) for r in m] == [("d", "dog", ["cause", "effect"], 2, ["1"], ["dog"])]
    e = R.endpoint_coverage(q, vocab).first()
    assert (e.occurrences, e.covered_occurrences, e.endpoints, e.covered_endpoints) == (4, 2, 3, 2)


def test_histograms_bands_and_paths(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 10, 100, 1000, 0, -5)] + [(None,)], "x double")
    assert {r.bin: r.n for r in R.histogram(v, "x", bins=3).collect()} == {0: 1, 1: 1, 2: 2}
    same = R.histogram(v.where("x = 10"), "x", log=False).first()
    assert (same.n, same.bin) == (1, 5)
    assert [r.band for r in R.bands(spark.createDataFrame([(1.0,), (2.0,), (50.0,), (51.0,), (400.0,)], "value double"), 3).orderBy("value").collect()] == [0, 0, 1, 1, 2]
    p = spark.createDataFrame([(True, ["a", "b", "c"], 5, 9), (False, ["a"], 0, 9), (True, [], 10, 9), (True, [], 4, -1)], "answer boolean, path array<string>, visited long, cap long")
    r = R.path_length_summary(p, []).first()
    assert (r.pairs, r.reached, r.avg_hops, r.avg_hops_positive, r.avg_hops_negative, r.max_hops, r.cut_off) == (4, 2, 1.0, 2.0, 0.0, 2, 1)
    why = [x.w for x in p.select(X.termination(F.col("path"), F.col("visited"), F.col("cap"), F.lit("astar")).alias("w")).collect()]
    assert why == ["path_found", "path_found", "cap_reached", "frontier_exhausted"]


def test_lookups(spark):
    nodes = spark.createDataFrame([("ai",), ("ai safety",), ("AI",), ("C#",), ("rain",), ("train",)], "node string")
    names = lambda df: [r.node for r in df.collect()]
    assert names(L.autocomplete(nodes, " AI ")) == ["AI", "ai", "ai safety"]
    assert names(L.autocomplete(nodes, "ai", exact_case=True)) == ["ai", "ai safety"]
    assert names(L.autocomplete(nodes, "rain")) == ["rain"] and names(L.autocomplete(nodes, "afe")) == ["ai safety"]
    assert names(L.autocomplete(nodes, "", 2)) == ["AI", "C#"] and names(L.suggestions(nodes, "zzz")) == []
    w = spark.createDataFrame([("ai",), ("RAIN",), (" c# ",), ("snow",)], "text string")
    assert {r.text: r.node for r in L.canonical(w, nodes).collect()} == {"ai": "ai", "RAIN": "rain", "c#": "C#", "snow": None}


def test_neighbourhoods_forests_and_links(spark):
    pairs = [("ai", "intermediate"), ("intermediate", "target"), ("ai", "ai safety"), ("x", "y"), ("ai", "hub"), ("hub", "p"), ("hub", "q")]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "cause string, effect string, pos long")
    seed = spark.createDataFrame([("target",)], "node string")
    near = {r.node: r["round"] for r in G.neighbourhood(edges, seed, 2, 10).collect()}
    assert near == {"target": 0, "intermediate": 1, "ai": 2}
    assert {r.node for r in G.neighbourhood(edges, spark.createDataFrame([("ai",)], "node string"), 1, 3).collect()} == {"ai", "hub", "intermediate"}
    assert {r.node for r in G.result_neighbourhood(edges, ["ai", "intermediate", "target"], "ai", "target").collect()} >= {"ai", "intermediate", "target", "ai safety"}
    nodes = G.nodes_of(edges)
    forest = G.spanning_forest(edges, nodes).collect()
    assert len(forest) == nodes.count() - 2 and {(r.source, r.target) for r in forest} <= set(pairs)
    links = G.visual_links(edges, nodes, ["ai", "intermediate", "target"], 7).collect()
    assert {(r.source, r.target) for r in links if r.is_path} == {("ai", "intermediate"), ("intermediate", "target")} and len(links) == 7
    import json

    made = json.loads(G.payload(nodes, G.visual_links(edges, nodes, ["ai", "hub"], 9), G.degrees(edges), ["ai", "hub"], "ai", "hub").first()[0])
    assert {n["id"]: n["status"] for n in made["nodes"]}["ai"] == "source" and len(made["nodes"]) == 9
    pair = G.warm_up_pair(edges).first()
    assert (pair.src, pair.dst) == ("ai", "p")
    assert tuple(G.hub(G.degrees(edges)).first()) == ("ai",)
    quads = G.path_quadruples(spark.createDataFrame([(1, ["ai", "hub", "p"])], "query_id long, path array<string>"), edges, "cause", "effect").collect()
    assert sorted((r.step, r.start, r.positive, r.negative) for r in quads) == [(0, "ai", "hub", "ai safety"), (0, "ai", "hub", "intermediate"), (1, "hub", "p", "q")]


def test_catalogue_agrees_with_its_sql(spark):
    """A few cheap queries end to end; the driver compares them all."""
    import duckdb

    from lodepath.plans import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "part", "events", "labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("edge_dedup_last_wins", "two_hop_pairs", "budget_sweep", "grouped_confusion", "family_argmin"):
        got = catalog.QUERIES[name](spark, sf).toPandas()
        want = con.execute(catalog.ORACLE_SQL[name]).df()
        key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).values.tolist()))
        assert key(got) == key(want), name


def test_stream_of_edges_drops_repeats(spark, tmp_path):
    from datetime import datetime, timedelta

    from lodepath.streaming import edges as T

    at = datetime(2024, 1, 1)
    for k in range(2):
        rows = [("a", "b", 1, at + timedelta(minutes=k)), ("a", "a", 1, at), (f"c{k}", "d", 2, at + timedelta(minutes=k))]
        spark.createDataFrame(rows, T.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = T.edge_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("edges_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.cause, r.effect) for r in spark.sql("SELECT * FROM edges_seen").collect()) == [("a", "b"), ("c0", "d"), ("c1", "d")]


def test_permuted_rows_change_nothing(spark):
    pairs = list(itertools.permutations("abcd", 2))
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "cause string, effect string, edge_seq long")
    assert sorted(map(tuple, G.dedup_edges(edges.repartition(5), []).collect())) == sorted(map(tuple, G.dedup_edges(edges, []).collect()))


def test_encoding_resumes_and_caches_fill_in_order(spark):
    from lodepath.operators import encode as C

    nodes = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "node string")
    done = spark.createDataFrame([("a", [9.0, 9.0]), ("gone", [1.0, 1.0])], "node string, vec array<float>")
    lengths = lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r.node: r.vec for r in C.encode_missing(nodes, done, lengths, 1).collect()} == {"a": [9.0, 9.0], "bb": [2.0, 1.0], "ccc": [3.0, 1.0]}
    low, full = done.select("node", F.slice("vec", 1, 1).alias("vec")), spark.createDataFrame([("a", [1.0, 2.0]), ("bb", [3.0, 4.0])], done.schema)
    found, rest = C.sliced_cache(nodes, 1, [low, full])
    assert {r.node: r.vec for r in found.collect()} == {"a": [9.0], "bb": [3.0]} and [r.node for r in rest.collect()] == ["ccc"]
    assert {r.node: r.vec for r in C.sliced_cache(nodes, 2, [low, full])[0].collect()}["a"] == [1.0, 2.0]


def test_losses(spark):
    from lodepath.operators import encode as C

    v = lambda *x: [float(i) for i in x]
    rows = spark.createDataFrame([(v(0, 0), v(3, 4), v(1, 0), v(6, 8)), (v(0, 0), v(1, 0), v(0, 5), v(1, 1))], "current array<double>, positive array<double>, negative array<double>, end array<double>")
    d = lambda a, b: math.dist(a, b)
    deltas = {k: [d(c[:k], p[:k]) + d(p[:k], e[:k]) - d(c[:k], n[:k]) - d(n[:k], e[:k]) for c, p, n, e in rows.collect()] for k in (1, 2)}
    for name, act in (("relu", lambda x: max(x, 0)), ("gelu", lambda x: 0.5 * x * (1 + math.erf(x / math.sqrt(2))))):
        got = {r.dim: r.loss for r in C.rank_loss(rows, [1, 2], name).collect()}
        assert got == pytest.approx({k: np.mean([act(x) for x in deltas[k]]) for k in (1, 2)})
    one = spark.createDataFrame([("What is the  rain",)], "t string").select(C.words_of(F.col("t")).alias("a"), C.words_of(F.col("t"), ["is", "the"]).alias("b")).first()
    assert one.a == ["What", "is", "the", "rain"] and one.b == ["what", "rain"]


def test_registries_and_defaults(spark):
    m = spark.createDataFrame([("a",), ("b",)], "model string")
    meta = spark.createDataFrame([("a", "L2")], "model string, distance string")
    assert {r.model: r.metric for r in E.metric_of(m, meta).collect()} == {"a": "euclidean", "b": "cosine"}
    with pytest.raises(Exception):
        E.metric_of(m, spark.createDataFrame([("a", None)], meta.schema)).collect()
    runs = spark.createDataFrame([("g", 1)], "graph string, n int")
    assert E.universe_of(runs, spark.createDataFrame([("g", "u")], "graph string, universe string")).first().universe == "u"
    with pytest.raises(Exception):
        E.universe_of(runs, spark.createDataFrame([("h", "u")], "graph string, universe string")).collect()
    cap = spark.createDataFrame([(27,)], "cap int")
    assert E.shared_caps(cap, m).count() == 2
    with pytest.raises(ValueError):
        E.shared_caps(cap.union(cap), m)
    files = spark.createDataFrame([("k", "p1", 5), ("k", "p2", 7), ("k", "p0", 7)], "key string, path string, modified long")
    assert E.latest(files, ["key"]).first().path == "p2"
    pairs = spark.createDataFrame([(1, "a", "b", 4), (1, "a", "b", 4), (1, "c", "d", 8), (2, "a", "b", 4)], "batch int, source string, target string, visited int")
    assert tuple(E.per_batch_average(pairs).first()) == (6.0, 5.0)


@pytest.mark.parametrize("n, p", [(1, 0.3), (40, 0.2), (40, 0.24), (300, 0.5), (1_000_000, 0.5), (1_000_000, 0.93), (1_000_000, 3e-6), (10**12, 0.2)])
def test_binomial_draws_have_their_distribution(spark, n, p):
    """Against numpy's sampler at every count, over a million draws of a million examples included: quantiles, moments, and the
    frequency of each value where there are few."""
    draws = 1_000_000 if n == 1_000_000 and p == 0.5 else 50_000
    state = stats.hash_state(F.col("id"), F.lit(3))
    rows = spark.range(draws).select(stats.binomial(F.lit(n).cast("long"), F.lit(p), state).alias("x"))
    got = np.sort(rows.toPandas()["x"].to_numpy())
    want = np.sort(np.random.default_rng(1).binomial(n, p, draws))
    sd = (n * p * (1 - p)) ** 0.5
    assert got[0] >= 0 and got[-1] <= n
    assert abs(got.mean() - n * p) < 5 * sd / draws**0.5 and abs(got.std() / sd - 1) < 5 / draws**0.5 + 0.02 * (sd < 3)
    for at in (0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999):
        i = int(at * draws)
        assert abs(got[i] - want[i]) <= max(1, 0.25 * sd if at in (0.001, 0.999) else 0.08 * sd)
    if sd < 20:
        values = np.arange(int(want[0]), int(want[-1]) + 1)
        a, b = ((np.searchsorted(x, values, "right") - np.searchsorted(x, values)) / draws for x in (got, want))
        assert np.abs(a - b).max() < 5 * (2 * 0.25 / draws) ** 0.5


def test_binomial_edges(spark):
    rows = spark.createDataFrame([(0, 0.5), (5, 0.0), (5, 1.0), (-1, 0.5), (5, None), (None, 0.5)], "n long, p double")
    got = [r[0] for r in rows.select(stats.binomial(F.col("n"), F.col("p"), stats.hash_state(F.lit(1)))).collect()]
    assert got == [0, 0, 5, 0, None, None]
