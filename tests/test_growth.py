"""Queries on tables that are larger, or hold more ties, than the smallest ones: nothing lost, nothing left to chance."""

from pyspark.sql import functions as F

from lodepath.sources import readers


def test_dense_ids_number_every_row_of_wide_rows(spark):
    """Adaptive execution joins the narrow rows of the offsets into other partitions than the wide ones."""
    rows = spark.range(12_000).select((F.col("id") * 7 % 12_000).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("vec"))
    with_parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = readers.dense_ids(rows, "k", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_parts)
    assert sorted((r.k, r.n) for r in out) == [(i, i) for i in range(12_000)]


def test_equal_candidates_go_by_their_place(spark):
    """Runs that tie in everything are ranked, and chosen, by their place in the list, in any order of the rows."""
    from lodepath.operators import evaluate as E

    rows = [("m", f"runs/{i}", 8, "astar", 0.9, 0.5, 10.0, None, 3.0, i) for i in range(40)]
    form = "model string, model_path string, dimension int, algorithm string, f1_score double, accuracy double, avg_time_ms double, avg_time_sec double, avg_nodes_visited double, place long"
    for given in (rows, rows[::-1]):
        c = E.candidates(spark.createDataFrame(given, form)).withColumn("family", F.lit("m"))
        assert {r.model_path: r["rank"] for r in E.ranked(c).collect()} == {f"runs/{i}": i + 1 for i in range(40)}
        s = E.family_summary(c).first()
        assert {s.best.model_path, s.fastest.model_path, s.fastest_viable.model_path} == {"runs/0"}


def test_pooled_vectors_have_a_row_for_each_token_not_each_number(spark):
    from lodepath.functions import vectors as V

    tokens = spark.createDataFrame([(1, ["a", "a", "b", "z"]), (2, ["z"]), (3, None)], "key long, tokens array<string>")
    table = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0, 8.0, 0.0])], "word string, vec array<double>")
    out = V.pooled(tokens, table, 3)
    assert {r.key: r.vec for r in out.collect()} == {1: [2.0, 4.0, 2.0], 2: [1.0] * 3, 3: [1.0] * 3}
    assert "posexplode" not in out._jdf.queryExecution().toString()


def test_cheapest_within_hops_meets_in_the_middle(spark):
    import random

    from lodepath.operators import search as S

    rng = random.Random(9)
    edges = [(rng.randrange(20), rng.randrange(20), rng.uniform(0, 2)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "src long, dst long, cost double")
    pairs = [(i * 20 + j, i, j) for i in range(6) for j in range(20)]
    queries = spark.createDataFrame(pairs, "query_id long, source long, target long")
    for hops in (1, 5, 6):
        want = {}
        for q, s, t in pairs:
            best = {s: 0.0}
            for _ in range(hops):
                more = dict(best)
                for a, b, c in edges:
                    if a in best:
                        more[b] = min(more.get(b, float("inf")), best[a] + c)
                best = more
            if t in best:
                want[q] = round(best[t], 9)
        assert {r.query_id: round(r.cost, 9) for r in S.within_hops(queries, frame, hops).collect()} == want


def test_steps_meet_their_vectors_in_cells(spark):
    """Whatever the number of blocks; a path of one node costs nothing and a missing vector has no cost."""
    import math

    from lodepath.functions import vectors as V

    vec = {i: [math.sin(i), i / 7.0, 1.0] for i in range(50)}
    steps = [(i, i % 50, i * 3 % 50) for i in range(900)] + [(1000, 4, None), (1001, 4, 99)]
    vectors = spark.createDataFrame(list(vec.items()), "node long, vec array<float>")
    for blocks in (1, 3):
        got = {r.key: r.cost for r in V.step_costs(spark.createDataFrame(steps, "key long, src long, dst long"), vectors, blocks).collect()}
        assert len(got) == 902 and got[1000] == 0.0 and got[1001] is None
        assert all(abs(got[k] - math.dist(vec[a], vec[b])) < 1e-5 for k, a, b in steps[:900])


def test_question_lists_are_several(spark, tmp_path, monkeypatch):
    from lodepath.plans import files

    spark.range(2_500).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    made, read = [], files.readers.msmarco_questions
    monkeypatch.setattr(files.readers, "msmarco_questions", lambda spark, path, name: (made.append(path), read(spark, path, name))[1])
    assert files.question_list_file(spark, str(tmp_path)).count() == sum(i % 3 != 2 for i in range(2_500))
    assert len(spark.read.text(made[0]).inputFiles()) == 3


def test_relation_files_are_several(spark, tmp_path, monkeypatch):
    """One file for so many parts, though the table itself is a single small split; every part's edge is read back."""
    from lodepath.plans import files

    k = F.col("id")
    part = spark.range(1_000).select(k.alias("p_partkey"), F.concat(F.lit("part "), k).alias("p_name"), F.lit("Brand#1").alias("p_brand"), (k % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(files, "PARTS_A_FILE", 300, raising=False)
    made, read = [], files.readers.graph_edges
    monkeypatch.setattr(files.readers, "graph_edges", lambda spark, path: (made.append(path), read(spark, path))[1])
    rows = files.relation_file_edges(spark, str(tmp_path)).collect()
    assert sorted((r.cause, r.effect, r.support) for r in rows) == sorted((f"part {i}", "Brand#1", i % 50) for i in range(1_000))
    assert len(spark.read.text(made[0]).inputFiles()) == 4


def test_relational_distances_keep_only_the_last_round(spark, monkeypatch):
    """Folders of earlier rounds are deleted, and A* finds its distances once."""
    from lodepath.operators import search as S

    calls, kept, gone = [], [], []
    find, store, drop = S.distances, S.stored, S.discard
    monkeypatch.setattr(S, "distances", lambda *a, **k: (calls.append(1), find(*a, **k))[1])
    monkeypatch.setattr(S, "stored", lambda df, name="step": (kept.append(name), store(df, name))[1])
    monkeypatch.setattr(S, "discard", lambda *t: (gone.extend(t), drop(*t)))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(4)], "src string, dst string, cost double")
    vectors = spark.createDataFrame([(f"n{i}", [float(i)]) for i in range(5)], "node string, vec array<double>")
    q = spark.createDataFrame([(1, "n0", "n4")], "query_id long, source string, target string")
    assert S.astar_euclidean(q, edges, vectors).first().path == [f"n{i}" for i in range(5)]
    assert len(calls) == 1 and kept.count("best") == len(gone)
