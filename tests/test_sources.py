"""Readers, writers and text rules on small files."""

import bz2
import json

import numpy as np
import pytest
from lodepath.functions import models as M
from lodepath.functions import text as X
from lodepath.functions import vectors as V
from lodepath.operators import graph as G
from lodepath.sources import readers as R
from lodepath.sources import writers as W
from pyspark.sql import functions as F


def relation(cause, effect, support=None, sources=None):
    out = {"causal_relation": {"cause": {"concept": cause}, "effect": {"concept": effect}}}
    return json.dumps(out | ({} if support is None else {"support": support}) | ({} if sources is None else {"sources": sources}))


def test_relations_are_normalised_and_filtered(spark, tmp_path):
    sent = [{"type": "wikipedia_infobox", "payload": {"infobox_argument": "symptoms"}}, {"type": "clueweb12_sentence", "payload": {"sentence": "heavy rain floods"}}]
    head = [{"type": "wikipedia_list", "payload": {"list_toc_section_heading": "Risk factor"}}]
    odd = [{"type": "wikipedia_infobox", "payload": {"infobox_argument": "unknown"}}]
    lines = [
        relation("heavy_rain", " flood ", 3, sent), relation("x", " "), relation("", "y"), relation("# ##", "z"), relation("C#", "Bug", 1, head), "", relation("a", "a"), relation("p", "q", 2, odd), relation("heavy_rain", "flood", 9),
    ]
    path = tmp_path / "g.jsonl.bz2"
    path.write_bytes(bz2.compress("\n".join(lines).encode()))
    rows = R.graph_edges(spark, f"file://{path}").orderBy("edge_seq").collect()
    assert [(r.cause, r.effect, r.support, r.sentence) for r in rows] == [
        ("heavy rain", "flood", 3, "heavy rain floods"), ("C#", "Bug", 1, "C# is a risk factor for Bug"), ("p", "q", 2, "p can cause q"), ("heavy rain", "flood", 9, "heavy rain can cause flood"),
    ]
    edges = G.dedup_edges(R.graph_edges(spark, f"file://{path}"), ["support", "sentence"]).orderBy("pos").collect()
    assert [(r.cause, r.support) for r in edges] == [("heavy rain", 9), ("C#", 1), ("p", 2)]
    assert {r.node for r in G.nodes_of(R.graph_edges(spark, f"file://{path}")).collect()} == {"heavy rain", "flood", "C#", "Bug", "p", "q"}
    bad = tmp_path / "bad.jsonl"
    bad.write_text("{not json\n")
    with pytest.raises(Exception):
        R.graph_edges(spark, f"file://{bad}").collect()


def test_lexical_lines(spark, tmp_path):
    lines = ["A_b->C->d\t5\t0.5\t0.25", "no arrow\t5\t1\t1", "x->y\t1\t2", "x->y\tmany\t1\t1", "Same->same\t9\t1\t1", "##->y\t5\t1\t1", " k -> V \t7\t0.1\t0.9\textra"]
    p = tmp_path / "g.txt"
    p.write_text("\n".join(lines) + "\n")
    rows = R.graph_edges(spark, f"file://{p}").orderBy("edge_seq").collect()
    assert [(r.cause, r.effect, r["count"], r.causality_score) for r in rows] == [("a b", "c->d", 5, 0.5), ("k", "v", 7, 0.9)]
    loose = R.ceg_edges(spark, f"file://{p}", valid_only=False, normalize=False, numbers=False).orderBy("edge_seq").collect()
    assert [(r.cause, r.effect) for r in loose] == [("A_b", "C->d"), ("x", "y"), ("Same", "same"), ("##", "y"), ("k", "V")]
    W.write_ceg(R.graph_edges(spark, f"file://{p}"), f"file://{tmp_path}/out.txt")
    assert R.ceg_edges(spark, f"file://{tmp_path}/out.txt").count() == 2
    kept = spark.createDataFrame([(5, 0.1, 0.1), (4, 1.0, 1.0), (9, 0.1, 0.05)], "c int, n double, s double").where(X.keeps_strength(F.col("c"), F.col("n"), F.col("s")))
    assert [r.c for r in kept.collect()] in ([5], [])  # 0.1 ** 0.9 * 0.1 ** 0.1 is 0.1 but for rounding
    with pytest.raises(ValueError):
        R.graph_format("graph.csv")


def test_questions(spark, tmp_path):
    pos = [["Smoking", "NN"], ["causes", "V"], ["Lung", "NN"], ["CANCER", "NN"]]
    rows = [
        {"id": "1", "question": "does smoking cause cancer", "answer:Extracted": ["Yes"], "query": [[0, 0], [2, 3]], "question:POS": pos},
        {"question": "", "answer:Extracted": ["No"], "query": [[0, 0], [3, 3]], "question:POS": pos},
        {"id": "3", "question": "q?", "answer:Extracted": ["No Answer Present."], "query": [[0, 0], [1, 1]], "question:POS": pos},
        {"id": "4", "question": "q?", "answer:Extracted": [], "query": [[0, 0], [1, 1]], "question:POS": pos},
        {"id": "5", "question": "q?", "answer:Extracted": ["Yes"], "query": [[9, 9], [1, 1]], "question:POS": pos},
    ]
    p = tmp_path / "q.json"
    p.write_text(json.dumps(rows))
    got = {r.id: tuple(r)[1:] for r in R.msmarco_questions(spark, f"file://{p}", "msmarco_valid").collect()}
    assert got.pop("msmarco_valid_1") == ("does smoking cause cancer?", "smoking", "lung cancer", True)
    assert list(got.values()) == [("Smoking causes Lung CANCER?", "smoking", "cancer", False)]
    assert R.msmarco_questions(spark, f"file://{p}", "msmarco_train").count() == 1
    c = tmp_path / "s.csv"
    c.write_text("id,cause,effect,causal\n1,Ｆｉｒｅ  x,smoke,Causal\n2,a,b,non-causal\n3,a,b,maybe\n4,,b,yes\n")
    got = R.semeval_questions(spark, f"file://{c}", "sem_test").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("sem_test_1", "can fire x cause smoke?", "fire x", "smoke", True), ("sem_test_2", "can a cause b?", "a", "b", False)]


def test_node_universe_vectors_and_overlay(spark, tmp_path):
    p = tmp_path / "nodes.jsonl"
    p.write_text('"alpha"\n"be\\"ta"\n"gamma"\n')
    nodes = R.node_universe(spark, f"file://{p}").cache()
    assert [tuple(r) for r in nodes.orderBy("node_id").collect()] == [(0, "alpha"), (1, 'be"ta'), (2, "gamma")]
    np.save(tmp_path / "v.npy", np.array([[1, 2], [3, 4], [5, 6]], np.float32))
    v = R.npy_vectors(spark, f"file://{tmp_path}/v.npy")
    status = R.embedding_status(v, nodes).first()
    assert status.valid and R.embedding_status(v.limit(2), nodes).first().reason == "row count differs"
    old = v.join(nodes, "node_id").select("node", "vec")
    new = spark.createDataFrame([("gamma", [7.0, 8.0])], "node string, vec array<float>")
    saved = {r.node: r.vec for r in W.save_vectors(old, new, nodes).collect()}
    assert saved == {"alpha": [1.0, 2.0], 'be"ta': [3.0, 4.0], "gamma": [7.0, 8.0]}
    with pytest.raises(ValueError):
        W.save_vectors(None, new, nodes)
    with pytest.raises(ValueError):
        W.save_vectors(old, spark.createDataFrame([("delta", [7.0])], "node string, vec array<float>"), nodes)


def test_glove_settings_and_missing_runs(spark, tmp_path):
    (tmp_path / "g.txt").write_text("the 1 2\nbad 1\nrain 3 x\nsun 0.5 -1\n")
    assert {r.word: r.vec for r in R.glove(spark, f"file://{tmp_path}/g.txt", 2).collect()} == {"the": [1.0, 2.0], "sun": [0.5, -1.0]}
    assert R.glove_vocab(spark, f"file://{tmp_path}/g.txt").count() == 4
    (tmp_path / "h.yaml").write_text("# c\nlr: 1e-3\nn: 5\nname: 'x y'\nflag: True\nnone: null\ntext: a b\n")
    got = {r.key: (r.kind, r.value) for r in R.flat_settings(spark, f"file://{tmp_path}/h.yaml").collect()}
    assert got == {"lr": ("float", "1e-3"), "n": ("int", "5"), "name": ("quoted", "x y"), "flag": ("bool", "true"), "none": ("null", None), "text": ("str", "a b")}
    assert R.runs(spark, f"file://{tmp_path}/nothing.json").count() == 0


def test_pooled_prefix_and_distances(spark):
    rows = spark.createDataFrame([("k", ["a", "a", "b", "?"]), ("none", ["?"]), ("empty", [])], "key string, tokens array<string>")
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0])], "word string, vec array<double>")
    assert {r.key: r.vec for r in V.pooled(rows, table, 2).collect()} == {"k": [2.0, 1.0], "none": [1.0, 1.0], "empty": [1.0, 1.0]}
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = one.select(V.euclidean(a, b).alias("e"), V.cosine(a, a).alias("c"), V.unit(a).alias("u"), V.prefix(a, 1).alias("p"), V.cosine(a, b).alias("z")).first()
    assert (r.e, round(r.c, 12), r.u, r.p, r.z) == (5.0, 0.0, [0.6, 0.8], [3.0], 1.0)


def test_names(spark):
    df = spark.createDataFrame([("models/BAAI_bge_relu_cos_norm_finetuned",), ("granite-small",), ("x\\mpnet_ablation_gelu_l2",)], "p string")
    got = [tuple(r.m) for r in df.select(M.parsed(F.col("p")).alias("m")).collect()]
    assert got == [("BAAI_bge", "finetuned", "relu", "cosine", True), ("granite-small", "base", None, None, None), ("mpnet_ablation", "ablation", "gelu", "euclidean", None)]
    fam = [r.f for r in df.select(M.family(F.lit(""), F.col("p")).alias("f")).collect()]
    assert fam == ["BGE", "Granite", "MPNet"]
    dims = spark.range(1).select(M.matryoshka_dims(F.lit(1024)).alias("a"), M.matryoshka_dims(F.lit(384)).alias("b")).first()
    assert dims.a == [1024, 768, 512, 256, 128, 64, 32, 16, 8, 4, 2] and dims.b == [384, 256, 128, 64, 32, 16, 8, 4, 2]
    assert spark.createDataFrame([("a\\best-12-x.ckpt",), ("notbest-3-",)], "p string").select(X.checkpoint_epoch(F.col("p"))).collect()[0][0] == 12


def test_white_space_is_python_s(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(s + "a" + s,) for s in spaces] + [("​a",)], "t string")
    assert [r[0] for r in df.select(X.strip(F.col("t"))).collect()] == ["a"] * len(spaces) + ["​a"]


def test_written_tables(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 0.1 + 0.2), ("n", None, 1e-9)], "model string, dim int, f1 double")
    W.write_verified(df, f"file://{tmp_path}/v", ["model"])
    assert spark.read.parquet(f"file://{tmp_path}/v/table").count() == 2
    new = spark.createDataFrame([("n", None, 0.5), ("o", 2, 0.5)], "model string, dim int, f1 double")
    assert sorted(r.model for r in W.append_new(df, new, ["model", "dim"]).collect()) == ["m", "n", "o"]
    assert sorted(r.f1 for r in W.replace_rows(df, new, F.col("model") == "n").collect()) == [0.1 + 0.2, 0.5, 0.5]
    r = spark.range(1).select(W.latex_cell(F.lit(1234567), True).alias("a"), W.latex_cell(F.lit("a_b & 5%")).alias("b"), W.latex_cell(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == ("1{,}234{,}567", r"a\_b \& 5\%", "--")
    W.write_report(df, f"file://{tmp_path}/rep", ["f1"])
    runs = spark.createDataFrame([("g", "d", "s", "1", True)], "graph string, dataset string, run_suffix string, id string, pred boolean")
    W.write_by_run(runs, f"file://{tmp_path}/runs")
    back = R.result_sets(spark, f"file://{tmp_path}/runs", "id string, pred boolean")
    assert back.where("graph = 'g'").count() == 1 and "PartitionFilters: [isnotnull(graph" in back.where("graph = 'g'")._jdf.queryExecution().toString()
