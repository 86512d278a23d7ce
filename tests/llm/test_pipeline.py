from collections import Counter

import corpus_pipeline as C
from docs import SCHEMA, awkward, words
from lodepath.llm.session import stored
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def tables(spark, tmp_path, rows, labels, bench):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_remove_what_they_should_and_keep_the_rest(spark, tmp_path):
    from test_classifiers import corpus

    rows, labels = corpus(300)
    plain = [f"plain{i} " + " ".join(f"u{i}x{k}" for k in range(30)) for i in range(10)]
    item = " ".join(f"bench{k}" for k in range(25))
    rows += [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    rows += [(2000, plain[0], "en", "s", 1), (2001, plain[1] + " ", "en", "t", 1), (2002, f"intro words {item} outro", "en", "s", 1)]
    sf = tables(spark, tmp_path, rows, labels, [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        at[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_files":
            assert docs.columns == columns
    truth = {i: t for i, _, t in labels}
    gone = {r[0] for r in rows} - at["toxicity"]
    assert sum(truth.get(i, 0) for i in gone) / max(len(gone), 1) > 0.9 and len(gone) > 60
    assert {1000 + i for i in range(10)} | {2000, 2001, 2002} <= at["toxicity"]
    assert {1000, 1001} <= at["simhash_near_dedup"] and not {2000, 2001} & at["simhash_near_dedup"]
    assert at["simhash_near_dedup"] - at["benchmark_decontamination"] == {2002}
    assert at["source_mixing"] <= at["benchmark_decontamination"] and at["token_files"] == at["source_mixing"]


def test_awkward_documents_and_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path / "a", awkward(), [], [])
    assert C.run(spark, sf).count() > 0
    sf = tables(spark, tmp_path / "b", [], [], [])
    assert C.run(spark, sf).count() == 0


CLASHING = ("row_", "text_", "i", "h", "s", "n", "n_", "place", "size", "score", "rejected", "held_out", "start", "tile", "source_", "shard")


def test_stages_keep_columns_of_any_name_and_awkward_rows(spark, tmp_path):
    sf = tables(spark, tmp_path, awkward(), [(1, 1, 0)], [(1, "no document has these words in it"), (2, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c + " "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    for stage in (C.drop_toxic, C.drop_benchmark):  # labels of one class, and nothing of the benchmark: all stay
        assert Counter((r.doc_id, r.text) for r in stage(spark, docs, sf).collect()) == before
    of = Counter()
    for (i, text), n in before.items():
        of[i] += len(words(text)) * n
    for stage in (C.drop_toxic, C.drop_near_copies, C.drop_benchmark, C.mix_sources):
        left = stage(spark, docs, sf)
        rows = left.collect()
        assert left.columns == docs.columns and rows
        assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        assert any(i == r.doc_id and not Counter(words(r.text)) - Counter(words(t)) for i, t in before)
    assert all(0 < n <= 3 * of[i] for i, n in taken.items()) and max(len(r.text) for r in rows) > 100_000
    assert C.write_token_files(spark, docs, sf).count() == sum(before.values())


def test_rows_without_an_id_stay(spark):
    rows = [(None, f"text {i} of many words here", "en", "s", 1) for i in range(3)] * 2 + [(1, "same words " * 9, "en", "s", 1), (2, "same words " * 9, "en", "s", 1), (1, "same words " * 9, "en", "s", 1)]
    left = C.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r.doc_id or 0, r.text[:6]) for r in left.collect()) == [(0, "text 0"), (0, "text 1"), (0, "text 2"), (1, "same w")]


def test_all_near_copies_go(spark):
    import random

    from test_simhash import five_word_components

    rng = random.Random(11)
    rows = []
    for g in range(80):
        w = [f"d{g}w{rng.randrange(10**6)}" for _ in range(200)]
        x = list(w)
        for i in rng.sample(range(200), 4 + g % 2):  # similarities on both sides of 0.8, SimHashes up to some 16 bits apart
            x[i] = f"x{rng.random()}"
        rows += [(2 * g, " ".join(w), "en", "s", 1), (2 * g + 1, " ".join(x), "en", "s", 1)]
    want = five_word_components(rows)
    left = {r.doc_id for r in C.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert left == set(want.values()) and 90 < len(left) < 150


def test_near_copies_with_clashing_ids_and_columns(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "another text " * 20, "en", "s", 1), (1, body, "en", "s", 1), (2, body + " tail", "en", "s", 1), (2, "third text of id two", "en", "s", 1), (2, "third text of id two", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("keep_", "row_", "i_", "h_", "h", "c", "root", "text_"):
        docs = docs.withColumn(c, F.lit(c))
    left = C.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text[:5], r.keep_) for r in left.collect()) == [(1, "anoth", "keep_"), (1, body[:5], "keep_"), (2, "third", "keep_")]


def test_guard_of_the_entry():
    import __spark_entry__ as e

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {"pipeline" if q == "pipeline" else q[: q.find("_") + 1] for q in e.queries()}
    assert e._optional("lodepath.llm.no_such_module") is None
