"""The prefix index against a scan of all nodes."""

import random

import pytest

from lodepath.operators import lookup as L


def scan(nodes, text, limit):
    q = (text or "").strip(" ").lower()
    begins = sorted(n for n in nodes if n.lower().startswith(q))
    return (begins or sorted(n for n in nodes if q in n.lower()))[:limit]


@pytest.mark.parametrize("bits", [1, 12])
def test_agrees_with_a_scan(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(L, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    nodes = {"".join(rng.choice("abAé ") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "\U0010ffffz", "abc \U0001f600", "long " * 4000, "ab%_x"}
    path = f"file://{tmp_path}/index"
    L.write_prefix_index(spark.createDataFrame([(n, 1) for n in [*nodes, "ab", "ab", None]], "node string, folded int"), path)
    nodes.add("ab")
    texts = ["", None, " AB ", "a", "b", "é", "\U0010ffff", "\U0001f600", "bc", "zzz", "%_", "ng lo", "zz", "q", *("".join(rng.choice("abé ") for _ in range(3)) for _ in range(25))]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {}
    for r in sorted(L.complete(spark, path, asked, 7).collect()):
        got.setdefault(r.query_id, []).append(r.node)
        assert r.rank == len(got[r.query_id])
    for i, t in enumerate(texts):
        assert got.get(i, []) == scan(nodes, t, 7), t


def test_the_scan_has_the_range_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BITS", 2)
    path = f"file://{tmp_path}/index"
    L.write_prefix_index(spark.range(400).selectExpr("concat('n', lpad(id, 3, '0')) AS node"), path)
    seen, kept = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: seen.append(df) or kept(df, name))
    rows = L.complete(spark, path, spark.createDataFrame([(1, "N12")], "query_id int, text string")).collect()
    assert [r.node for r in sorted(rows)] == [f"n12{i}" for i in range(10)]
    plan = seen[2]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block" in plan and "LessThanOrEqual(block" in plan


def test_empty_index_and_batch(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    L.write_prefix_index(spark.createDataFrame([], "node string"), path)
    assert L.complete(spark, path, spark.createDataFrame([(1, "a"), (2, "")], "query_id int, text string")).collect() == []
    L.write_prefix_index(spark.createDataFrame([("x",)], "node string"), path)
    assert L.complete(spark, path, spark.createDataFrame([], "query_id int, text string")).collect() == []
