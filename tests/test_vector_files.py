"""Stores of vectors: ranges, faults, commits."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepath.sources import readers as R
from lodepath.sources import vector_files as V


def vectors(spark, n, dim=3, salt=0):
    comps = F.array(*[(F.col("id") * dim + i + salt).cast("float") for i in range(dim)])
    return spark.range(n).select(F.col("id").alias("node_id"), comps.alias("vec"), F.lit("x").alias("extra"))


def matrix(df):
    rows = sorted((r.node_id, list(r.vec)) for r in df.collect())
    return [i for i, _ in rows], np.array([v for _, v in rows], np.float32)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    m = np.arange(1000 * 5, dtype=np.float32).reshape(1000, 5)
    for name, kind in (("a", "<f4"), ("b", "<f8"), ("c", ">f4"), ("d", "<f2")):
        np.save(tmp_path / f"{name}.npy", (m % 1000).astype(kind))
        df = V.read_vectors(spark, f"file://{tmp_path}/{name}.npy", task_bytes=100 * 5 * 4)
        assert df.rdd.getNumPartitions() == 1000 * 5 * int(kind[-1]) // 2000
        ids, got = matrix(df)
        assert ids == list(range(1000)) and np.array_equal(got, m % 1000)
    ids, got = matrix(V.read_vectors(spark, str(tmp_path / "a.npy"), least=998, task_bytes=40))
    assert ids == [998, 999]
    ids, got = matrix(R.npy_vectors(spark, str(tmp_path / "b.npy")).where("node_id = 7"))
    assert np.array_equal(got, (m % 1000)[7:8])


def test_a_range_opens_no_other_bytes(spark, tmp_path):
    """Ids of one file don't touch the others: these may even be gone."""
    path = f"file://{tmp_path}/s"
    V.write_vectors(vectors(spark, 250).orderBy(F.rand(3)), path, rows_per_file=100)
    kept = json.load(open(tmp_path / "s" / V.MANIFEST))
    assert [f[1:] for f in kept["files"]] == [[0, 100], [100, 100], [200, 50]] and kept["dim"] == 3
    ids, got = matrix(V.read_vectors(spark, path))
    assert ids == list(range(250)) and np.array_equal(got.ravel(), np.arange(750))
    for f in kept["files"]:
        assert np.load(tmp_path / "s" / f[0]).shape == (f[2], 3)
    os.remove(tmp_path / "s" / kept["files"][0][0])
    os.remove(tmp_path / "s" / kept["files"][2][0])
    assert matrix(V.read_vectors(spark, path, 120, 129))[0] == list(range(120, 130))
    assert V.read_vectors(spark, path, 300, 400).count() == 0


def test_faulty_tables_leave_the_store_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    V.write_vectors(vectors(spark, 30), path, rows_per_file=8)
    first = {f for f in os.listdir(tmp_path / "s") if f.endswith(".npy")}
    gap = vectors(spark, 30).where("node_id <> 12")
    twice = gap.unionByName(vectors(spark, 30).where("node_id = 3"))
    far = gap.unionByName(vectors(spark, 99).where("node_id = 98"))
    short = gap.unionByName(vectors(spark, 30, dim=2).where("node_id = 12"))
    hole = gap.unionByName(spark.sql("SELECT 12L AS node_id, array(1f, NULL, 2f) AS vec, 'x' AS extra"))
    nothing = gap.unionByName(spark.sql("SELECT 12L AS node_id, CAST(NULL AS array<float>) AS vec, 'x' AS extra"))
    for bad in (gap, twice, far, short, hole, nothing):
        with pytest.raises(Exception):
            V.write_vectors(bad, path, rows_per_file=8)
        assert matrix(V.read_vectors(spark, path))[0] == list(range(30))
    V.write_vectors(vectors(spark, 10, salt=5), path, rows_per_file=8)
    assert np.array_equal(matrix(V.read_vectors(spark, path))[1].ravel(), np.arange(30) + 5)
    assert not first & set(os.listdir(tmp_path / "s"))
    with pytest.raises(Exception, match="overwrite"):
        vectors(spark, 3).drop("extra").write.format(V.FORMAT).options(path=path, rows=3, dim=3, rows_per_file=8).mode("append").save()


def test_empty_and_damaged(spark, tmp_path):
    V.write_vectors(vectors(spark, 0), str(tmp_path / "none"))
    assert V.read_vectors(spark, str(tmp_path / "none")).collect() == []
    np.save(tmp_path / "m.npy", np.ones((4, 4), np.float32))
    whole = (tmp_path / "m.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-4])
    (tmp_path / "odd.npy").write_bytes(b"no matrix")
    np.save(tmp_path / "ints.npy", np.ones((4, 4), np.int32))
    np.save(tmp_path / "cols.npy", np.asfortranarray(np.arange(6, dtype=np.float32).reshape(2, 3)))
    for name in ("cut", "odd", "ints", "cols"):
        with pytest.raises(Exception, match=name):
            V.read_vectors(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(Exception, match="manifest"):
        V.read_vectors(spark, str(tmp_path)).collect()


def test_query_agrees_with_its_sql(spark):
    import duckdb

    from lodepath.plans import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(catalog.ORACLE_SQL["vector_file_ranges"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["vector_file_ranges"](spark, sf).collect()]
    assert len(got) > 0 and sorted(got) == sorted(want)
