import zlib

import numpy as np
import pyarrow as pa
import pytest
from docs import SCHEMA, awkward
from lodepath.llm import tokens as T
from lodepath.llm.session import new_path
from pyspark.sql import functions as F

ODD = ["İstanbul's ΣΑΣ ﬁ", "don't I'LL <|endoftext|>x<|startoftext|>", "á ȩ́ 가", "x\x1cy\x85z w", "in%%% the!! *** a.b,c", "12 3a4", " \x00\x01", "ÀÉÿß×÷Ünder", "日本語テキスト", "\U0001f600\U0001f601 ok", "'S 'tis it's"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_have_the_librarys_ids(library):
    texts = [r[1] for r in awkward(150) if r[1] is None or len(r[1]) < 10000] + ODD + ["\n".join(ODD), None, ""]
    words = T.WordIds(T.tokenizer_path(), most=40)
    ids, n = words.batch(pa.array(texts), 2)
    at = np.concatenate([[0], np.cumsum(n)])
    for t, s, e in zip(texts, at, at[1:]):
        assert ids[s:e].tolist() == library(t), t
    assert words.batch(pa.array([], pa.string()), 2)[1].tolist() == []


def test_files_read_back_whole_and_in_order(spark, library):
    rows = awkward() + [(500 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(7))
    got = sorted(T.encoded(docs).collect(), key=lambda r: r.start)
    want = [(r[0], np.array(library(r[1]), "<u4")) for r in rows]
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_selective_reads_and_layout(spark):
    import pyarrow.parquet as pq

    path = new_path(spark, "layout")
    T.write_tokens(spark.createDataFrame(awkward(), SCHEMA), path, files=3)
    plan = T.read_tokens(spark, path, ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]
    one = T.read_tokens(spark, path).where("doc_id = 7")
    assert one.count() == 1 and "GreaterThan" not in plan
    import glob

    files = sorted(glob.glob(path.removeprefix("file://").removeprefix("file:") + "/*.parquet"))
    last = None
    for f in files:
        m = pq.ParquetFile(f).metadata
        assert m.row_group(0).column(0).has_offset_index
        ids = [i for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist() if i is not None]
        assert ids == sorted(ids) and (last is None or not ids or ids[0] >= last)
        last = ids[-1] if ids else last


def test_no_rows(spark):
    assert T.encoded(spark.createDataFrame([], SCHEMA)).count() == 0
