from docs import SCHEMA, awkward
from lodepath.llm import lines as L
from pyspark.sql import functions as F


def slow(rows, sites):
    strip = " \t\n\x0b\x0c\r"
    spread = {}
    for _, text, _, site, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip(strip) and site is not None:
                spread.setdefault(line.strip(strip), set()).add(site)
    out = []
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        gone = [len(spread.get(p.strip(strip), ())) >= sites for p in parts]
        out.append((i, sum(bool(p.strip(strip)) for p in parts), sum(gone), "\n".join(p for p, g in zip(parts, gone) if not g)))
    return sorted(out, key=str)


def test_matches_exact_counts(spark):
    rows = [(i, f"own {i}\n boilerplate \n\nshared {i % 4}\r\nend", "en", f"site{i % 12}", 1) for i in range(60)]
    rows += [(100 + (r[0] or 0), *r[1:]) for r in awkward()] + [(300, "boilerplate", "en", None, 1), (300, "boilerplate", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit("clash")).withColumn("n_lines", F.lit("clash")).withColumn("h", F.lit(1))
    for sites in (3, 8, 12):
        got = L.cleaned(docs, sites).select("row_.doc_id", "n_lines", "n_removed", "clean_text").collect()
        assert sorted(map(tuple, got), key=str) == slow(rows, sites)


def test_near_the_threshold_counts_are_exact(spark):
    """A sketch of 16 registers is off by a quarter; the result isn't."""
    rows = [(n * 100 + k, f"line {n}", "en", f"s{k}", 1) for n in range(30, 50) for k in range(n)]
    got = L.cleaned(spark.createDataFrame(rows, SCHEMA), sites=40, lg_k=4)
    assert {r.doc_id // 100 for r in got.where("n_removed > 0").select("row_.doc_id").collect()} == set(range(40, 50))


def test_no_rows(spark):
    assert L.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0
