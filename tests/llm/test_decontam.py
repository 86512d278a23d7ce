import random

import numpy as np
from docs import SCHEMA, awkward
from lodepath.llm import decontam as D
from pyspark.sql import functions as F


def slow_tiles(a, b, least):
    """Greedy string tiling by the definition: the longest unmarked common run, again and again."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and a[i + n] >= 0 and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return out
        n, i, j = -best[0], best[1], best[2]
        out.append((i, j, n))
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n


def test_tiles_match_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        least = rng.choice([2, 3, 5])
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))] + a[3:12] + [rng.randint(0, 3) for _ in range(5)]
        b[10:10] = [-1]  # a word that equals none
        got = D.tiles(np.array(a, int), np.array(b, int), least)
        assert sum(t[2] for t in got) == sum(t[2] for t in slow_tiles(a, b, least))
        assert got == slow_tiles(a, b, least)


def slow_overlaps(docs, items, least=5, coverage=0.5):
    """Every document against every item, by the definition; words are runs of letters and digits."""
    import regex

    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = []
    for i, text, *_ in docs:
        b = split(text)
        for k, item in items:
            a = split(item)
            number = {w: n for n, w in enumerate(dict.fromkeys(a))}
            got = slow_tiles([number[w] for w in a], [number.get(w, -1) for w in b], min(least, len(a)) or least)
            if len(a) < least:
                got = got[:1]
            total = sum(t[2] for t in got)
            if a and total >= coverage * len(a):
                out.append((i, k, len(a), total, [tuple(t) for t in got]))
    return sorted(out, key=str)


def test_query_against_every_pair(spark):
    """Repeated words, short items, parts in another order, passages within passages."""
    rng = random.Random(7)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for k in range(12)]
    items += [(20, "Of of of of of of of of"), (21, "of of"), (22, "one"), (23, None), (24, "--"), (25, "x y z. X y z, x y z!"), (26, "x y z x y"), (21, "of of")]
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "c", "Q,"]) for _ in range(rng.randint(0, 40))), "en", "s", 1) for i in range(40)]
    docs += [(50, "of " * 60, "en", "s", 1), (51, "of", "en", "s", 1), (52, "one.", None, None, 1), (53, None, None, None, None), (54, "z x y z x y z x y z x", "en", "s", 1), (None, "x y z x y", "en", "s", 1)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = D.overlaps(df, bench).collect()
    mine = sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words, [tuple(t) for t in r.tiles]) for r in got), key=str)
    assert mine == slow_overlaps(docs, items) and len(mine) > 60
    hit = {r[0] for r in mine}
    assert sorted((r.doc_id for r in D.clean_documents(df, bench).collect()), key=str) == sorted((d[0] for d in docs if d[0] not in hit), key=str)


def test_one_repeated_word_costs_what_the_texts_are_long():
    import time

    items = D.Items([(k, "of " * 600) for k in range(40)], 5)
    began = time.time()
    got = items.matches(np.zeros(50_000, np.int64), 0.5)
    assert [(n, c, t) for _, n, c, t in got] == [(600, 600, [(0, 0, 600)])] * 40 and time.time() - began < 10


def test_whole_reordered_and_partial_passages(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))
    item = [f"Item{i}" for i in range(40)]
    other = [f"zz{i}" for i in range(30)]
    docs = {
        1: f"{noise(30)} {' '.join(item)}. {noise(50)}",
        2: f"{noise(9)} {' '.join(item[20:])}\n{noise(20)} {', '.join(item[:20]).upper()} {noise(5)}",  # parts moved
        3: f"{noise(50)} {' '.join(item[:15])} {noise(9)}",  # too little
        4: f"{noise(30)} {' '.join(x for k in range(10) for x in item[k * 4 : k * 4 + 4] + ['gap'])}",  # runs too short
        5: noise(40),
        6: " ".join(other) + " " + " ".join(item),
    }
    rows = [(i, t, "en", "s", 1) for i, t in docs.items()] + [(100 + (r[0] or 0), *r[1:]) for r in awkward()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "two words"), (5, ""), (2, " ".join(other))], "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, r.covered_words) for r in D.overlaps(df, bench).collect())
    assert got == [(1, 1, 40), (2, 1, 40), (6, 1, 40), (6, 2, 30), (6, 2, 30)]  # no text has the two words side by side
    # blocks of the benchmark give the same
    assert sorted((r.doc_id, r.item_id, r.covered_words) for r in D.overlaps(df, bench, block_words=5).collect()) == got
    for words in (5, 10**6):
        kept = D.clean_documents(df, bench, block_words=words)
        assert kept.columns == df.columns
        left = [(r.doc_id, r.text) for r in kept.collect()]
        assert sorted(left, key=str) == sorted(((r[0], r[1]) for r in rows if r[0] not in (1, 2, 6)), key=str)


def test_no_rows(spark):
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(awkward(), SCHEMA)
    assert D.overlaps(some, none).count() == 0 and D.overlaps(empty, none).count() == 0
    assert D.clean_documents(some, none).count() == some.count()
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.overlaps(empty, bench).count() == 0 and D.clean_documents(empty, bench).count() == 0
