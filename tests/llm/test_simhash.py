import random

import numpy as np
import xxhash
from docs import SCHEMA, awkward, words
from lodepath.llm import simhash as S
from lodepath.llm.components import components
from pyspark.sql import functions as F


def slow_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius):
    ids, fps = [r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, f, least[g]) for i, f, g in zip(ids, fps, group)), key=str)


def test_fingerprint_matches_brute_force_and_spark():
    for row in awkward():
        assert S.fingerprint(row[1]) == slow_fingerprint(row[1])
    assert S.fingerprint("a b c d e " * 50, chunk=7) == slow_fingerprint("a b c d e " * 50)


def test_components_match_brute_force(spark):
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 10000]
    base = rows[8][1] or "x"
    rows += [(200 + i, f"{base} tail{i}", "en", "s1", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("tile", F.lit(1))
    got = S.near_components(docs, radius=12, tile=16).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == slow_components(rows, 12)


def test_no_rows(spark):
    assert S.near_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_find_every_link_in_any_layout():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in (1, 17, 40)])
    fps = np.unique(np.concatenate([base, near, rng.integers(0, 2**63, 900, dtype=np.uint64)]))
    u, v = S.tile_links(fps, None, 2, hold=50)
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    at = lambda a: np.searchsorted(fps, a)
    assert np.array_equal(S.roots_of(len(fps), at(u), at(v)), S.roots_of(len(fps), x, y))
    left, right = fps[::2], fps[1::2]
    u, v = S.tile_links(left, right, 2)
    both = np.concatenate([left, right])
    x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None]) <= 2)
    where = {int(f): i for i, f in enumerate(both)}
    a, b = np.array([where[int(i)] for i in u]), np.array([where[int(i)] for i in v])
    assert np.array_equal(S.roots_of(len(both), a, b), S.roots_of(len(both), x, y + len(left)))


def test_tile_plan_splits_large_cells():
    first, parts, n = S.tile_plan(np.zeros((4, 4)), np.array([3, 25, 4, 6]), 10)
    assert parts.tolist() == [1, 3, 1, 1] and first.tolist() == [0, 1, 4, 4] and n == 5


def test_contraction_finds_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + i, 2000 + j) for i in range(8) for j in range(i)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [8, 40, 61]
    assert components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


def test_spanning_links_are_links_and_connect_the_same():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 9, 120, dtype=np.uint64))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 1)
    u, v = S.spanning(fps, x, y)
    assert (np.bitwise_count(fps[u] ^ fps[v]) <= 1).all() and len(u) < len(fps)
    assert np.array_equal(S.roots_of(len(fps), u, v), S.roots_of(len(fps), x, y))


def test_similarity_is_checked_on_the_texts(spark):
    rng = random.Random(9)
    base = [[f"t{g}w{rng.randint(0, 10**6)}" for _ in range(200)] for g in range(6)]
    rows, group = [], {}
    for g, words_ in enumerate(base):
        for k in range(3):
            w = list(words_)
            for i in rng.sample(range(200), k):  # 2 words of 200 leave over 0.8 of the shingles
                w[i] = f"x{rng.random()}"
            rows.append((10 * g + k, " ".join(w), "en", "s", 1))
            group[10 * g + k] = 10 * g
    rows += [(900, "few words", "en", "s", 1), (901, "", "en", "s", 1), (902, None, "en", "s", 1), (903, " ".join(base[0][:100] + base[1][:100]), "en", "s", 1), rows[0]]
    group |= {900: 900, 901: 901, 902: 901, 903: 903}
    got = S.near_components(spark.createDataFrame(rows, SCHEMA), similar=0.8, tile=8).collect()
    assert {r.doc_id: r.component_id for r in got} == group and len(got) == len(rows)
    strict = S.near_components(spark.createDataFrame(rows, SCHEMA), similar=0.999, tile=8).collect()
    assert {r.doc_id: r.component_id for r in strict} == {i: 901 if i == 902 else i for i in group}


def five_word_components(rows, similar=0.8):
    """doc_id -> least doc_id of its component, by comparing all pairs of texts."""
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(r[1]) for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similar * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {r[0]: rows[g][0] for r, g in zip(rows, group)}


def family(n=160, size=100, own=2, seed=4):
    """n texts of which all but two words are the same; those whose own words stand close are similar."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [f"b{k}" for k in range(size)]
        for k in rng.sample(range(size), own):
            w[k] = f"y{i}x{k}"
        rows.append((i, " ".join(w), "en", "s", 1))
    return rows


def test_every_candidate_of_a_family_is_decided(spark, monkeypatch):
    rows = family()
    want = five_word_components(rows)
    assert len(set(want.values())) == 132
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.near_components(docs, similar=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    monkeypatch.setattr(S, "CELL_TEXTS", 50)
    got = S.near_components(docs, similar=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_matrix_of_similar_sets_matches_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 14))) for _ in range(40)] + [np.empty(0, np.int64)]
    slow = lambda a, b: len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b)) and len(set(a) & set(b)) > 0
    for x, y in ((sets, sets), (sets[:9], sets[5:])):
        assert S.alike(x, y, 0.5, wide=5).tolist() == [[slow(a, b) for b in y] for a in x]


def test_sketches_keep_similar_pairs_and_candidates_connect_them():
    import pyarrow as pa

    rng = random.Random(8)
    texts = []
    for n in (1, 3, 5, 8, 20, 60, 100, 150, 300, 700, 2500):
        base = [f"g{n}w{rng.randrange(10**7)}" for _ in range(n)]
        for k in range(5):
            w = list(base)
            for i in rng.sample(range(n), n * k // 150):
                w[i] = f"x{rng.random()}"
            texts.append(" ".join(w))
    sets = S.shingled(pa.array([*texts, " \n", None, "Ab  c\td"]), 5)
    assert [len(x) for x in sets[-3:]] == [0, 0, 1] and len(S.shingled(pa.array(["aB c D "]), 5)[0]) == 1
    assert S.shingled(pa.array(["aB c D "]), 5)[0] == S.shingled(pa.array([" Ab\nC d"]), 5)[0] and all((np.diff(x) > 0).all() for x in sets)
    slow = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t.lower()) for t in texts)]
    assert [len(x) for x in sets[:-3]] == [len(x) for x in slow]
    made = [S.sketch(x) for x in sets[:-3]]
    rows = {"c": np.array([m[0] for m in made], np.uint64).view(np.int64), "odd": np.array([m[3] for m in made], object), "n": np.array([len(x) for x in slow])}
    _, one = np.unique(rows["c"], return_index=True)
    rows = {k: x[one] for k, x in rows.items()}
    slow = [slow[i] for i in one]
    want = [(i, j) for i in range(len(slow)) for j in range(i) if len(slow[i] & slow[j]) >= 0.8 * len(slow[i] | slow[j])]
    assert len(want) > 20
    half = {k: x[::2] for k, x in rows.items()}, {k: x[1::2] for k, x in rows.items()}
    for parts in ([(rows, None)], [(half[0], None), (half[1], None), half]):
        links = [S.candidates(*p, 0.8, rows=3, columns=7, hold=4) for p in parts]
        at = {c: i for i, c in enumerate(rows["c"].tolist())}
        u, v = (np.array([at[c] for some in links for c in some[k].tolist()], int) for k in (0, 1))
        label = S.roots_of(len(slow), u, v)
        assert all(label[i] == label[j] for i, j in want) and len(set(label.tolist())) > 6


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    """Rows (1, B) and (2, B') are similar; a row (1, A) changes nothing for them."""
    rng = random.Random(5)
    a, b = ([f"{g}{rng.randrange(10**6)}" for _ in range(120)] for g in "ab")
    near = [*b[:60], "new", *b[61:]]
    rows = [(1, " ".join(a), "en", "s", 1), (1, " ".join(b), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (None, " ".join(near[:-1]), "en", "s", 1)]
    got = S.near_components(spark.createDataFrame(rows, SCHEMA), similar=0.8)
    assert sorted(((r.doc_id or 0, r.component_id) for r in got.collect())) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    left = S.least_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(left) == 2 and {r.doc_id for r in left} == {1}


def test_no_similar_pair_is_lost_at_any_size(spark):
    """Texts of 1 to 40 words, pairs of them at the threshold and on both sides of it, at production parameters."""
    rng, rows, i = random.Random(12), [], 0
    for n in range(1, 41):
        for _ in range(6):
            w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            for m in {n, *(n + rng.randrange(0, 2 + n // 6) for _ in range(3))}:
                at = rng.choice([0, 0, rng.randrange(n)])
                rows.append((i, " ".join([*w[:at], *(f"e{rng.randrange(10**6)}" for _ in range(m - n)), *w[at:]]), "en", "s", 1))
                i += 1
    want = five_word_components(rows)
    got = S.near_components(spark.createDataFrame(rows, SCHEMA), similar=0.8)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    left = S.least_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in left} == set(want.values()) and 200 < len(left) < len(rows) - 200


def test_sketches_bound_what_sets_differ_in():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 700, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 7], rng.integers(0, 2**63, n // 9, dtype=np.uint64)]))
        one = S.Sketches({"n": np.array([len(a), len(b)]), "c": np.arange(2), "odd": np.array([S.sketch(x)[3] for x in (a, b)], object)})
        for size, (first, words) in one.levels.items():
            both = np.bitwise_count(words[:, 0] ^ words[:, -1]).sum() if first == 0 else 0
            assert both <= len(np.setxor1d(a, b)) and words.shape == (size // 64, 2 - first)
