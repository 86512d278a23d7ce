import math
import re
from collections import Counter

from docs import awkward
from lodepath.llm import licenses as L
from pyspark.sql import functions as F

FILES = "file_id long, path string, text string"


def slow_cosine(texts, passage, template):
    """TF-IDF cosine by the definition; words of no template weigh as if no file had them."""
    split = lambda s: re.findall(r"[^\W_]+", s.lower())
    vocab = {w for _, t in L.TEMPLATES for w in split(t)}
    df = {w: sum(w in split(t or "") for t in texts) for w in vocab}
    idf = lambda w: math.log((len(texts) + 1) / (df.get(w, 0) + 1)) + 1
    vec = lambda s: {w: split(s).count(w) * idf(w) for w in split(s)}
    a, b = vec(passage), vec(template)
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b))


def test_headers_files_and_inheritance(spark):
    mit, apache = L.TEMPLATES[2][1], L.TEMPLATES[0][1]
    rows = [
        (1, "a/LICENSE", f"Title\n{mit}"),
        (2, "a/x.txt", "plain words"),
        (3, "a/b/y.txt", "nothing here"),
        (4, "a/b/c/LICENSE.md", apache),
        (5, "a/b/c/d/z.txt", "still nothing"),
        (6, "a/b/own.py", f"code\n# {apache}\nmore code"),
        (7, "q/r.txt", "no licence above"),
        (8, None, "no path"),
        (9, "a/b/null.txt", None),
        (10, "a/near.txt", "Released under an MIT License"),
        (11, "top.txt", "at the top"),
    ] + [(100 + (r[0] or 0), f"z/{r[0]}", r[1]) for r in awkward()]
    files = spark.createDataFrame(rows, FILES).withColumn("dir", F.lit("clash")).withColumn("licence", F.lit("clash"))
    got = {r.file_id: r for r in L.scan(files).collect() if r.file_id < 100}
    own = {i: r.own_license for i, r in got.items() if r.own_license}
    assert own == {1: "MIT", 4: "Apache-2.0", 6: "Apache-2.0", **({10: "MIT"} if slow_cosine([r[2] for r in rows], rows[9][2], mit) >= 0.8 else {})}
    assert got[1].is_licence_file and got[4].is_licence_file and not got[6].is_licence_file
    inherited = {i: (r.licence, r.inherited_from) for i, r in got.items() if r.inherited_from is not None}
    assert inherited == {2: ("MIT", "a"), 3: ("MIT", "a"), 5: ("Apache-2.0", "a/b/c"), 9: ("MIT", "a"), **({} if 10 in own else {10: ("MIT", "a")})}
    assert L.scan(files).count() == len(rows)
    assert math.isclose(got[6].similarity, slow_cosine([r[2] for r in rows], f"# {apache}", apache), rel_tol=1e-9)


def test_wrapped_headers_and_full_texts_are_found(spark):
    import textwrap

    code = "\n".join(f"def f{i}(x{i}): return g{i}(x{i}, {i})" for i in range(60))
    wrap = lambda t, mark="": textwrap.fill(t, 60, initial_indent=mark, subsequent_indent=mark)
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    full = {n: t for n, t in L.TEMPLATES if len(t) > 400}
    rows = [
        (1, "a/x.py", wrap(gpl, "# ") + "\n" + code),
        (2, "a/y.py", code + "\n" + wrap(full["Apache-2.0"], "// ") + "\n" + code),
        (3, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(full["MIT"])),
        (4, "m/sub/z.py", code),
        (5, "b/COPYING", "Copyright 2021, Some One\n" + wrap(full["BSD-3-Clause"]) + "\n" + code),
        (6, "c/plain.py", code),
    ]
    got = {r.file_id: r for r in L.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert {i: r.own_license for i, r in got.items()} == {1: "GPL-3.0", 2: "Apache-2.0", 3: "MIT", 4: None, 5: "BSD-3-Clause", 6: None}
    assert (got[4].licence, got[4].inherited_from) == ("MIT", "m")
    assert {i for i, r in got.items() if r.is_licence_file} == {3, 5}


def test_no_rows(spark):
    assert L.scan(spark.createDataFrame([], FILES)).count() == 0


def slow_scan(rows, least=0.8):
    """Best template, licence files and nearest ancestor of a whole table, every passage against every template."""
    split = lambda s: re.findall(r"[^\W_]+", s.lower())
    texts = [t or "" for _, _, t in rows]
    vocab = {w for _, t in L.TEMPLATES for w in split(t)}
    df = {w: sum(w in set(split(t)) for t in texts) for w in vocab}
    idf = lambda w: math.log((len(texts) + 1) / (df.get(w, 0) + 1)) + 1
    vec = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    forms = [(n, len(split(t)), vec(split(t))) for n, t in L.TEMPLATES]
    forms = [(n, k, v, norm(v)) for n, k, v in forms]
    own, files = {}, {}
    for i, path, text in rows:
        lines = [split(x) for x in (text or "").split("\n")]
        every = {(0, len(lines))} | {(s, s + 1) for s in range(len(lines))}
        spans = {(s, e, at) for s, e in every for at in range(len(forms))}
        for s in range(len(lines)):
            for at, (_, k, _, _) in enumerate(forms):
                e, n = s, 0
                while e < len(lines) and n < k:
                    n += len(lines[e])
                    e += 1
                spans |= {(s, e, at), (s, e - 1, at)} if lines[s] else set()
        best = None
        for s, e, at in spans:
            ws = [w for x in lines[s:e] for w in x]
            if not ws:
                continue
            v = vec(ws)
            name, _, f, m = forms[at]
            c = sum(x * f.get(w, 0) for w, x in v.items()) / (norm(v) * m)
            if c >= least:
                best = max(best or (0, 0, ""), (round(min(c, 1.0), 9), -at, name))
                files[i] = files.get(i, False) or not any(lines[:s]) and not any(lines[e:]) or bool(L.LICENCE_FILE.match((path or "").rpartition("/")[2]))
        own[i] = best
    given = {}
    for i, path, _ in rows:
        if files.get(i) and path is not None:
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (1, "", 0, "")), (-own[i][0], path, i, own[i][2]))
    out = {}
    for i, path, _ in rows:
        licence, at = (own[i][2], None) if own[i] else (None, None)
        d = path.rpartition("/")[0] if path is not None and not own[i] else None
        while d is not None:
            if d in given:
                licence, at = given[d][3], d
                break
            d = d.rpartition("/")[0] if d else None
        out[i] = (own[i][2] if own[i] else None, own[i][0] if own[i] else None, files.get(i, False), licence, at)
    return out


def test_whole_tables_match_brute_force(spark, monkeypatch):
    import random
    import textwrap

    rng = random.Random(4)
    monkeypatch.setattr(L, "HEAVY", 5)  # directories are dealt to several keys
    rows = []
    for i in range(70):
        path = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + rng.choice(["/LICENSE", "/x.txt", "/COPYING.md", "/y.py"])
        code = [" ".join(rng.choice(["the", "of", "x", "software", "use", "license", "free", f"v{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.4:
            ws = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, len(ws) // 5)):
                ws[rng.randrange(len(ws))] = rng.choice(["the", "zzz"])
            code[len(code) // 2 : len(code) // 2] = textwrap.wrap(" ".join(ws), rng.choice([40, 70, 9999]))
        rows.append((i, path.lstrip("/"), "\n".join(code)))
    rows += [(70, None, rows[3][2]), (71, "a/LICENSE", None), (72, "a/b/LICENSE", "license " * 20000), (73, "q/LICENSE", L.TEMPLATES[0][1]), (74, "q/A-LICENSE", L.TEMPLATES[0][1]), (75, "q/r/s.txt", "")]
    files = spark.createDataFrame([*rows, rows[75]], FILES).withColumn("at", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("n", F.lit("x"))
    got = L.scan(files, piece=2).collect()
    assert len(got) == len(rows) + 1
    mine = {r.file_id: (r.own_license, r.similarity and round(r.similarity, 9), r.is_licence_file, r.licence, r.inherited_from) for r in got}
    want = slow_scan([*rows, rows[75]])
    assert mine == want and sum(x[0] is not None for x in want.values()) > 15 and sum(x[4] is not None for x in want.values()) > 10
