import hashlib
import random

from lodepath.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def talks():
    rng = random.Random(3)
    bits = ["hello", "</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n", "<|im_start|>user<|im_sep|>", "<<SYS>>", "é日\U0001f600", "<", "\n\n", "$1 \\1", "<|im_end|"]
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * rng.randint(0, 30)))
        for t in range(1, rng.randint(2, 25)):
            rows.append((c, t, rng.choice(["user", "assistant", "tool", "a<|im_sep|>b\n"]), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    rows += [(90, 1, "user", None), (90, 2, None, "x"), (90, 3, "assistant", None), (None, 1, "user", "q"), (None, 2, "assistant", "a")]
    rows += [(91, 1, "assistant", "long " * 3000), (92, None, "assistant", "b"), (92, None, "assistant", "a"), (92, 1, "user", "u"), (92, 1, "user", "u"), (93, 0, "system", "only")]
    return rows


def expected(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
    return out


def test_read_back_equals_the_rows(spark):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit(9)).withColumn("pos", F.lit("clash"))
    for budget, history in ((64, 16), (512, 128), (20, 0)):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.formatted_digest(df, budget, history).collect()}
        assert got == expected(rows)


def test_windows_keep_to_the_budget_and_repeat_only_masked_history(spark):
    made = chat.windows(spark.createDataFrame(talks(), SCHEMA), 64, 16)
    rows = made.withColumn("turns", chat.turns_of(F.col("formatted"))).orderBy("conv_id", "window").collect()
    longest = {}
    for c, _, _, text in talks():
        longest[c] = max(longest.get(c, 0), len((text or "").split()) + chat.TURN_TOKENS)
    seen = {}
    for r in rows:
        assert len(r.turns) == r.n_context + r.n_turns and r.n_turns > 0
        if r.n_tokens > 64:  # only a turn or a system turn that is too long by itself
            assert longest[r.conv_id] > 64 - 16 - 30
        before = seen.setdefault(r.conv_id, [])
        context = [tuple(t) for t in r.turns[: r.n_context]]
        history = [t for t in context if t[0] != "system"]
        assert history == before[len(before) - len(history) :]
        if r.window and before[0][0] == "system":
            assert context[0] == before[0]
        before += [tuple(t) for t in r.turns[r.n_context :]]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(t[0] == "assistant" for t in r.turns[r.n_context :])


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([("".join(chat.CONTROL) + "\\" + "".join(chat.CONTROL),), ("<<s>>",)], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


def test_no_rows(spark):
    assert chat.formatted_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    rows = [r for r in talks() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = chat.formatted_digest(spark.createDataFrame(rows + probe, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(chat.SQL).fetchall())


def test_history_fills_its_budget_however_many_windows_back(spark):
    """Every window repeats exactly the turns before it that start within the history budget; a long conversation is cut alike."""
    rng = random.Random(12)
    rows = [(1, 0, "system", "s " * 40)] + [(c, t, rng.choice(["user", "assistant"]), f"{t} " * rng.randint(0, 9)) for c in (1, 2) for t in range(1, 400)]
    budget, history = 64, 60
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history).withColumn("turns", chat.turns_of(F.col("formatted")))
    by = {}
    for r in made.orderBy("conv_id", "window").collect():
        by.setdefault(r.conv_id, []).append(r)
    far = 0
    for c, got in by.items():
        assert [r.window for r in got] == list(range(len(got)))
        mine = [(r, t) for k, _, r, t in rows if k == c]
        system = mine[0][0] == "system"
        body = mine[system:]
        sizes = [len(t.split()) + chat.TURN_TOKENS for _, t in body]
        at, n = [sum(sizes[:i]) for i in range(len(body))], 0
        for r in got:
            fresh = r.n_turns - (1 if system and r.window == 0 else 0)
            old = [i for i in range(n) if at[n] - at[i] <= history]
            want = ([mine[0]] if system else []) + [body[i] for i in [*old, *range(n, n + fresh)]]
            assert [tuple(t) for t in r.turns] == want
            far = max(far, len(old))
            n += fresh
        assert n == len(body)
    assert far > 8
