"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into cells of a stride; the turns inside a cell make one window and a turn
that crosses a cell's end makes a window of its own, so that no window takes more new tokens than the stride unless a
single turn does. Every window starts with the system turn and repeats the turns just before it as far as the history
budget goes, however many windows back; both are masked wherever they are repeated, so each assistant text is under the
loss exactly once.

No step holds a conversation: rows are dealt by ranges of conversation, turn and text, sums and numbers are taken within
a range and then moved by the totals of the ranges before, and a turn finds the windows that repeat it by joining their
starts in steps of the history budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.llm.session import WORD, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a model may take for control; none of them survives inside an escaped text.
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Tokens that the marks of a turn are counted as.
TURN_TOKENS = 4


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in s)


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    pattern = "|".join(f"(?<={_literal(c[0])})(?={_literal(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"\\")


def unescape(text: Column) -> Column:
    """The inverse of escape: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def after(rows: DataFrame, parts: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with running sums before each row of its conversation: sums has new column -> column. `parts` numbers ascending parts of
    a conversation, of which each fits a task; the totals of a conversation's parts are few."""
    inside = Window.partitionBy("conv_id", parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", parts).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select(F.col("conv_id").alias("c_"), F.col(parts).alias("p_"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n + "_") for n in sums])
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    met = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col(parts) == F.col("p_")))
    return met.withColumns({n: F.col(n) + F.col(n + "_") for n in sums}).drop("c_", "p_", *[n + "_" for n in sums])


def windows(turns: DataFrame, budget: int = 512, history: int = 128, system_role: str = "system", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> one row for each window: conv_id, window (from 0), n_context (turns at its start that
    are repeated), n_turns (new ones), n_tokens, formatted, loss_spans (start and length in code points of formatted).

    Rows go by turn (null first), then role and text, so ties and repeated rows have an order. Null roles and texts are
    empty; a null conv_id is a conversation like others. History is all turns before a window that end within the history budget.
    A turn longer than the stride is whole in a window of its own, which then exceeds the budget; a system turn that
    leaves less than an eighth of the budget makes its windows exceed it too: n_tokens says so. Very long turns are kept
    whole. No rows: no windows. Other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + TURN_TOKENS).cast("long"))
    # ranges go by the first characters of a text; rows that are alike in those stay together and are sorted by all of it. What
    # follows works on numbers only, and meets the texts again at the end
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    told = stored(dealt.withColumn("part", F.spark_partition_id().cast("long")).withColumn("pos", F.monotonically_increasing_id()), "turns")
    rows = told.select("conv_id", "part", "pos", "tokens", (F.col("role") == system_role).alias("leads"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct("pos", "leads", "tokens")).alias("f")).where("f.leads")
    first = first.select(F.col("conv_id").alias("c_"), F.col("f.pos").alias("system_pos"), F.col("f.tokens").alias("system_tokens"))
    rows = after(rows, "part", ["pos"], {"at": "tokens"}).join(first, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_", "part")
    rows = rows.withColumn("is_system", F.coalesce(F.col("pos") == F.col("system_pos"), F.lit(False)))
    rows = rows.withColumn("system_tokens", F.coalesce("system_tokens", F.lit(0).cast("long")))
    rows = rows.withColumn("at", F.greatest(F.col("at") - F.col("system_tokens"), F.lit(0)))
    rows = rows.withColumn("stride", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(max(1, budget // 8))))
    cell = F.floor(F.col("at") / F.col("stride"))
    crosses = (F.col("at") + F.col("tokens") > (cell + 1) * F.col("stride")).cast("long")
    rows = stored(rows.select("conv_id", "pos", "at", "is_system", F.when(~F.col("is_system"), cell * 2 + crosses).alias("key")), "placed")

    # windows are numbered by their keys; a conversation of a system turn alone has one window too
    opens = rows.groupBy("conv_id", "key").agg(F.min("at").alias("opens_at"))
    alone = rows.groupBy("conv_id").agg(F.count_if("is_system").alias("s"), F.count("*").alias("n")).where("s = n")
    opens = opens.where("key IS NOT NULL").unionByName(alone.select("conv_id", F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("opens_at")))
    opens = opens.withColumn("part", F.floor(F.col("key") / 4096)).withColumn("one", F.lit(1).cast("long"))
    opens = stored(after(opens, "part", ["key"], {"window": "one"}).select("conv_id", "key", "opens_at", "window"), "opens")
    named = opens.toDF("c_", "k_", "opens_at", "window")
    same = F.col("conv_id").eqNullSafe(F.col("c_"))

    new = rows.where("NOT is_system").join(named, same & (F.col("key") == F.col("k_"))).select("pos", "window", F.lit(True).alias("new"))
    # a window repeats the turns that start no more than the history budget before it: its start is in their step or the next
    step = max(history, 1)
    steps = F.explode(F.array(F.floor(F.col("at") / step), F.floor(F.col("at") / step) + 1)).alias("s")
    back = rows.where("NOT is_system").select("*", steps)
    starts = named.withColumn("s_", F.floor(F.col("opens_at") / step))
    near = (F.col("opens_at") > F.col("at")) & (F.col("opens_at") - F.col("at") <= history)
    old = back.join(starts, same & (F.col("s") == F.col("s_")) & near).select("pos", "window", F.lit(False).alias("new"))
    system = rows.where("is_system").join(named, same).select("pos", "window", (F.col("window") == 0).alias("new"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head")
    texts = told.select("conv_id", "pos", "role", "tokens", head, escape(F.col("text")).alias("body"))
    pieces = texts.join(new.unionByName(old).unionByName(system), "pos").withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    in_window = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(in_window), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))
    return (
        pieces.groupBy("conv_id", "window")
        .agg(
            F.count_if(~F.col("new")).cast("int").alias("n_context"),
            F.count_if("new").cast("int").alias("n_turns"),
            F.sum("tokens").alias("n_tokens"),
            F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
            F.array_sort(F.collect_list(F.when(F.col("new") & (F.col("role") == loss_role), span))).alias("loss_spans"),
        )
        .select("conv_id", "window", "n_context", "n_turns", "n_tokens", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a window, unescaped: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, _literal(END) + "\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, SEP, 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(role(p), F.lit(len(START) + 1), F.length(p))).alias("role"),
            unescape(F.substring(p, F.length(role(p)) + len(SEP) + 1, F.length(p))).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What windows() wrote, read back by conversation: counts and digests of the turns and of the text under the mask.

    Only new turns count, so a conversation that is cut, repeated or masked wrongly has other digests than its rows.
    """
    turns = turns_of(F.col("formatted"))
    fresh = F.filter(turns, lambda t, i: i >= F.col("n_context"))
    # the system turn stands first; in window 0 nothing is repeated
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    parts = formatted.select("conv_id", "window", F.size(fresh).alias("n"), said.alias("said"), learnt.alias("learnt"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    said, learnt = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learnt"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def formatted_digest(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Write the windows to the shared folder, read them back and digest them."""
    return digest(stored(windows(turns, budget, history), "chat"))


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: DuckDB's form of op9 with a budget of 512 and a history of 128: digests from the rows, lengths from the windows' rule.
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {TURN_TOKENS} AS tokens,
  length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START + SEP + END) + 1} AS chars FROM t),
s AS (SELECT *, pos = 1 AND role = 'system' AS sys, coalesce(max(tokens) FILTER (pos = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS sys_tokens,
  coalesce(sum(CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre FROM r),
k AS (SELECT *, greatest(384 - sys_tokens, 64) AS stride FROM s),
c AS (SELECT *, CASE WHEN NOT sys THEN floor(pre / stride)::BIGINT * 2 + (pre + tokens > (floor(pre / stride)::BIGINT + 1) * stride)::INTEGER END AS key FROM k),
o AS (SELECT *, coalesce(key <> lag(key) OVER (PARTITION BY conv_id ORDER BY pos), key IS NOT NULL) AS opens FROM c),
w AS (SELECT *, greatest(sum(opens::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos) - 1, 0)::BIGINT AS win FROM o),
op AS (SELECT conv_id, win, pre FROM w WHERE opens),
again AS (SELECT w.conv_id, w.pos, count(*) AS n FROM w JOIN op ON op.conv_id = w.conv_id AND op.pre > w.pre AND op.pre - w.pre <= 128 WHERE NOT sys GROUP BY ALL),
n AS (SELECT w.*, CASE WHEN sys THEN max(w.win) OVER (PARTITION BY w.conv_id) + 1 ELSE 1 + coalesce(again.n, 0) END AS times, max(w.win) OVER (PARTITION BY w.conv_id) + 1 AS windows
  FROM w LEFT JOIN again ON again.conv_id = w.conv_id AND again.pos = w.pos)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * times)::BIGINT AS formatted_chars, max(windows)::BIGINT AS n_windows
FROM n GROUP BY conv_id
"""
