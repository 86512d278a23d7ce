"""Paired bootstrap tests of F1 differences."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodepath.operators.evaluate import f1

CONFUSION = ("tp", "fp", "fn")


PRIME = 2147483647
#: Tries of a rejection; gaps are twice as many.
TRIES = 40
#: log(k!) less Stirling's formula, for k from 0 to 9.
RESTS = [math.lgamma(k + 1) - (0.5 * math.log(2 * math.pi) + (k + 0.5) * math.log(k + 1) - (k + 1)) for k in range(10)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def absorbed(state: Column, part: Column) -> Column:
    """The state of a draw after one more part: two squarings modulo the prime, so that neighbouring places have unrelated draws.
    Integers below 2^63 only, so any engine can repeat it."""
    last = lambda x: F.pmod(x * x + 48271, F.lit(PRIME))
    return let(F.pmod(state * 48271 + part * 69069 + 1, F.lit(PRIME)), lambda x: let(F.pmod(x * x + x * 69621 + 11, F.lit(PRIME)), last))


def hash_state(*parts: Column) -> Column:
    return F.aggregate(F.array(*[p.cast("long") for p in parts]), F.lit(12345).cast("long"), absorbed)


def hash_draw(*parts: Column) -> Column:
    """A deterministic draw from [0, PRIME)."""
    return F.pmod(hash_state(*parts) * 48271, F.lit(PRIME))


def uniform(state: Column, part: Column) -> Column:
    """A draw within (0, 1)."""
    return (F.pmod(absorbed(state, part) * 48271, F.lit(PRIME)) + 0.5) / F.lit(float(PRIME))


def stirling_rest(k: Column) -> Column:
    """What Stirling's formula for the logarithm of k! leaves, with k + 1 in it: a table for small k, then the series."""
    x = k.cast("double") + 1
    rest = (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x
    return F.when(k < len(RESTS), F.element_at(F.array(*[F.lit(r) for r in RESTS]), F.least(k, F.lit(len(RESTS) - 1)).cast("int") + 1)).otherwise(rest)


def _by_gaps(n: Column, p: Column, state: Column) -> Column:
    """Successes among n trials: the gaps between them are geometric draws, counted while their sum is within n."""
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("found"))

    def further(s: Column, k: Column) -> Column:
        gap = F.floor(F.log(uniform(state, k)) / F.log(1 - p)) + 1
        more = let(s["at"] + gap, lambda at: F.struct(at.alias("at"), (s["found"] + (at <= n).cast("long")).alias("found")))
        return F.when(s["at"] > n, s).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(2 * TRIES).cast("long")), start, further)["found"]


def _by_rejection(n: Column, p: Column, state: Column) -> Column:
    """Transformed rejection with squeeze (Hormann 1993), for p up to a half and a mean of ten or more."""
    size = F.sqrt(n * p * (1 - p))
    given = F.struct(n.alias("n"), p.alias("p"), state.alias("state"), size.alias("size"), (2.53 * size + 1.15).alias("b"), F.floor((n + 1) * p).alias("mode"), (p / (1 - p)).alias("odds"))

    def drawn(g: Column) -> Column:
        n, b, mode, odds = g["n"], g["b"], g["mode"], g["odds"]
        a, quick, alpha = 0.0248 * b + 0.01 * g["p"] - 0.0873, 0.92 - 4.2 / b, (2.83 + 5.1 / b) * g["size"]

        def fits(x: Column, edge: Column, v: Column) -> Column:
            most = (mode + 0.5) * F.log((mode + 1) / (odds * (n - mode + 1))) + (n + 1) * F.log((n - mode + 1) / (n - x + 1)) + (x + 0.5) * F.log(odds * (n - x + 1) / (x + 1))
            most = most + stirling_rest(mode) + stirling_rest(n - mode) - stirling_rest(x) - stirling_rest(n - x)
            slow = F.log(v * alpha / (a / (edge * edge) + b)) <= most
            return F.when((x < 0) | (x > n), False).when((edge >= 0.07) & (v <= quick), True).otherwise(slow)

        def once(k: Column) -> Column:
            pair = F.struct((uniform(g["state"], 2 * k - 1) - 0.5).alias("u"), uniform(g["state"], 2 * k).alias("v"))
            at = lambda t: F.struct(F.floor((2 * a / (0.5 - F.abs(t["u"])) + b) * t["u"] + (n * g["p"] + 0.5)).alias("x"), (0.5 - F.abs(t["u"])).alias("edge"), t["v"].alias("v"))
            return let(let(pair, at), lambda t: F.when(fits(t["x"], t["edge"], t["v"]), t["x"]).otherwise(F.lit(-1).cast("long")))

        tries = F.sequence(F.lit(1).cast("long"), F.lit(TRIES).cast("long"))
        found = F.aggregate(tries, F.lit(-1).cast("long"), lambda done, k: F.when(done >= 0, done).otherwise(once(k)))
        return let(found, lambda x: F.when(x >= 0, x).otherwise(mode))

    return let(given, drawn)


def binomial(n: Column, p: Column, state: Column) -> Column:
    """A deterministic draw from the binomial distribution itself, whatever n is, by bounded work: from geometric gaps where the
    rarer outcome is expected less than ten times, by transformed rejection else. Both are exact up to the grain of the draws
    (31 bits) and of doubles; that 80 gaps or 40 tries don't do has a probability below 1e-20, and then the count is 80 or the mode.
    Nulls give null."""
    given = F.struct(n.alias("n"), F.least(p, 1 - p).alias("rare"), state.alias("state"))
    choose = lambda g: F.when(g["n"] * g["rare"] < 10, _by_gaps(g["n"], g["rare"], g["state"])).otherwise(_by_rejection(g["n"], g["rare"], g["state"]))
    drawn = let(let(given, choose), lambda x: F.when(p > 0.5, n - x).otherwise(x))
    nothing = (n <= 0) | (p <= 0)
    return F.when(n.isNull() | p.isNull(), F.lit(None).cast("long")).when(nothing, F.lit(0).cast("long")).when(p >= 1, n).otherwise(drawn)


def resampled(aligned: DataFrame, draws: int, stratified: bool = True) -> DataFrame:
    """(draw, f1_a, f1_b): F1 of two runs over examples drawn with replacement, the same ones for both.

    aligned: (id, true, a, b) of one comparison. Examples are equal in all that matters if they agree in truth and
    predictions, so a draw is multinomial over at most eight cells: the cells take their counts in turn, each a binomial of
    what is left. Rows are draws; the examples are read once, to count the cells. Positives and negatives are drawn apart
    unless a class is empty.
    """
    spark = aligned.sparkSession
    cells = [(t, a, b) for t in (True, False) for a in (True, False) for b in (True, False)]
    n = F.array(*[F.count_if((F.col("true") == t) & (F.col("a") == a) & (F.col("b") == b)) for t, a, b in cells])
    # one row of eight counts, by its definition; each draw is a row of its own
    rows = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(aligned.agg(n.alias("n"))))
    whole = lambda *i: sum((F.col("n")[k] for k in i), F.lit(0).cast("long"))
    two = (whole(0, 1, 2, 3) > 0) & (whole(4, 5, 6, 7) > 0) & F.lit(stratified)
    rows = rows.select("draw", "n", two.alias("two"), F.when(two, whole(0, 1, 2, 3)).otherwise(whole(*range(8))).alias("first"), whole(4, 5, 6, 7).alias("later"))

    def counted(s: Column, i: Column) -> Column:
        again = F.col("two") & (i == 4)
        now = F.struct(F.when(again, F.col("later")).otherwise(s["left"]).alias("left"), F.when(again, F.col("later")).otherwise(s["mass"]).alias("mass"))
        of = lambda t: binomial(t["left"], F.when(t["mass"] > 0, F.col("n")[i] / t["mass"]).otherwise(F.lit(0.0)), hash_state(F.col("draw"), i))
        after = lambda t, w: F.struct((t["left"] - w).alias("left"), (t["mass"] - F.col("n")[i]).alias("mass"), F.array_append(s["w"], w).alias("w"))
        return let(now, lambda t: let(of(t), lambda w: after(t, w)))

    start = F.struct(F.col("first").alias("left"), F.col("first").alias("mass"), F.array().cast("array<long>").alias("w"))
    rows = rows.select("draw", F.aggregate(F.array(*[F.lit(i) for i in range(8)]), start, counted)["w"].alias("w"))
    total = lambda x, t, p: sum((F.col("w")[i] for i, c in enumerate(cells) if c[0] == t and c[1 + (x == "b")] == p), F.lit(0))
    return rows.select("draw", *[f1(total(x, True, True), total(x, False, True), total(x, True, False)).alias(f"f1_{x}") for x in "ab"])


def bootstrap(aligned: DataFrame, draws: int = 10_000, alpha: float = 0.05, stratified: bool = True) -> DataFrame:
    """One row: both F1, their difference, its percentile interval, and the two-sided p of the centred differences."""
    t = F.col("true")
    counts = [F.count_if(c).alias(f"{n}_{x}") for x in "ab" for n, c in (("tp", t & F.col(x)), ("fp", ~t & F.col(x)), ("fn", t & ~F.col(x)))]
    base = aligned.agg(F.count("*").alias("num_examples"), *counts)
    base = base.select("num_examples", *[f1(*[F.col(f"{n}_{x}") for n in CONFUSION]).alias(f"f1_{x}") for x in "ab"]).withColumn("delta", F.col("f1_a") - F.col("f1_b"))
    each = resampled(aligned, draws, stratified).select((F.col("f1_a") - F.col("f1_b")).alias("d")).crossJoin(F.broadcast(base.select("delta")))
    test = each.agg(
        F.percentile("d", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"),
        ((F.count_if(F.abs(F.col("d") - F.col("delta")) >= F.abs("delta")) + 1) / F.lit(draws + 1.0)).alias("p_value"),
    )
    return base.crossJoin(test).select("num_examples", "f1_a", "f1_b", "delta", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "p_value")


def bootstrap_numpy(comparisons: DataFrame, draws: int = 10_000, seed: int = 42, alpha: float = 0.05, chunk: int = 1000) -> DataFrame:
    """As bootstrap(), for many comparisons (comparison, true, a, b, n: counts of equal examples), with numpy's generator.

    The input of a comparison is at most eight rows; draws are multinomial over those cells within each class.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        t, a, b, n = (pdf[c].to_numpy() for c in ("true", "a", "b", "n"))
        score = lambda tp, fp, fn: np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)
        of = lambda w, x: score(w @ (t & x), w @ (~t & x), w @ (t & ~x))
        t, a, b = t.astype(bool), a.astype(bool), b.astype(bool)
        delta = float(of(n[None], a)[0] - of(n[None], b)[0])
        deltas = []
        for at in range(0, draws, chunk):
            size = min(chunk, draws - at)
            w = np.zeros((size, len(n)), np.int64)
            for c in (True, False):
                mine = np.flatnonzero(t == c)
                total = int(n[mine].sum())
                if total:
                    w[:, mine] = rng.multinomial(total, n[mine] / total, size)
            deltas.append(of(w, a) - of(w, b))
        d = np.concatenate(deltas)
        low, high = np.percentile(d, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        p = (np.sum(np.abs(d - delta) >= abs(delta)) + 1) / (draws + 1)
        return pd.DataFrame({"comparison": [pdf["comparison"].iloc[0]], "delta": [delta], "ci_low": [low], "ci_high": [high], "p_value": [p]})

    return comparisons.groupBy("comparison").applyInPandas(run, "comparison string, delta double, ci_low double, ci_high double, p_value double")


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p values times the number of tests, at most 1."""
    n = tests.agg(F.count("*").alias("m_"))
    out = tests.crossJoin(F.broadcast(n)).withColumn("p_adjusted", F.least(F.col("p_value") * F.col("m_"), F.lit(1.0)))
    return out.withColumn("significant", F.col("p_adjusted") < alpha).drop("m_")
