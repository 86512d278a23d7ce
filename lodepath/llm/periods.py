"""Periodic runs of words by Main and Lorentz: divide and conquer over interned word ids.

A run that lies in a segment and crosses its midpoint m has two periods p or more on one side of m, so the word at m returns at
m + p, or the word before m at m - 1 - p. How far the two copies agree, forward and backward, gives the run of each such p.
All segments of a depth, of all texts of a batch, are handled together: pairs that part within STEPS words on both sides are
decided at once, and for a segment with pairs that agree longer Z-functions at its midpoint say exactly how long, in linear
time. So a text of n words costs O(n log n), however repetitive. Runs that reach beyond a segment belong to the
segment that holds them; intervals found twice or with several periods keep the smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, trimmed
from lodepath.llm.words import AS_IS, coded_words

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words that two copies are compared for, all at once, before Z-functions are made.
STEPS = 32


def z_function(s: list[int], upto: int) -> list[int]:
    """How long s and its part from i on agree, for i below upto (at 0: all)."""
    n, z = len(s), [0] * min(len(s), max(upto, 1))
    z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        if k >= 0 and i + k >= right:
            k = max(right - i, 0)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def agree(w: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from x and y on, going by step, are the same; up to `most`. Words outside texts equal no other."""
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    for t in range(most):
        live = live[w[x[live] + step * t] == w[y[live] + step * t]]
        if not len(live):
            break
        out[live] = t + 1
    return out


def after(s: list[int], m: int, most: int) -> tuple[list[int], list[int]]:
    """For p up to `most`: how long s[m:] and s[m + p:] agree, and how long s[:m] and s[:m + p] do backward. By Z-functions."""
    ahead = z_function(s[m:], most + 1)
    x = s[:m][::-1]
    y = s[: m + most][::-1]  # the word at m + p - 1 is at most - p
    back = z_function([*x, -(1 << 62), *y], m + 1 + most)
    return ahead, [0, *(back[m + 1 + most - p] for p in range(1, most + 1))]


def found_runs(w: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and end, of texts that are concatenated: text i is w[at[i]:at[i + 1]]."""
    n_texts = len(at) - 1
    text = np.repeat(np.arange(n_texts), np.diff(at))
    # a word that equals no other stands before, between and after the texts
    spaced = np.empty(len(w) + n_texts + 1, np.int64)
    spaced[at + np.arange(n_texts + 1)] = -1 - np.arange(n_texts + 1)
    spaced[np.arange(len(w)) + text + 1] = w
    w, left, right = spaced, at[:-1] + np.arange(n_texts) + 1, at[1:] + np.arange(n_texts) + 1
    found = [np.empty((0, 3), np.int64)]
    while True:
        big = right - left >= max(least, times)
        left, right = left[big], right[big]
        if not len(left):
            break
        mid = (left + right) // 2
        for side in (1, -1):
            most = np.minimum((right - mid if side == 1 else mid - left) // 2, (right - left) // times)
            node = np.repeat(np.arange(len(left)), most)
            p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
            m = mid[node]
            same = w[m + p] == w[m] if side == 1 else w[m - 1 - p] == w[m - 1]
            node, p, m = node[same], p[same], m[same]
            # of the side with two periods or more, a whole period agrees with the next
            x, y = (m, m + p) if side == 1 else (m - p, m)
            first = agree(w, x, y, 1, STEPS) if side == 1 else agree(w, x - 1, y - 1, -1, STEPS)
            keep = first >= np.minimum(p, STEPS)
            node, p, x, y, first = node[keep], p[keep], x[keep], y[keep], first[keep]
            second = agree(w, x - 1, y - 1, -1, STEPS) if side == 1 else agree(w, x, y, 1, STEPS)
            ahead, back = (first, second) if side == 1 else (second, first)
            short = (first < STEPS) & (second < STEPS)
            found.append(np.stack([x - back, y + ahead, p], axis=1)[short])
            node, p = node[~short], p[~short]
            for k in np.unique(node):
                l, r, m = int(left[k]), int(right[k]), int(mid[k])
                mine = p[node == k]
                s = w[l:r].tolist()
                ahead, back = after(s, m - l, int(mine.max())) if side == 1 else after(s[::-1], r - m, int(mine.max()))
                f, b = np.array(ahead)[mine], np.array(back)[mine]
                runs = np.stack([m - b, m + mine + f, mine], axis=1) if side == 1 else np.stack([m - mine - f, m + b, mine], axis=1)
                start, end = runs[:, 0], runs[:, 1]
                inside = (w[start - 1] != w[start - 1 + mine]) & (w[end] != w[end - mine])
                found.append(runs[inside])
        left, right = np.concatenate([left, mid]), np.concatenate([mid, right])
        found = [np.concatenate(found)]
        long = found[0][:, 1] - found[0][:, 0] >= np.maximum(least, times * found[0][:, 2])
        found = [found[0][long]]
    runs = found[0][np.lexsort(found[0].T[[2, 1, 0]])]
    new = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[: len(runs)]
    runs = runs[new]
    runs[:, :2] -= np.searchsorted(at + np.arange(n_texts + 1), runs[:, :1], side="right")
    return runs


def planted(codes: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a document as op13 wants them: of one in ten, all from a place on repeat those of a period."""
    n = len(codes)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return codes
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return codes[np.where(i < a, i, a + (i - a) % p)]


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periods(docs: DataFrame, plant: bool = False, least: int = LEAST, times: int = TIMES, text_col: str = "text") -> DataFrame:
    """Of each document: doc_id, runs (start, length and period of each, by start, then period) and collapsed, its words but for
    those that a run repeats, joined by a space. With `plant`, one document in ten is made periodic first.

    Nulls: a null text has no words and no runs; a null id is kept (and plants nothing). Empty texts likewise. Long texts are read
    whole; a text's runs don't depend on its neighbours in a batch. Of an interval with several periods the least counts.
    Repeated rows give repeated rows. An empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, codes, at, _, _ = coded_words(b.column(1).cast(pa.binary()).to_pylist(), AS_IS)
            spelt = np.array([*words.to_pylist(), b""], object)
            if plant and b.num_rows:
                codes = np.concatenate([planted(codes[s:e], i) for i, s, e in zip(b.column(0).to_pylist(), at, at[1:])])
            at = at[: b.num_rows + 1]
            runs = found_runs(codes, at, least, times)
            change = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(codes) + 1) - np.bincount(runs[:, 1], minlength=len(codes) + 1)
            kept = np.cumsum(change)[:-1] == 0
            texts = [b" ".join(spelt[codes[s:e][kept[s:e]]].tolist()) for s, e in zip(at, at[1:])]
            first = np.searchsorted(runs[:, 0], at)
            text = np.repeat(np.arange(len(at) - 1), np.diff(first))
            runs = runs[np.lexsort([runs[:, 2], runs[:, 0]])]
            parts = [pa.array(x.astype(np.int64)) for x in (runs[:, 0] - at[text], runs[:, 1] - runs[:, 0], runs[:, 2])]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(trimmed(run), SCHEMA)


def digest(made: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of the list of runs and of the collapsed text."""
    runs = F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))
    rows = made.select("*", F.array_min(runs).alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.size")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.size div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
