"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `least` words that a document shares with a benchmark item, found by a Karp-Rabin hash that is rolled over
word numbers; a seed is joined with the items that have it, never with its places in them, so a text and items full of one
repeated word cost no more than their lengths. For each document and item whose shared seeds could cover enough, the longest
common run not yet marked is marked again and again until none of `least` words is left. Its length is found by halving, with
Karp-Rabin hashes of that width over what is unmarked. The tiles don't overlap in either text, but may come in any order, so a
passage whose parts were moved is still covered. A document is contaminated by an item whose tiles cover enough of it. Items
of fewer words are found where a document has them whole.

The benchmark is taken in blocks of a bounded number of words, each broadcast to one pass over the documents, so neither
a task nor the driver ever holds more of it than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, trimmed
from lodepath.llm.words import split_words

#: An odd multiplier of the rolling hash, which is taken modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `width` ids: h(i) = sum of (ids[i + k] + 1) base^(width - 1 - k) modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x, h = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + x[k : k + n]
    return h


class Rolling:
    """Karp-Rabin hashes of a sequence for any width: prefix sums of ids times powers of the base, modulo 2^64, brought back to the start of
    each run by the power of the base's inverse."""

    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        with np.errstate(over="ignore"):
            up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (BASE, self.INVERSE))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        self.ids, self.marked = ids, ids < 0

    def free(self) -> int:
        """The length of the longest run of unmarked words."""
        edge = np.flatnonzero(np.diff(np.concatenate([[1], self.marked, [1]]).astype(np.int8)))
        return int((edge[1::2] - edge[::2]).max(initial=0))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where unmarked runs of so many words begin, and their hashes."""
        used = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(used[width:] == used[: len(used) - width])
        return at, (self.sums[at + width] - self.sums[at]) * self.down[at]


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the tiles, in the order in which they are marked.

    The longest unmarked common run goes first, ties to the smaller start in a, then in b; a negative id equals none. At a length,
    runs of equal hashes are met through one list of places in b that is only gone through forward, so a length costs what
    the two sequences are long, and there are no more lengths than tiles.
    """
    x, y, found = Rolling(a), Rolling(b), []
    most = min(x.free(), y.free())
    while most >= least:
        low, width = least - 1, most  # the longest common length is from low to most; the longest of all is tried first
        while low < most:
            if np.isin(x.runs(width)[1], y.runs(width)[1]).any():
                low = width
            else:
                most = width - 1
            width = (low + most + 1) // 2
        if low < least:
            break
        (i, h), (j, g) = x.runs(low), y.runs(low)
        order = np.argsort(g, kind="stable")
        j, g = j[order], g[order]
        here = np.isin(h, g)
        i, first, last = i[here], np.searchsorted(g, h[here]), np.searchsorted(g, h[here], side="right")
        passed: dict[int, int] = {}
        for s, begin, end in zip(i.tolist(), first.tolist(), last.tolist()):
            k = passed.get(begin, begin)
            if x.marked[s : s + low].any():
                continue
            while k < end:
                t = int(j[k])
                k += 1
                if not y.marked[t : t + low].any() and np.array_equal(a[s : s + low], b[t : t + low]):
                    found.append((s, t, low))
                    x.marked[s : s + low] = y.marked[t : t + low] = True
                    break
            passed[begin] = k
        most = min(low - 1, x.free(), y.free())
    return found


class Items:
    """A block of benchmark items: their words as numbers, and which have each run of `least` words."""

    def __init__(self, rows: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.names = [r[0] for r in rows]
        words, at = split_words(pa.array([r[1] for r in rows], pa.string()))
        self.vocab = words.unique()
        ids = pc.index_in(words, value_set=self.vocab).to_numpy()
        self.items = [ids[s:e].astype(np.int64) for s, e in zip(at, at[1:])]
        self.seeds = [rolled(x, least) for x in self.items]
        each = [np.unique(h) for h in self.seeds]
        item = np.concatenate([np.full(len(x), i) for i, x in enumerate(each)] or [np.empty(0, np.int64)])
        all_h = np.concatenate(each or [np.empty(0, np.uint64)])
        order = np.argsort(all_h, kind="stable")
        self.hash, self.item = all_h[order], item[order].astype(np.int64)
        #: Items too short for a seed, by their words.
        self.short: dict[tuple, list[int]] = {}
        for i, x in enumerate(self.items):
            if 0 < len(x) < least:
                self.short.setdefault(tuple(x.tolist()), []).append(i)
        self.shortest = min([least, *map(len, self.short)])

    def whole(self, ids: np.ndarray) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """As matches(), of the items that are too short for a seed."""
        found = []
        for width in sorted({len(x) for x in self.short}):
            h = rolled(ids, width)
            for x in (x for x in self.short if len(x) == width):
                same = [t for t in np.flatnonzero(h == rolled(np.array(x), width)[0]).tolist() if ids[t : t + width].tolist() == list(x)]
                found += [(i, width, width, [(0, same[0], width)]) for i in self.short[x] if same]
        return found

    def matches(self, ids: np.ndarray, coverage: float = 0.0) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item, words, covered, tiles) of each item of which the tiles cover that share or more; -1 in ids: a word of no item."""
        found = self.whole(ids) if self.short else []
        ok = np.convolve(ids >= 0, np.ones(self.least, int), "valid") == self.least if len(ids) >= self.least else np.empty(0, bool)
        at = np.flatnonzero(ok)
        if not len(at) or not len(self.hash):
            return found
        h = rolled(ids, self.least)[at]
        order = np.argsort(h, kind="stable")
        at, (seed, first, times) = at[order], np.unique(h[order], return_index=True, return_counts=True)
        lo, n = np.searchsorted(self.hash, seed), np.searchsorted(self.hash, seed, side="right")
        n -= lo
        pair = np.repeat(np.arange(len(seed)), n)  # each different seed with each item that has it
        item = self.item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        pair, item = pair[order], item[order]
        for i, some in zip(np.unique(item).tolist(), np.split(pair, np.flatnonzero(np.diff(item)) + 1)):
            a = self.items[i]
            if covered(np.flatnonzero(np.isin(self.seeds[i], seed[some])), len(a), self.least).sum() < coverage * len(a):
                continue  # more than all shared seeds no tiles cover
            places = np.concatenate([at[first[k] : first[k] + times[k]] for k in some.tolist()])
            here = np.flatnonzero(covered(places, len(ids), self.least))
            # the stretches with seeds, one after another, a word of no item between them
            gap = np.flatnonzero(np.diff(here) > 1) + 1
            b, back = np.insert(ids[here], gap, -1), np.insert(here, gap, -1)
            got = [(s, int(back[t]), k) for s, t, k in tiles(a, b, self.least)]
            total = sum(x[2] for x in got)
            if got and total >= coverage * len(a):
                found.append((i, len(a), total, got))
        return found


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places lie in a stretch of `width` from one of the starts."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, some at a time: each list has about most_words words, or one longer item."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    some, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(r.t) // 4 + 1
        if some and size + n > most_words:
            yield some
            some, size = [], 0
        some.append((r.i, r.t))
        size += n
    if some:
        yield some


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, coverage, tiles (starts in item and document, length) of each pair of which
    the tiles cover at least the given share of the item.

    Words are lower-cased runs of letters and digits. Null and empty texts share nothing; an item of fewer than `least` words is
    found where a text has it whole, one without words never. Very long texts are read whole. Of runs of one length the first in
    the item, then in the text, is marked first. Repeated documents and items are reported each; a null id is kept. Other
    columns, whatever their names, aren't read. Empty tables: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    schema = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"

    def pass_over(some: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(some, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                out = []
                for name, hits in zip(b.column(0).to_pylist(), in_texts(items, b.column(1), coverage)):
                    out += [(name, items.names[i], n, c, c / n, [dict(zip(("item_start", "doc_start", "length"), t)) for t in got]) for i, n, c, got in hits]
                yield to_batch(out)

        return rows.mapInArrow(trimmed(run), schema)

    found = None
    for some in blocks(benchmark, block_words):
        made = pass_over(some)
        found = made if found is None else found.unionByName(made)
    return spark.createDataFrame([], schema) if found is None else found


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])))]
)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def in_texts(items: Items, texts: pa.Array, coverage: float) -> list[list]:
    """items.matches() of each text of a batch; word numbers are looked up for the batch at once."""
    words, at = split_words(texts)
    ids = pc.fill_null(pc.index_in(words, value_set=items.vocab), -1).to_numpy().astype(np.int64)
    # a text with no run of so many known words can't hold a seed or a short item; most texts end here
    known, width = np.concatenate([[0], np.cumsum(ids >= 0)]), items.shortest
    run = np.zeros(len(ids) + 1, bool)
    if len(ids) >= width:
        run[: len(ids) - width + 1] = known[width:] - known[:-width] == width
    total = np.concatenate([[0], np.cumsum(run)])
    return [items.matches(ids[s:e], coverage) if total[e] > total[s] else [] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """docs without the contaminated rows, all columns kept, whatever their names; a row is judged by its own text, read whole.

    Null and empty texts share nothing and stay, repeated rows share their fate, and without a benchmark all stay. No rows: none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    left = docs
    for some in blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(Items(some, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                yield b.filter(pa.array([not hits for hits in in_texts(items, b.column("text"), coverage)], pa.bool_()))

        left = left.withColumn("text", F.col("text").cast("string")).mapInArrow(trimmed(run), left.schema)
    return left
