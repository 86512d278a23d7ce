"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table's hash of a vector is floor((a . v + b) / w) for a few Gaussian directions a. A query looks into the bucket it falls
in and into buckets perturbed by one step in some coordinates, in the order of their estimated success: a query ranks its
distances to the borders, and sets of ranks are tried by the expected sum of squares, least first. What the tables offer is
merged and ranked by exact distance.

Buckets route the work. A row of the index goes, for each table, to the part that its bucket's key falls in; a query goes to the
parts that its probes fall in, with the keys it looks for there. Index and queries of a part meet in one row of a join,
which holds a bounded piece of each: a part that holds too many rows, such as a hot bucket, is salted, and its queries are
dealt to every piece. A piece gives each query its best few only, so no pair is ever made into a row.

An index row is a different vector with the least ids that have it, so copies are hashed and compared once. The number of
probes is fitted to a bounded sample: the least that finds enough of the sample's own neighbours, which are further off than
those among all rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, stored

#: Vectors that width and probes are fitted to, queries among them, the recall that probes have to reach there, and the most probes.
SAMPLE, ASKED, RECALL, MOST_PROBES = 2000, 200, 0.95, 4096
#: Rows of the index, and queries, that meet in one row of the join.
PIECE, QUERIES = 8192, 2048


class Tables:
    """Directions, offsets and key multipliers. The width is a multiple of the median distance in a bounded sample."""

    def __init__(self, dim: int, spread: float, tables: int = 4, hashes: int = 10, width: float = 1.77, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.shape = (tables, hashes)
        self.width = width * spread
        self.a = rng.normal(size=(dim, tables * hashes))
        self.b = rng.uniform(0, self.width, tables * hashes)
        self.mult = rng.integers(1, 1 << 62, size=(tables, hashes)).astype(np.uint64)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ self.a + self.b) / self.width).reshape(-1, *self.shape)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for each table; vectors that share cells share it."""
        return (cells.astype(np.int64).view(np.uint64) * self.mult).sum(axis=-1, dtype=np.uint64)

    def probes(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """(vectors, tables, most) keys: the own bucket first, then perturbed ones in estimated success order."""
        sets = template(self.shape[1], most)
        zero = np.zeros(1, np.uint64)
        steps = np.concatenate([zero - self.mult, self.mult], axis=1)
        out = np.empty((len(vectors), self.shape[0], len(sets)), np.uint64)
        for i, v in enumerate(vectors):
            place = self.places(v[None])[0]
            cell = np.floor(place)
            left = place - cell
            order = np.argsort(np.concatenate([left, 1 - left], axis=1), axis=1, kind="stable")
            ranked = np.concatenate([np.take_along_axis(steps, order, axis=1), np.zeros((len(order), 1), np.uint64)], axis=1)
            out[i] = self.keys(cell)[:, None] + ranked[:, sets].sum(axis=2, dtype=np.uint64)
        return out


@functools.lru_cache
def template(hashes: int, most: int) -> np.ndarray:
    """The sets of steps to try, as ranks of the 2 * hashes border distances, padded with 2 * hashes: the empty set, then by the
    expected sum of squares of the distances at those ranks. The order is the same for all queries; what stands at a rank is
    each query's own. Rank r and its mirror are the two steps of one coordinate, so no set holds both."""
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = np.arange(m + 1, 2 * m + 1)
    far = 1 - (2 * m + 1 - k) / (m + 1) + (2 * m + 1 - k) * (2 * m + 2 - k) / (4 * (m + 1) * (m + 2))
    axis = np.minimum(np.arange(2 * m), 2 * m - 1 - np.arange(2 * m))
    sets = [(), *itertools.islice(perturbations(np.concatenate([near, far]), axis), most - 1)]
    out = np.full((len(sets), max(map(len, sets)) or 1), 2 * m)
    for i, s in enumerate(sets):
        out[i, : len(s)] = s
    return out


def perturbations(cost: np.ndarray, axis: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Sets of positions in ascending costs, by ascending sum; sets that step both ways along an axis are left out."""
    queue = [(float(cost[0]), (0,))]
    while queue:
        total, chosen = heapq.heappop(queue)
        axes = axis[list(chosen)].tolist()
        if len(set(axes)) == len(axes):
            yield chosen
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(queue, (total - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (total + float(cost[last + 1]), (*chosen, last + 1)))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that aren't null or zero and hold no null and no NaN or infinity; floats stay floats, all else is double."""
    v, kind = F.col("v"), rows.schema[vector_col].dataType.simpleString()
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return plain.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, dim) if len(lists) else np.empty((0, dim))


def fitted_probes(tables: Tables, sample: np.ndarray, k: int) -> int:
    """The least power of two of probes that finds RECALL of the k nearest neighbours, in the sample, of ASKED of its vectors."""
    asked = sample[:ASKED]
    d = ((asked**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1)[None]) - 2 * asked @ sample.T
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    keys = tables.keys(np.floor(tables.places(sample)))
    first = np.full(near.shape, MOST_PROBES)  # the number of the probe that finds a neighbour first
    for i, v in enumerate(asked):
        looked = tables.probes(v[None], MOST_PROBES)[0]
        for x in range(tables.shape[0]):
            order = np.argsort(looked[x], kind="stable")
            at = np.minimum(np.searchsorted(looked[x], keys[near[i], x], sorter=order), len(order) - 1)
            hit = looked[x][order[at]] == keys[near[i], x]
            first[i] = np.where(hit, np.minimum(first[i], order[at]), first[i])
    if not first.size:
        return 1
    needed = int(np.sort(first.ravel())[min(int(np.ceil(RECALL * first.size)), first.size) - 1]) + 1
    return min(1 << int(np.ceil(np.log2(needed))), MOST_PROBES)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, probes: int | None = None, piece: int = PIECE, queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding", **table_options) -> DataFrame:
    """(query_id, rank, vec_id, score, offered): the k nearest found for each row whose id is divisible by `every`, among all rows
    but those of its own id; by distance, ties to the smaller id; all of them if there are fewer. offered is the number of
    index rows that the tables offered, once for each table that did.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most.
    A null id is neither query nor candidate. Copies of a vector are searched once and ranked by id: only the k + 1 least
    ids of a vector can be among the k nearest, so no more are carried. Vectors are known by a 64-bit hash. Repeated rows are
    candidates each. A query of which the buckets hold fewer than k others is compared with all rows. Empty tables give no
    rows. Scores are exact, in double precision. Other columns are not read.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col).where("id IS NOT NULL")
    element = good.schema["v"].dataType.simpleString()
    # the width and the probes are fitted to a bounded sample: the SAMPLE vectors with the least hashes
    sample = good.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, offered long")
    sizes, counts = np.unique([len(r.v) for r in sample], return_counts=True)
    dim = int(sizes[counts.argmax()])
    some = np.unique(np.array([r.v for r in sample if len(r.v) == dim], np.float64), axis=0)
    some = np.random.default_rng(1).permutation(some)
    gaps = np.sqrt(np.maximum(((some[:200, None] - some[None, :200]) ** 2).sum(axis=2), 0))
    gaps = gaps[gaps > 0]
    tables = Tables(dim, float(np.median(gaps)) if len(gaps) else 1.0, **table_options)
    n_probes = probes or fitted_probes(tables, some, k)
    spread = spark.sparkContext.broadcast(tables)
    good = good.where(F.size("v") == dim)
    bounded_batches(spark)

    least = Window.partitionBy("v").orderBy("id")
    kept = good.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    reps = kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.xxhash64("v"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = spread.value
        for b in batches:
            keys = t.keys(np.floor(t.places(matrix(b.column(0), dim).astype(np.float64))))
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))], names=["v", "ids", "rep", "keys"])

    index = stored(reps.mapInArrow(hashed, f"v {element}, ids array<long>, rep long, keys array<long>"), "index")
    asked = stored(good.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("q"), "v"), "asked")
    wanted = stored(asked.groupBy("q").agg(F.first("v").alias("v")), "wanted")
    n_parts = max(1, -(-index.count() // piece))
    n_queries = wanted.count()

    def search(wanted: DataFrame, tables_: int, most: int, probed: bool) -> DataFrame:
        """(q, rep, d, ids, offered) of the best k + 1 index rows in each piece, for each query."""
        placed = index.select("rep", "ids", "v", F.posexplode(F.slice("keys", 1, tables_)).alias("t", "key"))
        placed = placed.withColumn("part", F.pmod("key", F.lit(n_parts)))
        counts = index.select(F.posexplode(F.slice("keys", 1, tables_)).alias("t", "key")).groupBy("t", F.pmod("key", F.lit(n_parts)).alias("part")).count()
        salts = stored(counts.select("t", "part", F.ceil(F.col("count") / F.lit(2 * piece)).alias("salts")), "salts")
        placed = placed.join(salts, ["t", "part"]).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("salts")))
        cells = placed.groupBy("t", "part", "salt").agg(F.collect_list(F.struct("key", "rep", "ids", "v")).alias("rows"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = spread.value
            for b in batches:
                for n, (q, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                    vector = v.values.to_numpy().astype(np.float64)
                    looked = t.probes(vector[None], most)[0][:tables_].view(np.int64)
                    out = []
                    for x in range(tables_):
                        part = looked[x] % n_parts
                        where = np.unique(part) if probed else np.arange(n_parts)
                        out += [(x, int(p), looked[x][part == p] if probed else None) for p in where]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([q] * len(out), pa.int64()), b.column(1).take(pa.array([n] * len(out), pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                        names=["t", "part", "q", "v", "keys"],
                    )

        sent = wanted.select("q", "v").mapInArrow(probe, f"t int, part long, q long, v {element}, keys array<long>")
        block = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n_queries // queries))))
        sent = sent.join(salts, ["t", "part"]).select("t", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), block.alias("block"), F.struct("q", "v", "keys").alias("ask"))
        asks = sent.groupBy("t", "part", "salt", "block").agg(F.collect_list("ask").alias("asks"))
        units = cells.join(asks, ["t", "part", "salt"]).select("rows", "asks")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cell, ask in zip(*b.columns):
                    yield best(cell.values, ask.values, dim, k)

        return units.mapInArrow(compare, "q long, rep long, d double, ids array<long>, offered long")

    def top(found: DataFrame) -> DataFrame:
        """The best k + 1 of each query, each index row once: (q, d, id, offered)."""
        many = Window.partitionBy("q").orderBy("d", F.col("ids")[0], "rep")
        once = found.groupBy("q", "rep").agg(F.first("d").alias("d"), F.first("ids").alias("ids"))
        total = found.where("offered IS NOT NULL").groupBy("q").agg(F.sum("offered").alias("offered"))
        few = once.where("rep IS NOT NULL").withColumn("r", F.row_number().over(many)).where(F.col("r") <= k + 1)
        return few.join(total, "q").select("q", "d", F.explode("ids").alias("id"), "offered")

    first = stored(top(stored(search(wanted, tables.shape[0], n_probes, True), "offers")), "found")
    short = stored(wanted.join(first.groupBy("q").count().where(F.col("count") > k), "q", "left_anti"), "short")
    if not short.isEmpty():
        first = first.join(short.select("q"), "q", "left_anti").unionByName(top(stored(search(short, 1, 1, False), "offers")))
    each = asked.select("q", F.col("id").alias("query_id")).join(first, "q").where("id <> query_id")
    by = Window.partitionBy("query_id").orderBy("d", "id")
    ranked = each.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"), "offered")


OFFERS = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("d", pa.float64()), ("ids", pa.list_(pa.int64())), ("offered", pa.int64())])


def best(cell: pa.StructArray, asks: pa.StructArray, dim: int, k: int) -> pa.RecordBatch:
    """A piece of the index (key, rep, ids, v) and queries (q, v, keys; null keys: all) -> each query's best k + 1 rows, and one row
    without a rep that says how many rows its keys offered."""
    order = np.argsort(cell.field("key").to_numpy(), kind="stable")
    keys = cell.field("key").to_numpy()[order]
    v = matrix(cell.field("v"), dim).astype(np.float64)[order]
    rep, lists = cell.field("rep").to_numpy()[order], cell.field("ids")
    least = np.array([x[0].as_py() for x in lists], np.int64)[order]
    who, what, far, offered = [], [], [], []
    names = asks.field("q").to_pylist()
    for vector, looked in zip(matrix(asks.field("v"), dim).astype(np.float64), asks.field("keys")):
        if looked.is_valid:
            looked = looked.values.to_numpy()
            lo, hi = np.searchsorted(keys, looked), np.searchsorted(keys, looked, side="right")
            n = hi - lo
            c = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        else:
            c = np.arange(len(keys))
        offered.append(len(c))
        d = np.sqrt(((v[c] - vector) ** 2).sum(axis=1))
        if len(c) > k + 1:
            near = d <= np.partition(d, k)[k]
            c, d = c[near], d[near]
        few = np.lexsort((rep[c], least[c], d))[: k + 1]
        who.append(len(few))
        what.append(c[few])
        far.append(d[few])
    what = np.concatenate([*what, np.empty(0, np.int64)]).astype(np.int64)
    none = pa.nulls(len(what), pa.int64())
    rows = [pa.array(np.repeat(names, who).astype(np.int64)), pa.array(rep[what]), pa.array(np.concatenate([*far, np.empty(0)])), lists.take(pa.array(order[what])), none]
    totals = [pa.array(names, pa.int64()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.float64()), pa.nulls(len(names), pa.list_(pa.int64())), pa.array(offered, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(f.type), y]) for x, y, f in zip(rows, totals, OFFERS)], schema=OFFERS)
