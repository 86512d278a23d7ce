"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights by water filling; Sainte-Lague (highest quotients v / (2k - 1)) turns them into whole blocks for
each source, and a source's blocks into quotas for its shards. A shard is a bounded, hash-ordered part of a source's
token stream, cut into equal blocks; block i of n is taken floor((i + 1) q / n + u) - floor(i q / n + u) times for a
quota q and a seeded u, so a shard takes exactly q blocks, spread evenly over it, and no block more than once above
another. Quotas are bounded: no source or shard has more than `most` seats a block, as Sainte-Lague alone would give it now and then. Blocks are long, so that what is left out is whole documents or long stretches; sources too small for so many
long blocks have shorter ones. What a document gives follows from its place in its shard's prefix sums: no block is ever made into a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.llm.session import WORD, bounded_batches, stored, trimmed

WEIGHTS = (1.0, 2.0, 3.0)
#: Words of a block: at most, at least, and a source's size over this between them.
LONGEST, SHORTEST, BLOCKS = 4096, 8, 100
#: What two real numbers that should be equal may differ by, relative to them.
SLACK = 1e-12


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash): size is the number of words of the whole text, 0 for null."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): sources by code point, null last, weigh weights in turn and share all tokens;
    a target stops at most times its source's size, and what is cut is shared by weight among the rest. All empty: targets are 0.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = by_source.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    rows = listed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("all_", F.lit(0)).withColumn("total_", F.sum("source_size").over(Window.partitionBy("all_")).cast("double"))
    rows = rows.withColumn("level", poured(F.col("total_"), F.col("weight"), F.col("cap"), ["all_"], [F.col("n")]))
    rows = rows.withColumn("level", F.min("level").over(Window.partitionBy("all_"))["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def poured(total: Column, weight: Column, cap: Column, within: list[str], order: list[Column]) -> Column:
    """Of the level L at which min(weight L, cap), summed over a group, is the total: a struct of a place and a level for each row, of which
    the group's first has the level (none: all caps together are less). Rows go in order of cap / weight, ties by `order`, and
    running sums are all that is needed: those before the first whose cap isn't below its level are full."""
    group = Window.partitionBy(*within)
    listed = group.orderBy((cap / weight).asc_nulls_last(), *order)
    upto = listed.rowsBetween(Window.unboundedPreceding, -1)
    from_here = F.sum(weight).over(group) - F.coalesce(F.sum(weight).over(upto), F.lit(0.0))
    here = (total - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.when(from_here > 0, from_here)
    return F.when(cap >= here * weight * (1 - SLACK), F.struct(F.row_number().over(listed).alias("at"), here.alias("level")))


def apportion(votes: DataFrame, key: list[str], seats: Column, vote: Column, within: list[str], most: Column) -> DataFrame:
    """Sainte-Lague with a bound: add `quota` to votes, the seats of each group (columns within) dealt by the highest v / (2k - 1),
    where a party that has `most` seats takes no more and the next quotients get them. Seats beyond all bounds stay empty.

    Let t be the level at which min(v t, most) sums to the seats S. Rounding moves each of m parties by half a seat at most, so a
    party surely has the seats that the level for S - m / 2 rounds to, and none beyond those of the level for S + m / 2.
    Only the seats between the two, about 2 m in all, are ranked by quotient. Ties go to the lesser key.
    """
    group = Window.partitionBy(*within)
    by_key = [F.col(c).asc_nulls_last() for c in key]
    rows = votes.withColumn("v_", vote.cast("double")).withColumn("c_", F.when(F.col("v_") > 0, most.cast("double")).otherwise(0.0))
    rows = rows.withColumn("s_", F.least(seats.cast("double"), F.sum("c_").over(group))).withColumn("m_", F.count("*").over(group))
    v, cap = F.when(F.col("v_") > 0, F.col("v_")), F.col("c_")
    for name, total in (("low_", F.greatest(F.col("s_") - F.col("m_") / 2 - 1, F.lit(0.0))), ("high_", F.col("s_") + F.col("m_") / 2 + 1)):
        rows = rows.withColumn(name, poured(total, v, cap, within, by_key))
        rows = rows.withColumn(name, F.min(name).over(group)["level"])
    low = F.greatest(F.floor(F.col("v_") * F.col("low_") + 0.5) - 1, F.lit(0))
    high = F.ceil(F.col("v_") * F.col("high_") + 0.5) + 1
    bounded = lambda x: F.coalesce(F.least(x.cast("double"), cap), cap).cast("long")
    rows = rows.withColumn("low_", bounded(low)).withColumn("high_", bounded(high))
    rows = rows.withColumn("rest_", F.col("s_") - F.sum("low_").over(group))
    seat = rows.where("high_ > low_").select(*key, *[c for c in within if c not in key], "v_", "rest_", F.explode(F.sequence(F.col("low_") + 1, F.col("high_"))).alias("k_"))
    order = Window.partitionBy(*within).orderBy((F.col("v_") / (2 * F.col("k_") - 1)).desc(), *by_key)
    won = seat.withColumn("r_", F.row_number().over(order)).where("r_ <= rest_").groupBy(*key).agg(F.count("*").alias("won_"))
    won = won.select(*[F.col(c).alias(c + "_") for c in key], "won_")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(c + "_"))
    out = rows.join(won, same, "left")
    return out.select(*votes.columns, (F.col("low_") + F.coalesce("won_", F.lit(0))).cast("long").alias("quota"))


def placed(docs: DataFrame, weights: tuple[float, ...], most: float, block: int | None, shard_tokens: int, seed: int, **cols: str) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, size, source, source_size, target, and its place: start (tokens before it
    in its shard), n_blocks, quota and phase of the shard, and the words of a block."""
    sized = stored(sizes(docs, **cols), "sizes")
    aims = stored(targets(sized, weights, most), "targets")
    spread = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_tokens))))
    known = sized.join(aims.select(F.col("source").alias("source_"), "source_size", "target"), sized.source.eqNullSafe(F.col("source_")))
    words = F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.floor(F.col("source_size") / BLOCKS))) if block is None else F.lit(block)
    known = known.withColumn("block", words.cast("long"))
    known = known.withColumn("order_", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    known = known.withColumn("shard", F.pmod(F.col("order_"), spread).cast("long")).drop("source_")
    inside = Window.partitionBy("source", "shard").orderBy("order_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    known = stored(known.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long")), "placed")

    shards = known.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("block").alias("block"))
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.floor(F.col("shard_size") / F.col("block")))).otherwise(0).cast("long")
    shards = shards.withColumn("n_blocks", blocks)
    by_source = shards.groupBy("source").agg(F.sum("n_blocks").alias("blocks"), F.first("source_size").alias("size"), F.first("target").alias("aim"))
    # a source's vote is its target in blocks of its own mean length, so a target of k times its size is k times its blocks
    vote = F.when(F.col("size") > 0, F.col("aim") / F.col("size") * F.col("blocks")).otherwise(F.lit(0.0))
    by_source = by_source.withColumn("vote", vote).withColumn("all_", F.lit(0))
    by_source = by_source.withColumn("seats", F.round(F.sum("vote").over(Window.partitionBy("all_"))))
    bound = lambda blocks: F.floor(F.col(blocks) * F.lit(float(most)))
    source_quota = apportion(by_source, ["source"], F.col("seats"), F.col("vote"), ["all_"], bound("blocks")).select(F.col("source").alias("source_"), F.col("quota").alias("source_quota"))
    shards = shards.join(source_quota, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    quotas = apportion(shards, ["source", "shard"], F.col("source_quota"), F.col("n_blocks"), ["source"], bound("n_blocks"))
    phase = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    quotas = quotas.select(F.col("source").alias("source_"), F.col("shard").alias("shard_"), "n_blocks", "quota", phase.alias("phase"))
    return known.join(quotas, F.col("source").eqNullSafe(F.col("source_")) & (F.col("shard") == F.col("shard_"))).drop("source_", "shard_", "order_")


def taken_before(x: Column) -> Column:
    """Tokens that the mix takes of the first x tokens of a shard, repeats counted."""
    j = F.greatest(F.least(F.floor(x / F.col("block")), F.col("n_blocks") - 1), F.lit(0))
    upto = lambda i: F.floor(i * F.col("quota") / F.col("n_blocks") + F.col("phase"))
    full = upto(j) * F.col("block")
    return F.when(F.col("n_blocks") > 0, full + (x - j * F.col("block")) * (upto(j + 1) - upto(j))).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int | None = None, shard_tokens: int = 1 << 20, seed: int = 17, **cols: str) -> DataFrame:
    """What a mix takes of each row of docs: doc_id, source, size, source_size, target, taken.

    Nulls: a null text has size 0 and gives nothing; a null source is a source, the last one; a null id is kept. Repeated
    rows take places of their own. Very long texts may span many blocks. Documents are ordered by a seeded hash of id and
    text, so reruns agree. An empty table gives an empty result. Other columns are not read.
    """
    rows = placed(docs, weights, most, block, shard_tokens, seed, **cols)
    taken = taken_before(F.col("start") + F.col("size")) - taken_before(F.col("start"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def copies(start: int, size: int, n: int, quota: int, phase: float, block: int) -> list[list[tuple[int, int]]]:
    """For copy 1, 2, ... of a document: the spans (first and past-the-last token, in the document) that it is made of."""
    if not size or not n or not quota:
        return []
    i = np.arange(min(start // block, n - 1), min((start + size - 1) // block, n - 1) + 1)
    times = (np.floor((i + 1) * quota / n + phase) - np.floor(i * quota / n + phase)).astype(int)
    lo = np.maximum(i * block, start) - start
    hi = np.where(i == n - 1, start + size, np.minimum((i + 1) * block, start + size)) - start
    found = []
    for c in range(1, int(times.max()) + 1):
        keep = times >= c
        edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(int), [0]])))
        found.append([(int(lo[a]), int(hi[b - 1])) for a, b in zip(edge[::2], edge[1::2])])
    return found


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int | None = None, shard_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy of a document, its text the spans taken.

    A copy that takes all blocks of a document keeps its text untouched; other spans are cut between words and joined by
    line feeds, and n_chars (if there is such a column) is counted anew. Documents of which nothing is taken go.
    Texts are joined to their places by id, hash and source.
    """
    bounded_batches(docs.sparkSession)
    places = placed(docs, weights, most, block, shard_tokens, seed)
    same = Window.partitionBy("i", "h", "s").orderBy("i")  # repeated rows are numbered, and each meets one place
    place = places.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), F.col("source").alias("s"), F.struct("start", "size", "n_blocks", "quota", "phase", "block").alias("place"))
    place = place.withColumn("n", F.row_number().over(same)).toDF("i_", "h_", "s_", "place", "n_")
    whole = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("source").cast("string").alias("s"))
    whole = whole.withColumn("n", F.row_number().over(same))
    met = [F.col(c).eqNullSafe(F.col(c + "_")) for c in "ihsn"]
    rows = whole.join(place, met[0] & met[1] & met[2] & met[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for b in batches:
            at, texts = [], []
            for n, (text, place) in enumerate(zip(b.column("text"), b.column("place"))):
                text, p, ends = text.as_py(), place.as_py(), None
                for spans in copies(p["start"], p["size"], p["n_blocks"], p["quota"], p["phase"], p["block"]):
                    got = text
                    if spans != [(0, p["size"])]:
                        ends = ends or [m.span() for m in word.finditer(text)]
                        got = "\n".join(text[ends[x][0] : ends[y - 1][1]] for x, y in spans)
                    at.append(n)
                    texts.append(got)
            yield pa.RecordBatch.from_arrays([b.column("row_").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], names=["row_", "text_"])

    made = rows.select("row_", F.col("row_.text").cast("string").alias("text"), "place").mapInArrow(trimmed(run), whole.select("row_", F.lit("").alias("text_")).schema)
    new = {"text": F.col("text_"), "n_chars": F.length("text_").cast("long")}
    return made.select(*[new.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])
