"""Encoding nodes step by step, and training losses over vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodepath.functions import vectors as V

#: texts -> one vector each; any picklable function
Encoder = Callable[[list[str]], np.ndarray]


def encode(nodes: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(node, vec) by an encoder that runs in the workers, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                some = b["node"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"node": some, "vec": list(np.asarray(encoder(some), dtype=np.float32))})

    return nodes.select("node").mapInPandas(run, "node string, vec array<float>")


def encode_missing(nodes: DataFrame, done: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(node, vec) of all nodes: what is done stays, only the rest is encoded. Writing the result and calling again resumes."""
    rest = nodes.join(done.select("node"), "node", "left_anti")
    return done.join(nodes.select("node"), "node", "left_semi").select("node", "vec").unionByName(encode(rest, encoder, batch))


def sliced_cache(nodes: DataFrame, dim: int, sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node, vec) at a dimension from the first of several tables that has the node (a table of that dimension, a checkpoint, the
    full vectors, cut to their prefix), and the nodes that none has. A table of fewer components doesn't count."""
    rows = nodes.select("node")
    names = []
    for n, s in enumerate(sources):
        name = f"v{n}_"
        names.append(name)
        rows = rows.join(s.where(F.size("vec") >= dim).select("node", F.slice("vec", 1, dim).alias(name)), "node", "left")
    found = rows.select("node", F.coalesce(*names).alias("vec"))
    return found.where("vec IS NOT NULL"), found.where("vec IS NULL").select("node")


def words_of(text: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens of an entity (parts between spaces), or, with stop words, of a question or relation (words without them)."""
    if stop_words is None:
        return F.filter(F.split(text, " "), lambda t: t != "")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(words, lambda t: ~t.isin(*stop_words)) if stop_words else words


def observation(question: Column, node: Column, dim: int = 300) -> Column:
    """A question's and a node's vectors, one after the other; other lengths than dim are an error."""
    ok = (F.size(question) == dim) & (F.size(node) == dim)
    return F.when(ok, F.concat(question, node)).otherwise(F.raise_error(F.lit(f"vectors must have {dim} components")).cast("array<double>"))


@F.pandas_udf(T.DoubleType())
def gelu(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """x Phi(x), by the error function, which Spark doesn't have."""
    erf = np.vectorize(math.erf, otypes=[float])
    for x in batches:
        v = x.to_numpy(dtype=float)
        yield pd.Series(0.5 * v * (1 + erf(v / math.sqrt(2))))


def rank_loss(rows: DataFrame, dims: list[int], activation: str = "relu", metric: str = "euclidean", weight: float = 0.0) -> DataFrame:
    """One row (dim, loss) for each prefix dimension: the mean over rows (current, positive, negative, end vectors) of the activated
    rank difference, and `weight` times the mean squared deviation of norms from 1. Their sum over dims is the training loss."""
    if activation not in ("relu", "gelu"):
        raise ValueError(f"no activation {activation}")
    each = rows.select("*", F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim"))
    cut = {c: F.slice(c, F.lit(1), F.col("dim")) for c in ("current", "positive", "negative", "end")}
    delta = V.rank_difference(cut["current"], cut["positive"], cut["negative"], cut["end"], metric)
    act = F.greatest(delta, F.lit(0.0)) if activation == "relu" else gelu(delta)
    parts = each.select("dim", act.alias("a"), (V.unit_penalty(*cut.values()) / 4).alias("r"))
    return parts.groupBy("dim").agg((F.avg("a") + weight * F.avg("r")).alias("loss"))
