"""Names of models and runs: parsing, aliases, labels; small registries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of a run's name that end the model's own name, and their canonical forms.
STOP_TOKENS = ("relu", "gelu", "cos", "cosine", "cosine_distance", "euclid", "euclidean", "l2", "norm", "nonorm", "matryoshka", "single", "best")
ACTIVATIONS = {"relu": "relu", "gelu": "gelu"}
DISTANCES = {"cos": "cosine", "cosine": "cosine", "cosine_distance": "cosine", "euclid": "euclidean", "euclidean": "euclidean", "l2": "euclidean"}
FAMILIES = (("qwen", "Qwen"), ("mxbai", "MXBAI"), ("mixedbread", "MXBAI"), ("mpnet", "MPNet"), ("bge", "BGE"), ("granite", "Granite"))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), F.lower(c))


def activation(c: Column) -> Column:
    return _mapped(c, ACTIVATIONS)


def distance(c: Column) -> Column:
    return _mapped(c, DISTANCES)


def short_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def base_name(path: Column) -> Column:
    """The tokens before the first that tells of training."""
    name = F.regexp_replace(F.regexp_replace(short_name(path), "_finetuned$", ""), "_best$", "")
    parts = F.split(name, "_")
    stop = F.transform(parts, lambda p: F.lower(p).isin(*STOP_TOKENS))
    first = F.array_position(stop, True)
    return F.array_join(F.when(first > 0, F.slice(parts, F.lit(1), (first - 1).cast("int"))).otherwise(parts), "_")


def variant(path: Column) -> Column:
    low = F.lower(short_name(path))
    tuned = F.endswith(low, F.lit("_finetuned")) | F.exists(F.split(low, "_"), lambda p: p.isin(*STOP_TOKENS))
    return F.when(F.contains(low, F.lit("_ablation_")), "ablation").when(tuned, "finetuned").otherwise("base")


def parsed(path: Column) -> Column:
    """base, variant, activation, distance, normalize of a run's name."""
    parts = F.split(F.regexp_replace(short_name(path), "_finetuned$", ""), "_")
    first = lambda table: F.try_element_at(F.filter(F.transform(parts, lambda p: _mapped(p, table)), lambda x: x.isNotNull()), F.lit(1))
    kind = variant(path)
    norm = F.when(F.array_contains(parts, "norm"), True).when(F.array_contains(parts, "nonorm"), False)
    return F.struct(
        base_name(path).alias("base"),
        kind.alias("variant"),
        F.when(kind != "base", first(ACTIVATIONS)).alias("activation"),
        F.when(kind != "base", first(DISTANCES)).alias("distance"),
        norm.alias("normalize"),
    )


def family(model: Column, path: Column) -> Column:
    text = F.lower(F.concat_ws(" ", model, path))
    out = None
    for part, name in FAMILIES:
        out = (F if out is None else out).when(F.contains(text, F.lit(part)), name)
    return out.otherwise(short_name(F.regexp_replace(path, "/+$", "")))


def identity(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def matryoshka_dims(dim: Column) -> Column:
    """The full dimension, the powers of two below it, and 768 where it fits; largest first."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda x: x < dim)
    anchor = F.when(dim >= 768, F.array(F.lit(768))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_distinct(F.concat(F.array(dim.cast("int")), powers, anchor)), asc=False)


def slug(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def registry(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A registry that is stated in code (a few rows) as a table; join it with broadcast()."""
    return spark.createDataFrame(rows, schema)


def canonical(df: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """Replace aliases (alias, name) whatever their case; names without an alias stay."""
    known = aliases.select(F.lower("alias").alias("alias_"), F.col("name").alias("name_")).dropDuplicates(["alias_"])
    return df.join(known, F.lower(df[column]) == F.col("alias_"), "left").withColumn(out, F.coalesce("name_", column)).drop("alias_", "name_")
