"""Concepts, questions and labels as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of str.strip(), as a class of Java regular expressions.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
STRIP = rf"^{SPACE}+|{SPACE}+$"

#: How an infobox or list heading is said as a sentence (%1$s cause, %2$s effect).
CONNECTION_SENTENCES = {
    "causes": "%1$s causes %2$s",
    "Cause": "%1$s can cause %2$s",
    "cause": "%1$s can cause %2$s",
    "risks": "%1$s risks %2$s",
    "symptoms": "%2$s is a symptom of %1$s",
    "Symptoms": "%2$s is a symptom of %1$s",
    "Signs and symptoms": "%2$s is a sign or symptom of %1$s",
    "Causes": "%1$s causes %2$s",
    "Risk factor": "%1$s is a risk factor for %2$s",
}
#: Labels of the question tables.
TRUE_LABELS = ("causal", "true", "yes", "1")
FALSE_LABELS = ("non_causal", "non-causal", "noncausal", "false", "no", "0")
EVAL_SPLITS = ("msmarco_valid", "msmarco_test")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def concept(c: Column, lower: bool = False) -> Column:
    """Underscores as spaces, stripped; lower case for the lexical graph."""
    out = strip(F.translate(c, "_", " "))
    return F.lower(out) if lower else out


def is_valid_node(c: Column) -> Column:
    """Holds a letter or digit."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def question_concept(c: Column) -> Column:
    """Words in lower case and NFKC, joined by a space. Only text beyond ASCII goes through Python."""
    words = F.array_join(F.filter(F.split(F.lower(c), SPACE + "+"), lambda w: w != ""), " ")
    return F.when(words.rlike(r"^\p{ASCII}*$"), words).otherwise(_nfkc(words))


def question_text(question: Column, pos: Column) -> Column:
    """The question, or the words of its tagged tokens, ending in a question mark."""
    said = strip(F.coalesce(F.when(question != "", question), F.array_join(F.transform(pos, lambda t: t[0]), " "), F.lit("")))
    return F.when(F.endswith(said, F.lit("?")), said).otherwise(F.concat(said, F.lit("?")))


def span_text(pos: Column, start: Column, end: Column) -> Column:
    """Tokens from start to end, both included, joined by a space; null for a span outside the tokens."""
    inside = (start >= 0) & (end >= start) & (start < F.size(pos))
    return F.when(inside, F.array_join(F.transform(F.slice(pos, start + 1, end - start + 1), lambda t: t[0]), " "))


def msmarco_label(extracted: Column, with_negatives: bool) -> Column:
    first = strip(F.try_element_at(extracted, F.lit(1)))
    label = F.when(first == "Yes", True)
    return label.when(first == "No", False) if with_negatives else label


def semeval_label(raw: Column) -> Column:
    value = F.lower(strip(raw))
    return F.when(value.isin(*TRUE_LABELS), True).when(value.isin(*FALSE_LABELS), False)


def record_id(dataset: str, given: Column, row: Column) -> Column:
    return F.concat_ws("_", F.lit(dataset), F.coalesce(given.cast("string"), row.cast("string")))


def row_id(given: Column, row: Column) -> Column:
    return F.coalesce(given.cast("string"), F.concat(F.lit("__row_"), row.cast("string")))


def connection_sentence(connection: Column, cause: Column, effect: Column) -> Column:
    """The sentence of a heading; "X can cause Y" for any other."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, form in CONNECTION_SENTENCES.items():
        out = out.when(connection == name, F.format_string(form, cause, effect))
    return out.otherwise(F.concat(cause, F.lit(" can cause "), effect))


def source_sentence(sources: Column, cause: Column, effect: Column) -> Column:
    """The first sentence of a web or encyclopedia source; else a sentence from the last source's heading."""
    kinds = ("clueweb12_sentence", "wikipedia_sentence")
    said = F.try_element_at(F.filter(sources, lambda s: s["type"].isin(*kinds) & (F.coalesce(s["payload"]["sentence"], F.lit("")) != "")), F.lit(1))
    last = F.try_element_at(sources, F.lit(-1))
    heading = F.when(last["type"] == "wikipedia_list", last["payload"]["list_toc_section_heading"]).otherwise(last["payload"]["infobox_argument"])
    return F.coalesce(said["payload"]["sentence"], connection_sentence(heading, cause, effect))


def causality_score(necessity: Column, sufficiency: Column) -> Column:
    return F.greatest(necessity, sufficiency)


def causal_strength(necessity: Column, sufficiency: Column, weight: float = 0.9) -> Column:
    return F.pow(necessity, F.lit(weight)) * F.pow(sufficiency, F.lit(1 - weight))


def keeps_strength(count: Column, necessity: Column, sufficiency: Column, least_count: int = 5, least: float = 0.1) -> Column:
    return (count >= least_count) & (causal_strength(necessity, sufficiency) >= least)


def split_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("train")), "train").when(F.contains(name, F.lit("valid")), "valid").when(F.contains(name, F.lit("test")), "test").otherwise("unknown")


def train_split_name(name: Column) -> Column:
    """The name with valid or test as train; an error for any other name without train."""
    out = F.when(F.contains(name, F.lit("train")), name).otherwise(F.regexp_replace(name, "valid|test", "train"))
    return F.when(name.rlike("train|valid|test"), out).otherwise(F.raise_error(F.concat(F.lit("no split in "), name)))


def dataset_family(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("msmarco")), "msmarco").when(F.startswith(name, F.lit("sem")), "semeval").otherwise("other")


def percent(part: Column, total: Column, digits: int | None = None) -> Column:
    """Part of total in percent, 0 of nothing; rounded half to even."""
    out = F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100)
    return out if digits is None else F.bround(out, digits)


def budget_of(p95: Column) -> Column:
    return F.ceil(p95).cast("long")


def time_ms(ms: Column, seconds: Column, missing: float = float("inf")) -> Column:
    return F.coalesce(ms, seconds * 1000, F.lit(missing))


def path_edges(path: Column) -> Column:
    """Consecutive pairs of a path."""
    return F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("source"), b.alias("target")))


def hops(path: Column) -> Column:
    return F.greatest(F.size(path) - 1, F.lit(0))


def termination(path: Column, visited: Column, cap: Column, algorithm: Column) -> Column:
    """Why a search ended; a frontier that empties with as many visits as the cap counts as the cap."""
    return F.when(F.size(path) > 0, "path_found").when((cap != -1) & (visited >= cap), "cap_reached").when(algorithm == "rl", "rl_policy_terminated").otherwise("frontier_exhausted")


def cap_mode(cap: Column, default_cap: Column) -> Column:
    return F.when(cap == -1, "uncapped").when(cap.eqNullSafe(default_cap), "default_p95").otherwise("custom")


def node_status(node: Column, source: Column, target: Column, path: Column) -> Column:
    return F.when(node.eqNullSafe(source), "source").when(node.eqNullSafe(target), "target").when(F.array_contains(path, node), "path").otherwise("normal")


def preview_node_budget(nodes: Column, edges: Column, limit: Column) -> Column:
    grown = F.greatest(F.lit(96), F.floor(F.sqrt(F.least(F.greatest(edges, F.lit(1)), F.lit(1_000_000))) / 3))
    return F.when(nodes <= limit, nodes).otherwise(F.least(limit, grown)).cast("long")


def preview_edge_budget(selected: Column, nodes: Column, edges: Column) -> Column:
    factor = 2.0 + F.least(F.lit(2.5), F.log2(edges / F.greatest(nodes, F.lit(1)) + 1) / 2)
    return F.when(selected <= 1, 0).otherwise(F.greatest(selected - 1, F.floor(selected * factor))).cast("long")


def typed_scalar(raw: Column) -> Column:
    """Kind and value of a scalar in a flat key: value file: bool, null, quoted, int, float or str."""
    value = strip(raw)
    low = F.lower(value)
    quoted = value.rlike(r"""^(".*"|'.*')$""")
    kind = (
        F.when(low.isin("true", "false"), "bool").when(low.isin("null", "none", "~", ""), "null").when(quoted, "quoted")
        .when(value.rlike(r"^[+-]?\d+$"), "int").when(value.try_cast("double").isNotNull(), "float").otherwise("str")
    )
    text = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).when(low.isin("true", "false"), low).when(low.isin("null", "none", "~", ""), None).otherwise(value)
    return F.struct(kind.alias("kind"), text.alias("value"))


def checkpoint_epoch(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.translate(path, "\\", "/"), r"(?:^|/)best-(\d+)-", 1), F.lit("")).try_cast("int")


def categorical_choice(choices_json: Column, value: Column) -> Column:
    """The choice of a categorical parameter that is stored as an index into a JSON list."""
    return F.try_element_at(F.from_json(choices_json, "array<string>"), value.cast("int") + 1)


def tokens(c: Column, lower: bool = False) -> Column:
    """Parts between single spaces that aren't empty."""
    return F.filter(F.split(F.lower(c) if lower else c, " "), lambda t: t != "")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
