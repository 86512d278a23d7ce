"""The subpackage's queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import ann, chat, collocations, decontam, licenses, lines, mixing, periods, quality, rules, simhash, tokens, toxicity
from lodepath.llm.session import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", "taken")


def op2_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return made.select("doc_id", "held_out", "score", predicted, "threshold", "rejected")


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.cleaned(table(spark, sf_dir, "documents"))
    return made.select(F.col("row_.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    made = licenses.scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return made.withColumnRenamed("file_id", "doc_id")


def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted_digest(talks.unionByName(probe))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periods(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_benchmark_overlap,
        op3_toxicity_cnn,
        op4_quality_nbsvm,
        op5_site_line_dedup,
        op6_token_files,
        op7_license_scan,
        op8_multiprobe_neighbours,
        op9_chat_windows,
        op10_simhash_near_dedup,
        op11_collocations,
        op12_quality_rules,
        op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_site_line_dedup": lines.SQL,
    "op9_chat_windows": chat.SQL,
    "op11_collocations": collocations.SQL,
}
