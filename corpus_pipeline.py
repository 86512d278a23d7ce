"""Documents to token files: five stages, each over all that the one before it kept, written and read again between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodepath.llm import decontam, mixing, simhash, tokens, toxicity
from lodepath.llm.session import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects by their language's threshold go.

    Null and empty texts have no words and the score of none; a null language has the default threshold. Without labels, or with
    labels of one class only, all stay. Repeated rows, and rows of one id, are judged each by its own text. Long texts are read
    whole. No rows: none. Other columns, whatever their names, are kept.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score(docs, model, keep=True)
    return judged.where(~F.col("rejected")).select(*[F.col("row_")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays: those of a similarity of 0.8 or more on sets of five-word
    shingles, and what they connect. Documents without an id count after all others.

    Null and empty texts have no words and are copies of each other. Rows of one id and one text are one document, of one id and
    different texts different ones. Long texts are compared whole. No rows: none. Other columns, whatever their names, are kept.
    """
    keep = simhash.least_documents(docs)
    row = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("i_"), F.xxhash64(F.col("text").cast("string")).alias("h_"))
    left = row.join(keep, F.col("i_").eqNullSafe(F.col("doc_id")) & (F.col("h_") == F.col("h")), "left_semi").dropDuplicates(["i_", "h_"])
    return left.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain enough of a benchmark item go: tiles of five words or more that cover half of it.

    Null and empty texts, and all texts if there is no benchmark, stay; an item of fewer than five words is never found. Repeated
    rows, and rows of one id, are judged each by its own text. Long texts are read whole. No rows: none. Other columns,
    whatever their names, are kept.
    """
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents by the spans taken, up to three times.

    Null sources are one source, the last. Null texts and those without words have no size, so nothing is taken of them and they
    go. Repeated rows are documents each. Long texts are cut at words, in whole blocks. No rows: none. Other columns, whatever
    their names, are kept, but for n_chars, which is counted anew.
    """
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, read back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty and have the end id only. Null ids come first; rows of one id go by a hash of their text; repeated rows are
    encoded each. Long texts are encoded whole. No rows: none. Other columns are not read.
    """
    return tokens.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Hashing, training and tokenizing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
