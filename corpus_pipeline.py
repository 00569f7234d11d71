"""Corpus cleaning: toxic and poor documents go, boilerplate lines and near copies go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next stage's documents. All but the last return the columns of documents, whatever they are called: what
a stage adds for itself has a reserved name. Null and empty texts are scored and packed like texts without
words, null sources, languages and sizes are values of their own; repeated rows and ties share their verdict;
documents without an id are judged like others and are never merged; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, packing, quality, simhash, toxicity
from plumbline.llm.common import stored, table
from plumbline.llm.queries import vocabulary_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned on this input, does not reject."""
    scores = toxicity.marked(docs, table(spark, sf_dir, "labels"))
    return scores.where(F.col(toxicity.SCORE) < 0.5).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier, learned on this input, accepts."""
    scores = quality.marked(docs, table(spark, sf_dir, "labels"))
    return scores.where(F.col(quality.SCORE) >= 0.5).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    cleaned = line_dedup.cleaned(docs)
    sized = cleaned.withColumn("n_chars", F.when(F.col(line_dedup.N_DROPPED) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return sized.select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-copy group; documents without an id stay.

    Rows that repeat an id and a text become one row. Only ids are aggregated to find them, so the
    texts of all other documents are not shuffled a second time.
    """
    copies = stored(simhash.near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__copy_id"), F.col("text_key").alias("__copy_key")).distinct())
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__other_id")))
    firsts = stored(docs.join(copies.hint("merge"), (F.col("doc_id") == F.col("__copy_id")) & (F.xxhash64("text") == F.col("__copy_key")), "left_anti"))
    once = firsts.join(repeated, F.col("doc_id") == F.col("__other_id"), "left_anti")
    more = firsts.join(repeated, F.col("doc_id") == F.col("__other_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(more)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, **vocabulary_paths())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", one_per_group),
    ("best_fit_packing", packed),
]

#: Trained classifiers and the tokenizer cannot be expressed in SQL; a test rebuilds the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
