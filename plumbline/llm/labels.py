"""Labelled rows the classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """One 0/1 label per doc_id (as __label_id); of contradicting rows the larger counts, null labels do not."""
    kept = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull())
    return kept.groupBy(F.col("doc_id").alias("__label_id")).agg(F.max(F.col(name).cast("int")).alias("__y"))


def learning_sample(docs: DataFrame, labels: DataFrame, name: str, per_class: tuple[int, int], columns: list[str]) -> DataFrame:
    """Up to ``per_class`` labelled rows of class 0 and 1 outside fold 0, with doc_id, the named columns, y and fold.

    The ids with the smallest hash are taken, so the choice repeats; of rows that share an id one is taken, the
    one whose text has the smallest hash. Ids and rows are bounded by the sum, which bounds what is broadcast.
    """
    known = docs.select("doc_id").join(label_of(labels, name), F.col("doc_id") == F.col("__label_id")).where(fold() != 0).select("doc_id", "__y").distinct()
    parts = [known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y]) for y in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("__label_id"), "__y")
    rows = docs.select("doc_id", *columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id"))
    text = F.col("text").cast("string")
    first = F.min_by(F.struct(*columns), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)))
    one = rows.groupBy("doc_id").agg(first.alias("__row"), F.first("__y").alias("y"))
    return one.select("doc_id", "__row.*", "y", fold().alias("fold"))
