"""Documents to blocks to chunks, inside the row: one narrow stage and no shuffle.

Arrays built by costly expressions are exploded with the outer variants: a plain explode lets the
optimizer add a ``size(array) > 0`` filter below it, which would compute the array again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.blocks import chunk_blocks

def with_merged_blocks(df: DataFrame, column: str) -> DataFrame:
    """Join consecutive blocks of the same page and section in an array column.

    The island starts are a column of their own, so they are computed once per row.
    """
    blocks, starts = F.col(column), F.col("_starts")
    last = F.size(blocks) - 1

    def starts_new(i: Column) -> Column:
        here, before = F.get(blocks, i), F.get(blocks, i - 1)
        same = here["page"].eqNullSafe(before["page"]) & here["section"].eqNullSafe(before["section"])
        return (i == 0) | ~same

    positions = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def island(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), last + 1)
        head = F.get(blocks, start)
        body = F.array_join(F.transform(F.slice(blocks, start + 1, stop - start), lambda b: b["text"]), "\n\n")
        return F.struct(head["page"].alias("page"), head["section"].alias("section"), body.alias("text"))

    return df.withColumn("_starts", F.filter(positions, starts_new)).withColumn(column, F.transform("_starts", island)).drop("_starts")


def chunk_documents(documents: DataFrame, blocks: Column, **limits) -> DataFrame:
    """One row per chunk, numbered over the whole document, with its stable id."""
    found = documents.withColumn("_chunks", chunk_blocks(**limits)(blocks))
    rows = found.select(*documents.columns, F.posexplode_outer("_chunks").alias("chunk_index", "_c"))
    out = rows.filter(F.col("_c").isNotNull()).select(
        *documents.columns,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("_c.page").alias("page"),
        F.col("_c.section").alias("section"),
        F.col("_c.content").alias("content"),
        F.col("_c.tokens").cast("bigint").alias("tokens"),
    )
    return out.withColumn("chunk_id", tx.chunk_id(F.col("document_id"), F.col("page"), F.col("section"), F.col("chunk_index")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.avg("tokens").alias("average_tokens"),
        F.count_distinct("page").alias("pages_with_chunks"),
    )


def sample_chunks(chunks: DataFrame) -> DataFrame:
    """Longest chunk per document, preferring page-less chunks and pages from five on."""
    preferred = F.col("page").isNull() | (F.col("page") >= 5)
    order = F.struct(preferred.alias("p"), F.col("tokens").alias("t"), (-F.col("chunk_index")).alias("i"))
    return chunks.groupBy("document_id").agg(
        F.max_by("chunk_id", order).alias("chunk_id"), F.max_by("tokens", order).alias("tokens")
    )


def ingestion_facets(chunks: DataFrame, statuses: DataFrame) -> DataFrame:
    """Counts by source status, document type, tier and role, in one long table."""

    def facet(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.groupBy(value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "value", "n")

    slim = chunks.select("document_type", "source_tier", "rag_roles")
    pairs = slim.select(
        F.explode_outer(
            F.concat(
                F.array(
                    F.struct(F.lit("document_type").alias("facet"), F.col("document_type").alias("value")),
                    F.struct(F.lit("source_tier").alias("facet"), F.col("source_tier").cast("string").alias("value")),
                ),
                F.transform("rag_roles", lambda r: F.struct(F.lit("rag_role").alias("facet"), r.alias("value"))),
            )
        ).alias("_f")
    )
    counted = pairs.groupBy("_f.facet", "_f.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(facet(statuses, "source_status", F.col("status")))


def knowledge_summary(chunks: DataFrame, default_model: str) -> DataFrame:
    """Distinct documents, chunks and the embedding model when all chunks share one."""
    models = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("embedding_model").alias("lo"), F.max("embedding_model").alias("hi")
    )
    return models.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.sum("chunks").alias("chunk_count"),
        F.when(F.min("lo") == F.max("hi"), F.min("lo")).otherwise(F.lit(default_model)).alias("embedding_method"),
    )


def catalog(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored documents with the manifest's fields where it knows them, else the chunk's own."""
    stored = chunks.groupBy("document_id").agg(
        F.min("title").alias("_title"),
        F.min("publisher").alias("_publisher"),
        F.min("document_type").alias("_type"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_distinct("page").alias("indexed_pages"),
    )
    listed = documents.select("document_id", "title", "publisher", "document_type", "license")
    return stored.join(listed, "document_id", "left").select(
        "document_id",
        F.coalesce("title", "_title").alias("title"),
        F.coalesce("publisher", "_publisher", F.lit("")).alias("publisher"),
        F.coalesce("document_type", "_type", F.lit("")).alias("document_type"),
        F.coalesce("license", F.lit("")).alias("license"),
        "chunk_count",
        "indexed_pages",
    )


def catalog_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("publisher"), F.lower("title"), "document_id")


def chunk_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("page", F.lit(0)), F.coalesce("section", F.lit("")), "chunk_id")
