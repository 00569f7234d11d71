"""Manifest expansion, checksums, acquisition inventory and the stored chunk table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx

# Required manifest fields and the file types that hold documents.
MANIFEST_FIELDS = (
    "source_id",
    "title",
    "publisher",
    "official_url",
    "local_path",
    "source_tier",
    "rag_role",
    "license_status",
    "sha256",
    "file_type",
)
SINGLE_TYPES = ("pdf", "html")
COLLECTION_TYPE = "pdf_collection"
BUCKETS = 64
PROPERTIES = "_properties"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a manifest file; a manifest without the required fields is an error."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "sources" not in raw.columns or "manifest_version" not in raw.columns:
        raise ValueError("invalid source manifest structure")
    rows = raw.select("manifest_version", F.explode("sources").alias("_s")).select("manifest_version", "_s.*")
    missing = sorted(set(MANIFEST_FIELDS) - set(rows.columns))
    if missing:
        raise ValueError(f"manifest source missing fields: {missing}")
    return rows


def collection_digests(files: DataFrame) -> DataFrame:
    """SHA-256 over ``path NUL digest LF`` in path order, per collection.

    A digest of a sequence has to be fed in order, so a collection's lines (about a hundred bytes
    per file, no contents) stream through one task. They are sorted by Spark, spill as needed and
    are never held together.
    """
    listed = files.filter(F.col("collection").isNotNull()).select("collection", "path", "sha256")
    ordered = listed.repartition("collection").sortWithinPartitions("collection", "path")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for batch in batches:
            done = []
            for name, path, sha in batch.itertuples(index=False):
                if name != current:
                    if current is not None:
                        done.append((current, state.hexdigest(), count))
                    current, state, count = name, hashlib.sha256(), 0
                state.update(f"{path}\0{sha}\n".encode())
                count += 1
            if done:
                yield pd.DataFrame(done, columns=["collection", "collection_sha256", "files"])
        if current is not None:
            yield pd.DataFrame([(current, state.hexdigest(), count)], columns=["collection", "collection_sha256", "files"])

    return ordered.mapInPandas(digest, "collection string, collection_sha256 string, files bigint")


def source_statuses(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status per source. ``files``: collection (null for single files), path, sha256."""
    singles = files.filter(F.col("collection").isNull()).select(F.col("path").alias("local_path"), F.col("sha256").alias("_file_sha"))
    groups = collection_digests(files).withColumnRenamed("collection", "local_path")
    joined = manifest.join(singles, "local_path", "left").join(groups, "local_path", "left")
    single = F.col("file_type").isin(*SINGLE_TYPES)
    actual = F.when(single, F.col("_file_sha")).otherwise(F.col("collection_sha256"))
    status = (
        F.when(~(single | (F.col("file_type") == COLLECTION_TYPE)), "UNSUPPORTED")
        .when(actual.isNull(), "MISSING")
        .when(actual != F.col("sha256"), "INVALID")
        .otherwise("READY")
    )
    count = F.when(status != "READY", 0).when(single, 1).otherwise(F.col("files"))
    return joined.withColumns({"status": status, "document_count": count.cast("bigint")}).drop("_file_sha", "collection_sha256", "files")


def expand_documents(statuses: DataFrame, files: DataFrame) -> DataFrame:
    """One row per readable document: the file itself, or every file of a collection."""
    folder_of = F.when(F.col("file_type") == COLLECTION_TYPE, F.col("local_path"))
    ready = statuses.filter(F.col("status") == "READY").withColumn("_collection", folder_of)
    members = files.filter(F.col("collection").isNotNull()).select(
        F.col("collection").alias("_collection"), F.col("path").alias("member"), F.col("sha256").alias("member_sha")
    )
    found = ready.join(members, "_collection", "left")
    folder = F.element_at(F.split("member", "/"), -2)
    is_member = F.col("member").isNotNull()
    return found.select(
        tx.slug(F.when(is_member, F.concat_ws("_", "source_id", folder)).otherwise(F.col("source_id"))).alias("document_id"),
        "source_id",
        F.when(is_member, F.concat_ws(" — ", "title", F.upper(folder))).otherwise(F.col("title")).alias("title"),
        F.coalesce("member", "local_path").alias("local_path"),
        F.coalesce("member_sha", "sha256").alias("sha256"),
        F.when(is_member, F.upper(folder)).alias("bearing_id"),
    )


def unique_documents(documents: DataFrame) -> DataFrame:
    """The documents, or an error naming a repeated document id."""
    counted = documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in documents.columns if c != "document_id"])).alias("_d"))
    guarded = F.when(F.col("_n") == 1, F.col("document_id")).otherwise(F.raise_error(F.concat(F.lit("document id is not unique: "), F.col("document_id"))))
    return counted.select(guarded.alias("document_id"), "_d.*")


def inventory(expected: DataFrame, files: DataFrame, magic: str) -> DataFrame:
    """Expected against present archives: counts, size, signature faults and the partial flag."""
    signed = F.startswith(F.col("head"), F.lit(magic))
    present = files.select("name", "size", signed.alias("_ok"), F.lit(1).alias("_p"))
    return expected.join(present, "name", "left").agg(
        F.count(F.lit(1)).alias("expected_count"),
        F.count("_p").alias("present_count"),
        F.count_if(~F.col("_ok")).alias("bad_signatures"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        (F.count("_p") < F.count(F.lit(1))).alias("partial"),
    )


def stale_documents(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose stored chunks differ in ids, checksum or embedding version."""
    fresh = new.select("document_id", "chunk_id", F.col("sha256").alias("_n"), F.col("embedding_version").alias("_nv"))
    kept = stored.select("document_id", "chunk_id", F.col("sha256").alias("_o"), F.col("embedding_version").alias("_ov"))
    both = fresh.join(kept, ["document_id", "chunk_id"], "full")
    same = F.coalesce((F.col("_n") == F.col("_o")) & (F.col("_nv") == F.col("_ov")), F.lit(False))
    return both.groupBy("document_id").agg((~F.every(same)).alias("stale"), F.some(F.col("_n").isNotNull()).alias("_listed")).filter(
        F.col("_listed")
    ).drop("_listed")


def upsert_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with the new ones in their place, by chunk id."""
    return stored.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """Number of buckets a chunk table was created with, kept beside it; None if there is no table yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PROPERTIES}")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("buckets int").json(f"{path}/{PROPERTIES}").first()["buckets"]


def with_bucket(chunks: DataFrame, buckets: int) -> DataFrame:
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def write_chunks(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the buckets of the given documents only; other partitions stay as they are.

    The first write fixes the number of buckets. ``chunks`` must hold all rows of every bucket it
    touches (see ``merge_chunks``).
    """
    known = bucket_count(chunks.sparkSession, path)
    with_bucket(chunks, known or buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    if known is None:
        chunks.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/{PROPERTIES}")


def merge_chunks(new: DataFrame, path: str, replaced: DataFrame | None = None) -> DataFrame:
    """Rows of all buckets touched by ``new`` or ``replaced``: stored chunks of other documents plus the new ones."""
    spark = new.sparkSession
    buckets = bucket_count(spark, path) or BUCKETS
    gone = new.select("document_id") if replaced is None else replaced.select("document_id").union(new.select("document_id"))
    stored = spark.read.parquet(path)
    touched = with_bucket(gone.distinct(), buckets).select("bucket").distinct()  # at most one row per bucket
    kept = stored.join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
    return kept.join(gone.distinct(), "document_id", "left_anti").unionByName(new)


def delete_chunks(gone: DataFrame, path: str) -> None:
    """Remove the chunks of the documents in ``gone`` (document_id); a bucket left without rows is dropped."""
    spark = gone.sparkSession
    buckets = bucket_count(spark, path) or BUCKETS
    none = spark.createDataFrame([], spark.read.parquet(path).drop("bucket").schema)
    kept = merge_chunks(none, path, gone)
    left = {r["bucket"] for r in with_bucket(kept, buckets).select("bucket").distinct().collect()}  # bounded by the buckets
    touched = {r["bucket"] for r in with_bucket(gone.select("document_id"), buckets).select("bucket").distinct().collect()}
    write_chunks(kept, path)
    for bucket in touched - left:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def document_records(chunks: DataFrame, document_id: str) -> DataFrame:
    """Text and metadata of one document; the filter and the column list reach the scan."""
    return chunks.filter(F.col("document_id") == document_id).drop("vector")
