"""Tabular sources and sinks: labelled CSV, evaluation cases, model artifacts and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("expected_source_ids", T.ArrayType(T.StringType())),
        T.StructField("expected_document_types", T.ArrayType(T.StringType())),
        T.StructField("answerable", T.BooleanType()),
    ]
)


def read_labelled_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All columns as text, so that validation names the fault; a missing header column is an error."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.toDF(*names)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases with their defaults."""
    none = F.array().cast("array<string>")
    return spark.read.schema(CASE).option("multiLine", "true").option("mode", "FAILFAST").json(path).withColumns(
        {
            "mode": F.coalesce("mode", F.lit("DIAGNOSTIC")),
            "expected_sources": F.coalesce("expected_source_ids", none),
            "expected_types": F.coalesce("expected_document_types", none),
            "answerable": F.coalesce("answerable", F.lit(True)),
        }
    ).drop("expected_source_ids", "expected_document_types")


def model_registry(spark: SparkSession, root: str) -> DataFrame:
    """One row per model metadata file below the root; a repeated model id is an error."""
    raw = spark.read.option("multiLine", "true").json(f"{root}/*/metadata.json").withColumn("_file", F.col("_metadata.file_path"))
    rows = raw.filter(F.col("model_id").isNotNull())
    body = [c for c in rows.columns if c != "model_id"]
    counted = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*body)).alias("_m"))
    unique = F.when(F.col("_n") == 1, F.col("model_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate model id: "), F.col("model_id"))))
    return counted.select(unique.alias("model_id"), "_m.*")


def active_model(registry: DataFrame, model_id: str | None = None) -> DataFrame:
    """The configured model, or the only one there is."""
    chosen = registry.filter(F.col("model_id") == model_id) if model_id else registry
    found = chosen.limit(2).count()
    if found != 1:
        raise LookupError(f"model {model_id} not found" if model_id else "active model is not configured unambiguously")
    return chosen


def model_catalog(metadata: DataFrame, importance: DataFrame) -> DataFrame:
    """Model rows with their features: channel and feature names come from ``channel__feature``."""
    parts = F.split("feature", "__", 2)
    features = importance.select("model_id", "importance", "rank", parts[0].alias("channel"), parts[1].alias("feature"))
    return metadata.join(features, "model_id", "left")


def write_reports(tables: Mapping[str, DataFrame], path: str, formats: Sequence[str] = ("parquet",)) -> None:
    """Write every report table below ``path`` in the given formats."""
    for name, df in tables.items():
        for kind in formats:
            writer = df.write.mode("overwrite")
            if kind == "csv":
                writer = writer.option("header", "true")
            writer.format(kind).save(f"{path}/{name}_{kind}")
