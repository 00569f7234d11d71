"""Inspection images: scan, validation and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import images as im
from plumbline.functions import text as tx


def validate_files(files: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``mime`` and ``rejection`` to rows (image_id, content, declared_mime)."""
    mime = im.sniffed_mime(F.col("content"))
    declared = F.lower(F.trim(F.element_at(F.split("declared_mime", ";"), 1)))
    size = F.length("content")
    return files.withColumns(
        {
            "mime": mime,
            "rejection": F.when(size == 0, "EMPTY")
            .when(size > max_bytes, "TOO_LARGE")
            .when(mime.isNull(), "UNSUPPORTED")
            .when(declared != mime, "MIME_MISMATCH"),
        }
    )


def validate_decoded(images: DataFrame, max_side: int) -> DataFrame:
    """Size rules on decoded images (columns height, width; negative = not decodable)."""
    low, high = F.least("height", "width"), F.greatest("height", "width")
    return images.withColumn(
        "rejection",
        F.when(low < 0, "NOT_DECODABLE").when(low < im.SMALLEST_SIDE, "TOO_SMALL").when(high > max_side, "TOO_BIG"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded PNG and JPEG files of a folder; undecodable files stay as rows."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select(
        F.col("image.origin").alias("origin"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def with_metrics(images: DataFrame) -> DataFrame:
    return images.withColumn("_m", im.image_metrics("height", "width", "channels", "data")).select(
        *[c for c in images.columns if c != "data"], "_m.*"
    )


def observe(metrics: DataFrame, done: DataFrame) -> DataFrame:
    """Observation per new image; images already observed are skipped, failed ones keep a row."""
    fresh = metrics.join(done.select("image_id"), "image_id", "left_anti")
    limits = im.quality_limits(F.col("brightness"), F.col("contrast"), F.col("edge_variance"), F.least("height", "width"))
    failed = F.col("brightness").isNull()
    return fresh.withColumn("limitations", F.when(failed, F.array(F.lit("analysis_failed"))).otherwise(limits)).withColumns(
        {
            "quality": F.when(failed, "FAILED").when(F.size("limitations") == 0, "USABLE").otherwise("LOW_QUALITY"),
            "observation_id": F.when(F.size("limitations") == 0, tx.short_hash("visual_", F.col("image_id"), F.lit("image_quality"))),
        }
    )


def attach(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Attach images (image_id, equipment_id, run_id) to runs (run_id, equipment_id, image_id).

    An image of other equipment, or one another run owns, is refused.
    """
    owned = images.select("image_id", F.col("equipment_id").alias("_rig"), F.col("run_id").alias("_run"), F.lit(1).alias("_found"))
    return requests.join(owned, "image_id", "left").withColumn(
        "rejection",
        F.when(F.col("_found").isNull(), "NOT_FOUND")
        .when(F.col("_rig") != F.col("equipment_id"), "OTHER_EQUIPMENT")
        .when(F.col("_run").isNotNull() & (F.col("_run") != F.col("run_id")), "OWNED_BY_OTHER_RUN"),
    ).drop("_rig", "_run", "_found")


def run_images(images: DataFrame, observations: DataFrame) -> DataFrame:
    return images.join(observations, "image_id", "left")
