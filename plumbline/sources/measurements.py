"""Measurement index, channel normalisation, metadata and dataset validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File name grammar, operating conditions and labelled bearings.
FILE_PATTERN = r"^(N\d+_M\d+_F\d+)_(K[A-Z]?\d+)_(\d+)\.mat$"
CONDITIONS = (
    ("N15_M07_F10", 1500, 0.7, 1000),
    ("N09_M07_F10", 900, 0.7, 1000),
    ("N15_M01_F10", 1500, 0.1, 1000),
    ("N15_M07_F04", 1500, 0.7, 400),
)
LABELS = (
    ("K001", "healthy", None, None),
    ("KA01", "damaged", "artificial", "outer_ring_raceway"),
    ("KI01", "damaged", "artificial", "inner_ring_raceway"),
)


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONDITIONS), "condition string, rpm int, load_torque_nm double, radial_force_n int")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS), "bearing_id string, state string, fault_type string, damage_location string")


def index_measurements(paths: DataFrame, source: str, root: str = "") -> DataFrame:
    """One row per recognised file name in ``path``; a repeated measurement id stops the job."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = [F.regexp_extract(name, FILE_PATTERN, i) for i in (1, 2, 3)]
    found = paths.filter(F.rlike(name, F.lit(FILE_PATTERN))).select(
        parts[0].alias("condition"),
        parts[1].alias("bearing_id"),
        parts[2].cast("int").alias("run_index"),
        F.regexp_replace("path", "^" + root, "").alias("source_reference"),
    )
    run = F.when(F.col("run_index") < 100, F.lpad(F.col("run_index").cast("string"), 2, "0")).otherwise(F.col("run_index").cast("string"))
    keyed = found.withColumn("measurement_id", F.concat_ws(":", F.lit(source), "bearing_id", "condition", run))
    once = F.when(F.count(F.lit(1)) == 1, F.min("source_reference")).otherwise(
        F.raise_error(F.concat(F.lit("duplicate measurement id "), F.first("measurement_id"))).cast("string")
    )
    return keyed.groupBy("measurement_id", "bearing_id", "condition", "run_index").agg(once.alias("source_reference"))


def enrich(measurements: DataFrame) -> DataFrame:
    """Condition facts and ground truth from the fixed lookups; unlisted bearings are ``unknown``."""
    spark = measurements.sparkSession
    return (
        measurements.join(F.broadcast(conditions(spark)), "condition", "left")
        .join(F.broadcast(labels(spark)), "bearing_id", "left")
        .withColumn("state", F.coalesce("state", F.lit("unknown")))
    )


def normalise_signals(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel facts, rejects) from raw long rows.

    Raw columns: measurement_id, channel, raster, axis_index, axis_count, idx, t and x as text.
    Every rule is a mergeable count, so a long recording is never gathered.
    """
    time, value = F.expr("try_cast(t as double)"), F.expr("try_cast(x as double)")

    def finite(column: Column) -> Column:
        return ~(F.isnan(column) | column.isin(float("inf"), float("-inf")))

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    keys = ["measurement_id", "channel"]
    facts = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.max("raster").alias("raster"),
        F.count_distinct("idx").alias("_positions"),
        count(F.col("axis_index").isNull() | ~F.col("axis_index").between(1, F.col("axis_count"))).alias("_axis"),
        count(F.col("t").isNull() != F.col("x").isNull()).alias("_length"),
        count(F.col("x").isNotNull() & value.isNull()).alias("_text_x"),
        count(F.col("t").isNotNull() & time.isNull()).alias("_text_t"),
        count(~finite(value)).alias("_inf_x"),
        count(~finite(time)).alias("_inf_t"),
    )
    rules = (
        ("MISSING_NAME_OR_RASTER", (F.coalesce("channel", F.lit("")) == "") | (F.coalesce("raster", F.lit("")) == "")),
        ("DUPLICATE_CHANNEL", F.col("_positions") < F.col("sample_count")),
        ("INVALID_AXIS", F.col("_axis") > 0),
        ("LENGTH_MISMATCH", F.col("_length") > 0),
        ("NON_NUMERIC_SIGNAL", F.col("_text_x") > 0),
        ("NON_NUMERIC_TIME", F.col("_text_t") > 0),
        ("NON_FINITE_SIGNAL", F.col("_inf_x") > 0),
        ("NON_FINITE_TIME", F.col("_inf_t") > 0),
    )
    judged = facts.withColumn("errors", F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])))
    out = judged.select(*keys, "raster", "sample_count", "errors")
    return out.filter(F.size("errors") == 0).drop("errors"), out.filter(F.size("errors") > 0)


def sample_blocks(signals: DataFrame, block: int) -> DataFrame:
    """Samples as arrays of at most ``block`` values per row, in order."""
    grouped = signals.groupBy("measurement_id", "channel", F.floor(F.col("idx") / block).alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("idx", "t", "x")))
    return grouped.agg(rows.alias("_r")).select(
        "measurement_id", "channel", "block", F.col("_r.t").alias("time"), F.col("_r.x").alias("values")
    )


def measurement_meta(raw: DataFrame) -> DataFrame:
    """Id in file, recording time and duration from the recording's JSON header."""
    def at(path: str) -> Column:
        return F.get_json_object("header", path)

    return raw.select(
        "measurement_id",
        F.expr("try_cast(get_json_object(header, '$.Info.MeasurementID') as bigint)").alias("measurement_id_in_file"),
        at("$.Description.General.DateTime").alias("recorded_at_raw"),
        F.expr("try_cast(get_json_object(header, '$.Description.Measurement.Length') as double)").alias("measurement_duration_sec"),
    )


def validate_dataset(measurements: DataFrame, channels: DataFrame, rejects: DataFrame) -> DataFrame:
    """Dataset counts in long form: states, conditions, channel lengths, rejects and the verdict."""

    def facet(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.groupBy(F.col(value).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("shortest"), F.lit(None).cast("bigint").alias("longest")
        ).select(F.lit(name).alias("facet"), "value", "n", "shortest", "longest")

    lengths = channels.groupBy(F.col("channel").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_count").alias("shortest"), F.max("sample_count").alias("longest")
    ).select(F.lit("channel").alias("facet"), "value", "n", "shortest", "longest")
    bad = rejects.agg(F.count_distinct("measurement_id").alias("n")).select(
        F.lit("status").alias("facet"),
        F.when(F.col("n") == 0, "pass").otherwise("fail").alias("value"),
        "n",
        F.lit(None).cast("bigint").alias("shortest"),
        F.lit(None).cast("bigint").alias("longest"),
    )
    parts = [facet(measurements, "state", "state"), facet(measurements, "condition", "condition"), lengths, bad]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inspection_summary(files: DataFrame) -> DataFrame:
    """File counts by lower-case extension."""
    extension = F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), r"^.+(\.[^.]+)$", 1)
    return files.groupBy(F.when(extension == "", "[none]").otherwise(extension).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Paths and sizes below a folder; the content column is pruned unless a caller selects it."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; an unknown id is an empty result."""
    return df.filter(F.col(column) == value)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df
