"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def even_round(value: Column) -> Column:
    """Round half to even, as a whole number."""
    return F.bround(value, 0).cast("bigint")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def moments(grouped: GroupedData, value: str, keep_count: bool = False) -> DataFrame:
    """Eight time-domain features; skewness and kurtosis carry the small-sample correction.

    Only mergeable aggregates are used, so partial aggregation runs before the shuffle.
    """
    x = F.col(value)
    raw = grouped.agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_g2"),
    )
    n = F.col("n").cast("double")
    flat = F.col("_hi") == F.col("_lo")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.col("_g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).otherwise(F.col("_g2"))
    out = raw.withColumns(
        {
            "peak_to_peak": F.col("_hi") - F.col("_lo"),
            "crest_factor": safe_ratio(F.col("peak"), F.col("rms")),
            "skewness": F.when(flat, F.lit(0.0)).otherwise(skew),
            "kurtosis": F.when(flat, F.lit(0.0)).otherwise(kurt),
        }
    ).drop("_lo", "_hi", "_g1", "_g2")
    return out if keep_count else out.drop("n")
