"""Event-time windows and sessions over a stream of recorded values.

A replay delivers a recording again as many small files in a mixed order, the way a collector would have
delivered it. The jobs aggregate it with a watermark: state holds only windows and sessions that can still
grow, each row leaves them once it is final, and rows later than the watermark are counted and never dropped
unnoticed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import moments
from plumbline.streaming.jobs import KeyedLog, run_to_end

MICROS = 1_000_000


class LateRows(ValueError):
    """Rows came after the watermark, so a finished window or session lacks them."""


def deliveries(rows: DataFrame, at: str, slice_seconds: int, behind: int, key: str) -> Iterator[DataFrame]:
    """The rows in order of arrival: slices of event time, each row up to ``behind`` slices late.

    How late a row is follows from its ``key``. A slice of arrivals reads only its own range of time.
    """
    ends = rows.agg(F.min(F.unix_micros(at)).alias("low"), F.max(F.unix_micros(at)).alias("high")).first()
    if ends["low"] is None:
        return
    width = slice_seconds * MICROS
    first, last = ends["low"] // width, ends["high"] // width
    arrival = F.floor(F.unix_micros(at) / width) + F.pmod(F.xxhash64(key), F.lit(behind + 1))
    for number in range(first, last + behind + 1):
        low, high = (number - behind) * width, (number + 1) * width
        recent = (F.col(at) >= F.timestamp_micros(F.lit(low))) & (F.col(at) < F.timestamp_micros(F.lit(high)))
        yield rows.where(recent & (arrival == number))


def replay(parts: Iterator[DataFrame], folder: str, files: int, end: str | None = None) -> DataFrame:
    """A stream that delivers the parts one after the other, each as ``files`` files that form a batch.

    ``end`` names the column of event time for a last row, null in all other columns and a century later than
    all others: its watermark closes every window and session of a recording that is over, and its own stay open.
    """
    spark, schema = None, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        part.repartition(files).write.mode("append").parquet(folder)
    if spark is None:
        raise ValueError("a replay needs at least one part")
    if end is not None:
        last = spark.read.schema(schema).parquet(folder).agg(F.max(end)).first()[0]
        if last is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != end]
            far = F.timestamp_add("DAY", F.lit(36_500), F.lit(last)).alias(end)
            spark.range(1).select(*empty, far).select(*schema.fieldNames()).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def window_features(rows: DataFrame, at: str, value: str, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    """Time features of every event-time window of a key, tumbling or sliding; the same for streams and tables."""
    return moments(rows.groupBy(*keys, F.window(at, width, slide).alias("window")), value, keep_count=True)


def sessions(rows: DataFrame, at: str, value: str, keys: list[str], gap: str) -> DataFrame:
    """Bursts of a key: rows less than ``gap`` apart."""
    grouped = rows.groupBy(*keys, F.session_window(at, gap).alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum(value).alias("total"))


def drained(final: DataFrame, folder: str, name: str) -> DataFrame:
    """All rows that a windowed stream has closed; late rows are an error, as they are in no window."""
    log = KeyedLog(final.sparkSession, f"{folder}/{name}", final.schema, lambda rows: rows)
    late = run_to_end(final, folder, name, lambda batch, number: log.write(batch, number))
    if late:
        raise LateRows(f"{late} rows came later than the watermark allows")
    return log.read()


def stream_window_features(stream: DataFrame, folder: str, name: str, at: str, value: str, keys: list[str], delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Features of all windows of a replayed stream, written as the watermark closes them."""
    return drained(window_features(stream.withWatermark(at, delay), at, value, keys, width, slide), folder, name)


def stream_sessions(stream: DataFrame, folder: str, name: str, at: str, value: str, keys: list[str], delay: str, gap: str) -> DataFrame:
    """All sessions of a replayed stream, each written once when no row can extend it any more."""
    return drained(sessions(stream.withWatermark(at, delay), at, value, keys, gap), folder, name)
