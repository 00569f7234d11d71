"""Windows, sampling facts and features over long-form signals.

A long-form signal row is (measurement_id, channel, idx, t, x). All group keys below include a
window or block number, so no task ever holds a whole recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import even_round, moments
from plumbline.operators.ordered import exact_quantiles, join_facts, with_next

# Channels recorded at the nominal high rate, and that rate in hertz.
HIGH_RATE_CHANNELS = ("phase_current_1", "phase_current_2", "vibration_1")
HIGH_RATE_HZ = 64_000.0

TIME_FEATURES = ("mean", "std", "rms", "peak", "peak_to_peak", "crest_factor", "skewness", "kurtosis")
FREQUENCY_FEATURES = (
    "dominant_frequency_hz",
    "spectral_centroid_hz",
    "spectral_energy",
    "spectral_entropy",
)
CHANNEL = ("measurement_id", "channel")


def window_shape(rate_hz: float, duration_sec: float, overlap: float) -> tuple[int, int]:
    """Window size and step in samples, both rounded half to even."""
    if rate_hz <= 0 or duration_sec <= 0:
        raise ValueError("sampling rate and duration must be positive")
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    size = round(rate_hz * duration_sec)
    if size < 1:
        raise ValueError("window size rounded to zero samples")
    return size, max(1, round(size * (1.0 - overlap)))


def window_label(number: Column) -> Column:
    return F.concat(F.lit("w"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def window_bounds(channels: DataFrame, size: Column, step: Column) -> DataFrame:
    """One row per complete window of every channel row that carries ``sample_count``."""
    starts = F.when(
        F.col("sample_count") >= size,
        F.sequence(F.lit(0).cast("bigint"), F.col("sample_count") - size, step),
    )
    return channels.select("*", F.posexplode(starts).alias("window", "window_start")).withColumns(
        {"window_end": F.col("window_start") + size, "window_id": window_label(F.col("window"))}
    )


def assign_windows(signals: DataFrame, size: int, step: int) -> DataFrame:
    """Attach the number of every window a sample belongs to (arithmetic, no range join)."""
    idx = F.col("idx")
    last = F.floor(idx / step)
    if step >= size:
        return signals.withColumn("window", last).filter(idx - last * step < size)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((idx - (size - 1)) / step))
    return signals.withColumn("window", F.explode(F.sequence(first, last)))


def complete_windows(signals: DataFrame, size: int, step: int, keys: Sequence[str] = CHANNEL, **aggs: Column) -> DataFrame:
    """Aggregate per window and keep complete windows only."""
    grouped = assign_windows(signals, size, step).groupBy(*keys, "window")
    return grouped.agg(F.count("x").alias("_n"), *[c.alias(n) for n, c in aggs.items()]).filter(F.col("_n") == size).drop("_n")


def time_features(signals: DataFrame, size: int, step: int, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Time-domain features of every complete window."""
    grouped = assign_windows(signals, size, step).groupBy(*keys, "window")
    return moments(grouped, "x", keep_count=True).filter(F.col("n") == size).drop("n")


def channel_features(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time-domain features of whole recordings, merged from partial aggregates."""
    return moments(signals.groupBy(*keys), "x", keep_count=True)


def to_long(features: DataFrame, keys: Sequence[str], names: Sequence[str], signal: Column | None = None) -> DataFrame:
    """Unpivot feature columns to (signal, feature, value) rows."""
    base = features if signal is None else features.withColumn("signal", signal)
    return base.unpivot([*keys, "signal"], list(names), "feature", "value")


def to_wide(long: DataFrame, keys: Sequence[str], channels: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One column per ``channel__feature``; the column list is fixed by the specification."""
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("signal") == c) & (F.col("feature") == f), F.col("value"))).alias(f"{c}__{f}")
            for c in channels
            for f in names
        ]
    )


def window_rms(signals: DataFrame, size: int, step: int, keys: Sequence[str] = CHANNEL) -> DataFrame:
    return complete_windows(signals, size, step, keys, rms=F.sqrt(F.avg(F.col("x") * F.col("x"))))


def nominal_rate(channel: Column, raster: Column) -> Column:
    """Rate named by the channel, else by a raster text such as ``4kHz`` or ``1Hz``."""
    number = r"(?is)^.*?(\d+(?:\.\d+)?)"
    kilo = F.regexp_extract(raster, number + r"kHz$", 1)
    hertz = F.regexp_extract(raster, number + r"Hz$", 1)
    return (
        F.when(channel.isin(*HIGH_RATE_CHANNELS), F.lit(HIGH_RATE_HZ))
        .when(kilo != "", kilo.cast("double") * 1000)
        .when(hertz != "", hertz.cast("double"))
    )


def sampling_facts(signals: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Sample count, duration, observed rate and the uniform-axis test per channel."""
    facts = signals.groupBy(*keys).agg(
        F.count("x").alias("sample_count"),
        (F.max_by("t", "idx") - F.min_by("t", "idx")).alias("_span"),
    )
    steps = (
        with_next(signals.select(*keys, "idx", "t"), keys, "idx", {"_next": "t"})
        .withColumn("_step", F.col("_next") - F.col("t"))
        .filter(F.col("_step").isNotNull())
        .select(*keys, "_step")
    )
    middle = exact_quantiles(steps, keys, "_step", {"_median": 0.5})
    tolerance = F.greatest(F.abs("_median") * 1e-6, F.lit(1e-12)) + F.lit(1e-3) * F.abs("_median")
    uniform = (
        join_facts(steps, middle, keys, F.col("_step"))
        .groupBy(*keys)
        .agg(F.every((F.col("_median") > 0) & (F.abs(F.col("_step") - F.col("_median")) <= tolerance)).alias("uniform_time_axis"))
    )
    positive = F.when(F.col("_span") > 0, F.col("_span"))
    return (
        facts.join(uniform, list(keys), "left")
        .withColumn("duration_sec", positive)
        .withColumn("observed_rate_hz", (F.col("sample_count") - 1) / positive)
        .drop("_span")
    )


def quality_flags(facts: DataFrame, signals: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Constant signal, sampling deviation above five percent and non-uniform axis."""
    spread = signals.groupBy(*keys).agg((F.max("x") - F.min("x")).alias("_ptp"))
    nominal, observed = F.col("nominal_rate_hz"), F.col("observed_rate_hz")
    return (
        facts.join(spread, list(keys))
        .withColumn("constant_signal", F.col("_ptp") == 0)
        .withColumn(
            "sampling_deviation",
            F.coalesce((F.abs(observed - nominal) / F.when(nominal != 0, nominal)) > 0.05, F.lit(False)),
        )
        .withColumn("nonuniform_axis", F.coalesce(~F.col("uniform_time_axis"), F.lit(False)))
        .drop("_ptp")
    )


def align_channels(channels: DataFrame, required: Sequence[str], window_end: int) -> DataFrame:
    """Per measurement: the required channels exist, share one rate and cover the window end."""
    wanted = F.col("channel").isin(*required)
    reference = F.col("channel") == required[0]
    facts = channels.filter(wanted).groupBy("measurement_id").agg(
        F.count_distinct("channel").alias("present"),
        F.min("nominal_rate_hz").alias("_lo"),
        F.max("nominal_rate_hz").alias("_hi"),
        F.max(F.when(F.col("nominal_rate_hz").isNull(), 1).otherwise(0)).alias("_unrated"),
        F.min("sample_count").alias("shortest"),
        F.max(F.when(reference, F.col("sample_count"))).alias("reference_count"),
    )
    return facts.select(
        "measurement_id",
        F.when(F.col("present") < len(required), "MISSING_CHANNEL")
        .when(F.col("_unrated") == 1, "NO_VERIFIED_RATE")
        .when(F.col("_lo") != F.col("_hi"), "RATE_MISMATCH")
        .when(
            F.col("shortest")
            < F.floor(F.col("reference_count") / window_end) * window_end,
            "CHANNEL_TOO_SHORT",
        )
        .otherwise("OK")
        .alias("alignment"),
        "present",
        "shortest",
        "reference_count",
    )


def preview(signals: DataFrame, counts: DataFrame, max_points: int, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Evenly spread sample positions: distinct truncated linspace indices per channel."""
    if not 32 <= max_points <= 512:
        raise ValueError("max_points must be between 32 and 512")
    n, points = F.col("sample_count"), F.least(F.col("sample_count"), F.lit(max_points).cast("bigint"))
    positions = counts.select(
        *keys,
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0).cast("bigint"), points - 1),
                    lambda i: F.when(points == 1, F.lit(0).cast("bigint")).otherwise(F.floor(i * (n - 1) / (points - 1))),
                )
            )
        ).alias("idx"),
    )
    return signals.join(positions, [*keys, "idx"])


def window_size_column(rate: Column, duration: Column) -> Column:
    return even_round(rate * duration)
