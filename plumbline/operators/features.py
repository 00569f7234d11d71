"""Feature tables from array recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import even_round, safe_ratio
from plumbline.functions.spectrum import frequency_features
from plumbline.operators.ordered import join_facts
from plumbline.operators.signals import FREQUENCY_FEATURES, TIME_FEATURES, to_wide, window_label, window_size_column

REQUIRED_SPEC_FIELDS = (
    "diagnostic_channels",
    "window_duration_sec",
    "overlap_percent",
    "time_domain_features",
    "frequency_domain_features",
    "split",
)


def missing_fields(specs: DataFrame, fields: str, required: Sequence[str]) -> DataFrame:
    """Required names that a row's list of fields lacks, in their own order; the table form of check_spec."""
    return specs.withColumn("missing", F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce(fields, F.array().cast("array<string>"))))


def check_spec(spec: dict) -> dict:
    """Reject a feature specification that is incomplete or would let windows leak across a split."""
    missing = sorted(set(REQUIRED_SPEC_FIELDS) - set(spec))
    if missing:
        raise ValueError(f"feature specification lacks {missing}")
    if spec["split"].get("group") != "measurement_id":
        raise ValueError("windows of one measurement must stay in one split")
    return spec


def array_moments(samples: Column) -> dict[str, Column]:
    """Time-domain features of an array column, inside the row: no explode and no shuffle."""
    n = F.size(samples).cast("double")

    def mean_of(fn) -> Column:
        return F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + fn(v)) / n

    mean = mean_of(lambda v: v)
    low, high = F.array_min(samples), F.array_max(samples)
    return {
        "_n": n,
        "mean": mean,
        "_sq": mean_of(lambda v: v * v),
        "peak": F.greatest(F.abs(low), F.abs(high)),
        "peak_to_peak": high - low,
    }


def array_time_features(df: DataFrame, samples: str = "samples") -> DataFrame:
    base = df.withColumns(array_moments(F.col(samples)))
    mean, n = F.col("mean"), F.col("_n")

    def central(power: int) -> Column:
        def term(acc, v):
            d = v - mean
            out = d
            for _ in range(power - 1):
                out = out * d
            return acc + out

        return F.aggregate(F.col(samples), F.lit(0.0), term) / n

    flat = F.col("peak_to_peak") == 0
    shaped = base.withColumns({f"_m{p}": central(p) for p in (2, 3, 4)})
    m2 = F.col("_m2")
    g1 = F.col("_m3") / F.pow(m2, F.lit(1.5))
    g2 = F.col("_m4") / (m2 * m2) - 3
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).otherwise(g2)
    rms = F.sqrt("_sq")
    return shaped.withColumns(
        {
            "std": F.when(flat, F.lit(0.0)).otherwise(F.sqrt(m2)),
            "rms": rms,
            "crest_factor": safe_ratio(F.col("peak"), rms),
            "skewness": F.when(flat, F.lit(0.0)).otherwise(skew),
            "kurtosis": F.when(flat, F.lit(0.0)).otherwise(kurt),
        }
    ).drop("_n", "_sq", "_m2", "_m3", "_m4")


def array_feature_table(windows: DataFrame, channel: str) -> DataFrame:
    """All time and frequency features of complete windows, one row per window.

    ``unknown`` states never enter a feature table. A non-finite sample fails the job.
    """
    labelled = windows.filter(F.col("state").isin("healthy", "damaged"))
    keys = [c for c in windows.columns if c not in ("samples", "rate_hz")]
    wide = array_time_features(labelled).withColumn("_f", frequency_features("samples", "rate_hz"))
    return wide.select(
        *keys,
        *[F.col(f).alias(f"{channel}__{f}") for f in TIME_FEATURES],
        *[F.col(f"_f.{f}").alias(f"{channel}__{f}") for f in FREQUENCY_FEATURES],
    )


def window_plan(channels: DataFrame, spec: dict) -> DataFrame:
    """Per measurement: size, step and number of its windows, or why it has no place in the feature table.

    ``channels`` has measurement_id, state, channel, nominal_rate_hz and sample_count. The first channel of the
    specification is the reference whose windows all channels must fill, at its rate.
    """
    required = list(check_spec(spec)["diagnostic_channels"])
    reference = F.col("channel") == required[0]
    facts = channels.filter(F.col("channel").isin(*required)).groupBy("measurement_id").agg(
        F.count_distinct("channel").alias("_present"),
        F.max(F.when(reference, F.col("nominal_rate_hz"))).alias("rate_hz"),
        F.max(F.when(reference, F.col("sample_count"))).alias("_count"),
        F.min("sample_count").alias("_shortest"),
        F.every(F.col("nominal_rate_hz").isNotNull()).alias("_rated"),
        (F.min("nominal_rate_hz") == F.max("nominal_rate_hz")).alias("_one_rate"),
    )
    states = channels.groupBy("measurement_id").agg(F.max("state").alias("state"))
    size = window_size_column(F.col("rate_hz"), F.lit(float(spec["window_duration_sec"])))
    step = F.greatest(F.lit(1).cast("bigint"), even_round(F.col("size") * F.lit(1.0 - float(spec["overlap_percent"]) / 100.0)))
    windows = F.when(F.col("_count") >= F.col("size"), F.floor((F.col("_count") - F.col("size")) / F.col("step")) + 1).otherwise(0)
    sized = states.join(facts, "measurement_id", "left").withColumn("size", size).withColumn("step", step).withColumn("windows", windows)
    short = (F.col("windows") > 0) & (F.col("_shortest") < (F.col("windows") - 1) * F.col("step") + F.col("size"))
    code = (
        F.when(~F.coalesce(F.col("state").isin("healthy", "damaged"), F.lit(False)), "STATE_UNKNOWN")
        .when(F.coalesce("_present", F.lit(0)) < len(required), "MISSING_CHANNEL")
        .when(~F.col("_rated"), "NO_VERIFIED_RATE")
        .when(~F.col("_one_rate"), "RATE_MISMATCH")
        .when(F.col("size") < 1, "EMPTY_WINDOW")
        .when(short, "CHANNEL_TOO_SHORT")
    )
    return sized.select("measurement_id", "rate_hz", "size", "step", F.col("windows").cast("bigint").alias("windows"), code.alias("reject_code"))


def spec_feature_table(signals: DataFrame, plan: DataFrame, spec: dict) -> DataFrame:
    """One row per window of the reference channel with a column ``channel__feature`` for all that the specification names.

    Windows are keys made by arithmetic on the sample number, so no task holds a recording; a window's samples
    (as many as its size) meet in one row for the features. A feature that is not finite fails the job.
    """
    channels = list(check_spec(spec)["diagnostic_channels"])
    timed, spectral = list(spec["time_domain_features"]), list(spec["frequency_domain_features"])
    unknown = sorted((set(timed) - set(TIME_FEATURES)) | (set(spectral) - set(FREQUENCY_FEATURES)))
    if unknown:
        raise ValueError(f"feature specification names unknown features {unknown}")
    fit = plan.filter(F.col("reject_code").isNull()).select("measurement_id", "rate_hz", "size", "step", "windows")
    wanted = signals.filter(F.col("channel").isin(*channels)).select("measurement_id", "channel", "idx", F.col("x").cast("double").alias("x"))
    placed = join_facts(wanted, fit, ["measurement_id"], F.col("idx"))
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("idx") - F.col("size") + 1) / F.col("step")))
    last = F.least(F.floor(F.col("idx") / F.col("step")), F.col("windows") - 1)
    member = F.filter(F.when(first <= last, F.sequence(first, last)), lambda w: F.col("idx") < w * F.col("step") + F.col("size"))
    windows = placed.withColumn("window", F.explode_outer(member)).filter(F.col("window").isNotNull())
    grouped = windows.groupBy("measurement_id", "window", "channel").agg(
        F.first("rate_hz").alias("rate_hz"),
        F.first("size").alias("size"),
        F.first("step").alias("step"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("samples"),
    )
    features = array_time_features(grouped)
    if spectral:
        features = features.withColumn("_f", frequency_features("samples", "rate_hz"))
    values = [F.struct(F.lit(name).alias("feature"), F.col(name).alias("value")) for name in timed]
    values += [F.struct(F.lit(name).alias("feature"), F.col(f"_f.{name}").alias("value")) for name in spectral]
    long = features.select("measurement_id", "window", "size", "step", F.col("channel").alias("signal"), F.inline(F.array(*values)))
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    long = long.withColumn("value", F.when(sound, F.col("value")).otherwise(F.raise_error(F.lit("a feature is not finite")).cast("double")))
    wide = to_wide(long, ["measurement_id", "window", "size", "step"], channels, [*timed, *spectral])
    start = F.col("window") * F.col("step")
    return wide.select(
        "measurement_id",
        window_label(F.col("window")).alias("window_id"),
        start.alias("window_start"),
        (start + F.col("size")).alias("window_end"),
        *[f"{c}__{f}" for c in channels for f in (*timed, *spectral)],
    )
