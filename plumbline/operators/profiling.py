"""Statistical profile of a feature table and of window layouts.

Feature rows are long: (measurement_id, bearing_id, condition, state, signal, feature, value).
Few groups hold all rows here, so every statistic is either a mergeable aggregate or an exact
distributed quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import even_round
from plumbline.operators.ordered import exact_quantiles
from plumbline.operators.signals import CHANNEL, FREQUENCY_FEATURES, assign_windows, window_shape

# Candidate window layouts (seconds, overlap), the chosen one, the effect bound
# for recommended features and the outlier reach.
WINDOW_CANDIDATES = ((0.25, 0.0), (0.25, 0.5), (0.5, 0.0), (0.5, 0.5), (1.0, 0.0), (1.0, 0.5))
SELECTED_WINDOW = (1.0, 0.0)
RECOMMENDED_EFFECT = 0.5
OUTLIER_REACH = 3.0
ALL = "ALL"


def summary8(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean, population std, median, quartiles, minimum and maximum per key."""
    v = F.col("_v")
    plain = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    return exact_quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, plain)


def with_all_level(df: DataFrame, column: str = "condition") -> DataFrame:
    """Each row once under its own level and once under ``ALL``."""
    return df.withColumn(column, F.explode(F.array(F.lit(ALL), F.col(column))))


def feature_summary(long: DataFrame) -> DataFrame:
    return summary8(with_all_level(long), ["signal", "feature", "state", "condition"])


def bearing_summary(long: DataFrame) -> DataFrame:
    return summary8(long, ["bearing_id", "state", "signal", "feature"])


def state_effects(long: DataFrame) -> DataFrame:
    """Cohen's d (damaged minus healthy) per signal, feature and condition, with an ALL level."""
    grouped = with_all_level(long).groupBy("signal", "feature", "condition")

    def of(state: str, fn) -> Column:
        return fn(F.when(F.col("state") == state, F.col("value")))

    raw = grouped.agg(
        *[
            of(state, fn).alias(f"{state}_{name}")
            for state in ("healthy", "damaged")
            for name, fn in (("count", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    nh, nd = F.col("healthy_count"), F.col("damaged_count")
    pooled = ((nh - 1) * F.col("healthy_var") + (nd - 1) * F.col("damaged_var")) / F.nullif(nh + nd - 2, F.lit(0))
    effect = F.when(
        (nh >= 2) & (nd >= 2) & (pooled > 0), (F.col("damaged_mean") - F.col("healthy_mean")) / F.sqrt(pooled)
    ).otherwise(0.0)
    return (
        raw.filter((nh > 0) & (nd > 0))
        .withColumn("cohens_d", effect)
        .drop("healthy_var", "damaged_var")
    )


def condition_effects(long: DataFrame) -> DataFrame:
    """Spread of per-condition means, with the means as a JSON map ordered by condition."""
    means = long.groupBy("signal", "feature", "state", "condition").agg(F.avg("value").alias("m"))
    out = means.groupBy("signal", "feature", "state").agg(
        F.count("m").alias("condition_count"),
        F.min("m").alias("min_condition_mean"),
        F.max("m").alias("max_condition_mean"),
        F.avg(F.abs("m")).alias("_overall"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "m"))))).alias("condition_means_json"),
    )
    spread = (F.col("max_condition_mean") - F.col("min_condition_mean")) / F.nullif(F.col("_overall"), F.lit(0.0))
    return out.withColumn("relative_mean_spread", F.coalesce(spread, F.lit(0.0))).drop("_overall")


def correlations(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long-form correlation matrix from one aggregation; a constant column gives NULL."""
    names = sorted(features)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("feature"), F.lit(b).alias("other"), F.col(f"c{i}").alias("corr"))
            for i, pair in enumerate(pairs)
            for a, b in {pair, pair[::-1]}
        ]
    )
    return row.select(F.inline(cells)).withColumn(
        "corr", F.when(F.isnan("corr"), F.lit(None).cast("double")).otherwise(F.col("corr"))
    )


def amplitude_outliers(signals: DataFrame) -> DataFrame:
    """Recordings whose largest amplitude exceeds Q3 + 3 IQR of their channel; only flagged."""
    peaks = signals.groupBy("measurement_id", "state", "channel").agg(F.max(F.abs("x")).alias("max_abs"))
    fences = exact_quantiles(peaks, ["channel"], "max_abs", {"_q1": 0.25, "_q3": 0.75}).select(
        "channel", (F.col("_q3") + OUTLIER_REACH * (F.col("_q3") - F.col("_q1"))).alias("threshold")
    )
    return peaks.join(fences, "channel").withColumn("is_outlier", F.col("max_abs") > F.col("threshold"))


def channel_distributions(facts: DataFrame) -> DataFrame:
    """How many recordings per channel have each nominal rate, and how many a non-uniform axis."""
    rate = F.coalesce(F.col("nominal_rate_hz").cast("string"), F.lit("unknown"))
    return facts.groupBy("channel", rate.alias("nominal_rate")).agg(
        F.count(F.lit(1)).alias("recordings"),
        F.count_if(~F.col("uniform_time_axis")).alias("nonuniform"),
    )


def compare_windowings(signals: DataFrame, rate_hz: float, candidates=WINDOW_CANDIDATES, selected=SELECTED_WINDOW) -> DataFrame:
    """Window totals, RMS variation and memory for every candidate layout, from one scan.

    Each sample is expanded to (candidate, window) pairs; the count per sample is fixed by the
    layouts, and partial aggregation folds them before the shuffle.
    """
    shapes = {c: window_shape(rate_hz, *c) for c in candidates}
    idx = F.col("idx")

    def membership(number: int, size: int, step: int) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), F.ceil((idx - (size - 1)) / step))
        last = F.floor(idx / step)
        numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda w: F.struct(F.lit(number).alias("c"), w.alias("w")))

    memberships = [membership(i, *shapes[c]) for i, c in enumerate(candidates)]
    sizes = F.array(*[F.lit(shapes[c][0]).cast("bigint") for c in candidates])
    recording = ["measurement_id", "state"]
    windows = (
        signals.select(*recording, "x", F.explode_outer(F.flatten(F.array(*memberships))).alias("_m"))
        .filter(F.col("_m").isNotNull())
        .groupBy(*recording, F.col("_m.c").alias("c"), F.col("_m.w").alias("w"))
        .agg(F.count("x").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
        .filter(F.col("n") == F.element_at(sizes, F.col("c") + 1))
    )
    found = windows.groupBy(*recording, "c").agg(
        F.count("rms").alias("windows"), F.stddev_pop("rms").alias("_sd"), F.avg("rms").alias("_mean")
    )
    grid = signals.select(*recording).distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))))
    per_recording = (
        grid.join(found, [*recording, "c"], "left")
        .withColumn("windows", F.coalesce("windows", F.lit(0)))
        .withColumn("rms_cv", F.when(F.col("_mean") == 0, 0.0).otherwise(F.col("_sd") / F.col("_mean")))
    )
    totals = per_recording.groupBy("c").agg(
        F.sum("windows").alias("total_windows"),
        F.sum(F.when(F.col("state") == "healthy", F.col("windows")).otherwise(0)).alias("healthy_windows"),
        F.sum(F.when(F.col("state") == "damaged", F.col("windows")).otherwise(0)).alias("damaged_windows"),
        F.min("windows").alias("min_windows"),
        F.max("windows").alias("max_windows"),
        F.avg("windows").alias("mean_windows"),
    )
    middle = exact_quantiles(per_recording, ["c"], "rms_cv", {"median_rms_cv": 0.5})
    durations = F.array(*[F.lit(float(d)) for d, _ in candidates])
    overlaps = F.array(*[F.lit(int(o * 100)) for _, o in candidates])
    chosen = F.lit(list(candidates).index(selected))
    at = F.col("c") + 1
    return totals.join(middle, "c", "left").select(
        F.element_at(durations, at).alias("window_duration_sec"),
        F.element_at(overlaps, at).cast("bigint").alias("overlap_percent"),
        F.element_at(sizes, at).alias("window_samples"),
        "total_windows",
        "healthy_windows",
        "damaged_windows",
        "min_windows",
        "max_windows",
        "mean_windows",
        "median_rms_cv",
        (F.col("total_windows") * F.element_at(sizes, at) * 8 / F.lit(1024.0**3)).alias("memory_gib"),
        (F.col("c") == chosen).alias("selected"),
    )


def split_plan(measurements: DataFrame) -> DataFrame:
    """Recordings per bearing and state, and whether a bearing hold-out keeps both classes."""
    per_bearing = measurements.groupBy("bearing_id").agg(
        F.count_if(F.col("state") == "healthy").alias("healthy"),
        F.count_if(F.col("state") == "damaged").alias("damaged"),
    )
    verdict = per_bearing.agg(
        F.count_if(F.col("healthy") > 0).alias("healthy_bearings"),
        F.count_if(F.col("damaged") > 0).alias("damaged_bearings"),
    )
    return verdict.withColumn("bearing_split_feasible", (F.col("healthy_bearings") >= 2) & (F.col("damaged_bearings") >= 2))


def bearing_states(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("bearing_id", "state").agg(F.count(F.lit(1)).alias("recordings"))


def recommend_features(effects: DataFrame, features: Sequence[str] = FREQUENCY_FEATURES) -> DataFrame:
    return (
        effects.filter((F.col("condition") != ALL) & F.col("feature").isin(*features))
        .groupBy("feature")
        .agg(F.avg(F.abs("cohens_d")).alias("mean_abs_d"))
        .filter(F.col("mean_abs_d") >= RECOMMENDED_EFFECT)
    )


def feature_spec(recommended: DataFrame, channels: Sequence[str], time_features: Sequence[str], selected=SELECTED_WINDOW) -> DataFrame:
    """One-row specification of the next feature build; the feature list is short by definition."""
    return recommended.agg(F.array_sort(F.collect_set("feature")).alias("frequency_domain_features")).select(
        F.array(*[F.lit(c) for c in channels]).alias("diagnostic_channels"),
        F.lit(float(selected[0])).alias("window_duration_sec"),
        F.lit(int(selected[1] * 100)).alias("overlap_percent"),
        F.array(*[F.lit(f) for f in time_features]).alias("time_domain_features"),
        "frequency_domain_features",
        F.struct(F.lit("stratified group split").alias("strategy"), F.lit("measurement_id").alias("group")).alias("split"),
    )


def representatives(measurements: DataFrame, preferred_condition: str) -> DataFrame:
    """Per state the smallest recording id, taken from the preferred condition where there is one."""
    order = F.struct((F.col("condition") != preferred_condition).alias("other"), F.col("measurement_id"))
    return (
        measurements.filter(F.col("state").isin("healthy", "damaged"))
        .groupBy("state")
        .agg(F.min(order).alias("_r"))
        .select("state", F.col("_r.measurement_id").alias("measurement_id"))
    )
