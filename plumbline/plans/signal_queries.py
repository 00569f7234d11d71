"""Queries over recorded signals: windows, features, sampling facts and the statistical profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.spectrum import frequency_features, relative_spectrum
from plumbline.operators import ordered, profiling, signals as sig
from plumbline.plans import views
from plumbline.plans.registry import query, with_views
from plumbline.plans.views import SIGNALS_SQL, SPECTRA_SQL

SIZE = 16
RATE = 16.0
RECORDING = ("measurement_id", "bearing_id", "condition", "state", "channel")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# -- SQL building blocks ----------------------------------------------------------------------

TIME_SQL = """CAST(avg(x) AS DOUBLE) AS mean, stddev_pop(x) AS std, sqrt(avg(x*x)) AS rms, max(abs(x)) AS peak,
         max(x) - min(x) AS peak_to_peak,
         CASE WHEN sqrt(avg(x*x)) = 0 THEN 0 ELSE max(abs(x)) / sqrt(avg(x*x)) END AS crest_factor,
         CASE WHEN max(x) = min(x) THEN 0 ELSE skewness(x) END AS skewness,
         CASE WHEN max(x) = min(x) THEN 0 ELSE kurtosis(x) END AS kurtosis"""

WINDOWS_SQL = f"""win AS (
  SELECT measurement_id, bearing_id, condition, state, channel, idx // {SIZE} AS w, {TIME_SQL}
  FROM signals GROUP BY ALL HAVING count(*) = {SIZE})"""

LONG_SQL = """long AS (
  UNPIVOT (SELECT measurement_id, bearing_id, condition, state, channel AS signal, w,
                  mean, std, rms, peak, peak_to_peak, crest_factor, skewness, kurtosis FROM win)
  ON mean, std, rms, peak, peak_to_peak, crest_factor, skewness, kurtosis INTO NAME feature VALUE value)"""

LEVELS_SQL = "levels AS (SELECT * FROM long UNION ALL SELECT * REPLACE ('ALL' AS condition) FROM long)"

EIGHT_SQL = """CAST(count(value) AS BIGINT) AS n, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std,
  round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.25), 8) AS q25,
  round(quantile_cont(value, 0.75), 8) AS q75, round(min(value), 8) AS min, round(max(value), 8) AS max"""

EFFECTS_SQL = """effects AS (
  SELECT signal, feature, condition,
         CAST(count(*) FILTER (state = 'healthy') AS BIGINT) AS healthy_count,
         CAST(count(*) FILTER (state = 'damaged') AS BIGINT) AS damaged_count,
         avg(value) FILTER (state = 'healthy') AS healthy_mean, avg(value) FILTER (state = 'damaged') AS damaged_mean,
         var_samp(value) FILTER (state = 'healthy') AS vh, var_samp(value) FILTER (state = 'damaged') AS vd
  FROM levels GROUP BY 1, 2, 3),
cohen AS (
  SELECT *, CASE WHEN healthy_count < 2 OR damaged_count < 2
                   OR (healthy_count - 1) * vh + (damaged_count - 1) * vd <= 0 THEN 0.0
              ELSE (damaged_mean - healthy_mean)
                   / sqrt(((healthy_count - 1) * vh + (damaged_count - 1) * vd) / (healthy_count + damaged_count - 2)) END AS cohens_d
  FROM effects WHERE healthy_count > 0 AND damaged_count > 0)"""

STEPS_SQL = """steps AS (
  SELECT *, lead(t) OVER (PARTITION BY measurement_id ORDER BY idx) - t AS d FROM signals),
mids AS (SELECT measurement_id, quantile_cont(d, 0.5) AS med, count(*) AS sample_count, max(t) - min(t) AS span
         FROM steps GROUP BY 1),
facts AS (
  SELECT measurement_id, 'vibration_1' AS channel, CAST(any_value(sample_count) AS BIGINT) AS sample_count,
         any_value(CASE WHEN span > 0 THEN span END) AS duration_sec,
         any_value(CASE WHEN span > 0 THEN (sample_count - 1) / span END) AS observed_rate_hz,
         bool_and(med > 0 AND abs(d - med) <= greatest(abs(med) * 1e-6, 1e-12) + 1e-3 * abs(med)) FILTER (d IS NOT NULL) AS uniform_time_axis
  FROM steps JOIN mids USING (measurement_id) GROUP BY 1)"""

S = with_views(SIGNALS_SQL)
W = with_views(SIGNALS_SQL, WINDOWS_SQL)
L = with_views(SIGNALS_SQL, WINDOWS_SQL, LONG_SQL)
LV = with_views(SIGNALS_SQL, WINDOWS_SQL, LONG_SQL, LEVELS_SQL)
E = with_views(SIGNALS_SQL, WINDOWS_SQL, LONG_SQL, LEVELS_SQL, EFFECTS_SQL)


def windows(spark, sf_dir):
    return sig.time_features(views.signals(spark, sf_dir), SIZE, SIZE, RECORDING)


def long_features(spark, sf_dir):
    return sig.to_long(windows(spark, sf_dir), RECORDING[:4], sig.TIME_FEATURES, F.col("channel"))


def facts(spark, sf_dir):
    return sig.sampling_facts(views.signals(spark, sf_dir))


# -- windows and features ---------------------------------------------------------------------


@query(
    "signal_ordinals",
    S + "SELECT measurement_id, idx, round(t, 6) AS t, round(x, 6) AS x FROM signals",
)
def signal_ordinals(spark, sf_dir):
    return rounded(views.signals(spark, sf_dir), "t", "x").select("measurement_id", "idx", "t", "x")


@query(
    "window_bounds",
    S
    + f"""SELECT measurement_id, 'w' || CASE WHEN w < 1000 THEN lpad(CAST(w AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END AS window_id,
       CAST(w * 8 AS BIGINT) AS window_start, CAST(w * 8 + {SIZE} AS BIGINT) AS window_end
FROM (SELECT measurement_id, count(*) AS n FROM signals GROUP BY 1),
     LATERAL (SELECT unnest(range(0, greatest(n - {SIZE}, -1) // 8 + 1)) AS w) WHERE n >= {SIZE}""",
)
def window_bounds(spark, sf_dir):
    counts = views.signals(spark, sf_dir).groupBy("measurement_id").agg(F.count("x").alias("sample_count"))
    size, step = sig.window_shape(RATE, 1.0, 0.5)
    bounds = sig.window_bounds(counts, F.lit(size).cast("bigint"), F.lit(step).cast("bigint"))
    return bounds.select("measurement_id", "window_id", "window_start", "window_end")


@query(
    "window_time_features",
    W
    + """SELECT measurement_id, CAST(w AS BIGINT) AS "window", round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms,
  round(peak, 6) AS peak, round(peak_to_peak, 6) AS peak_to_peak, round(crest_factor, 6) AS crest_factor,
  round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM win""",
)
def window_time_features(spark, sf_dir):
    return rounded(windows(spark, sf_dir), *sig.TIME_FEATURES).select("measurement_id", "window", *sig.TIME_FEATURES)


@query(
    "overlapping_window_rms",
    S
    + f"""SELECT measurement_id, CAST(w AS BIGINT) AS "window", round(sqrt(avg(x * x)), 6) AS rms
FROM (SELECT measurement_id, x, unnest(range(greatest(0, CAST(ceil((idx - {SIZE - 1}) / 8.0) AS BIGINT)), idx // 8 + 1)) AS w FROM signals)
GROUP BY 1, 2 HAVING count(*) = {SIZE}""",
)
def overlapping_window_rms(spark, sf_dir):
    size, step = sig.window_shape(RATE, 1.0, 0.5)
    rms = sig.window_rms(views.signals(spark, sf_dir), size, step, ("measurement_id",))
    return rounded(rms, "rms")


@query(
    "channel_time_features",
    S
    + f"""SELECT measurement_id, channel, n, round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms, round(peak, 6) AS peak,
  round(peak_to_peak, 6) AS peak_to_peak, round(crest_factor, 6) AS crest_factor, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis
FROM (SELECT measurement_id, channel, CAST(count(*) AS BIGINT) AS n, {TIME_SQL} FROM signals GROUP BY 1, 2)""",
)
def channel_time_features(spark, sf_dir):
    return rounded(sig.channel_features(views.signals(spark, sf_dir), sig.CHANNEL), *sig.TIME_FEATURES)


DFT_SQL = """taps AS (
  SELECT v.*, unnest(range(0, len(samples))) AS i, len(samples) AS n FROM vectors v),
points AS (
  SELECT measurement_id, bearing_id, condition, state, window_id, rate_hz, n, i,
         (CAST(samples[i + 1] AS DOUBLE) - avg(CAST(samples[i + 1] AS DOUBLE)) OVER (PARTITION BY window_id))
           * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS xw,
         0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS h
  FROM taps),
bins AS (
  SELECT window_id, k, any_value(rate_hz) AS rate_hz, any_value(n) AS n, sum(h * h) AS h2,
         sum(xw * cos(2 * pi() * k * i / n)) AS re, sum(xw * sin(2 * pi() * k * i / n)) AS im
  FROM points, range(0, 33) r(k) GROUP BY 1, 2),
power AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE re * re + im * im END AS p, k * rate_hz / n AS f FROM bins),
tot AS (SELECT window_id, sum(p) AS total FROM power GROUP BY 1),
freq AS (
  SELECT window_id, arg_max(f, p) AS dominant_frequency_hz, sum(f * p) / any_value(total) AS spectral_centroid_hz,
         any_value(total) / (any_value(n) * any_value(h2)) AS spectral_energy,
         -sum(CASE WHEN p > 0 THEN p / total * ln(p / total) ELSE 0 END) / ln(33) AS spectral_entropy
  FROM power JOIN tot USING (window_id) GROUP BY 1)"""


@query(
    "window_frequency_features",
    with_views(SPECTRA_SQL, DFT_SQL)
    + """SELECT window_id, round(dominant_frequency_hz, 6) AS dominant_frequency_hz, round(spectral_centroid_hz, 6) AS spectral_centroid_hz,
  round(spectral_energy, 6) AS spectral_energy, round(spectral_entropy, 6) AS spectral_entropy FROM freq""",
)
def window_frequency_features(spark, sf_dir):
    arrays = views.window_arrays(spark, sf_dir)
    out = arrays.select("window_id", frequency_features("samples", "rate_hz").alias("f")).select("window_id", "f.*")
    return rounded(out, *sig.FREQUENCY_FEATURES)


@query(
    "relative_spectrum_db",
    with_views(SPECTRA_SQL, DFT_SQL)
    + """SELECT window_id, CAST(k AS BIGINT) AS bin, round(f, 6) AS frequency_hz,
  round(20 * log10(greatest(sqrt(re * re + im * im) / max(sqrt(re * re + im * im)) OVER (PARTITION BY window_id), 1e-8)), 4) AS relative_db
FROM power""",
)
def relative_spectrum_db(spark, sf_dir):
    arrays = views.window_arrays(spark, sf_dir)
    bins = arrays.select(
        "window_id", "rate_hz", F.size("samples").alias("n"), F.posexplode(relative_spectrum("samples")).alias("k", "db")
    )
    return bins.select(
        "window_id",
        F.col("k").cast("bigint").alias("bin"),
        F.round(F.col("k") * F.col("rate_hz") / F.col("n"), 6).alias("frequency_hz"),
        F.round("db", 4).alias("relative_db"),
    )


FEATURE_TABLE_SQL = f"""flat AS (SELECT measurement_id, bearing_id, condition, state, window_id, CAST(unnest(samples) AS DOUBLE) AS x FROM vectors),
tf AS (SELECT measurement_id, bearing_id, condition, state, window_id, {TIME_SQL} FROM flat GROUP BY ALL),
ft AS (SELECT * FROM tf JOIN freq USING (window_id))"""


def feature_table(spark, sf_dir):
    """Window features of the array recordings, one column per channel__feature."""
    from plumbline.operators.features import array_feature_table

    return array_feature_table(views.window_arrays(spark, sf_dir), "vibration_1")


@query(
    "feature_table",
    with_views(SPECTRA_SQL, DFT_SQL, FEATURE_TABLE_SQL)
    + "SELECT measurement_id, bearing_id, condition, state, window_id, "
    + ", ".join(f"round({f}, 5) AS vibration_1__{f}" for f in sig.TIME_FEATURES + sig.FREQUENCY_FEATURES)
    + " FROM ft",
)
def feature_table_query(spark, sf_dir):
    table = feature_table(spark, sf_dir)
    return rounded(table, *[c for c in table.columns if "__" in c], digits=5)


SPEC = {
    "diagnostic_channels": ["click", "view", "purchase"],
    "window_duration_sec": 2.0,
    "overlap_percent": 50,
    "time_domain_features": ["mean", "rms", "peak_to_peak"],
    "frequency_domain_features": [],
    "split": {"group": "measurement_id"},
}
SPEC_RATE = 2.0
SPEC_SQL = """counts AS (SELECT measurement_id, channel, any_value(state) AS state, count(*) AS n FROM multi GROUP BY 1, 2),
plans AS (
  SELECT measurement_id, max(n) FILTER (channel = 'click') AS c, CASE WHEN c >= 4 THEN (c - 4) // 2 + 1 ELSE 0 END AS windows,
    CASE WHEN count(*) FILTER (channel IN ('click', 'view', 'purchase')) < 3 THEN 'MISSING_CHANNEL'
      WHEN windows > 0 AND min(n) FILTER (channel IN ('click', 'view', 'purchase')) < (windows - 1) * 2 + 4 THEN 'CHANNEL_TOO_SHORT' END AS reject_code
  FROM counts GROUP BY 1)"""


def spec_plan(spark, sf_dir):
    """Every channel is taken as recorded at the same nominal rate."""
    from plumbline.operators.features import window_plan

    counts = views.multi_signals(spark, sf_dir).groupBy("measurement_id", "channel").agg(F.max("state").alias("state"), F.count("x").alias("sample_count"))
    return window_plan(counts.withColumn("nominal_rate_hz", F.lit(SPEC_RATE)), SPEC)


@query("spec_windows", with_views(SIGNALS_SQL, SPEC_SQL) + "SELECT measurement_id, CAST(windows AS BIGINT) AS windows, reject_code FROM plans")
def spec_windows(spark, sf_dir):
    plan = spec_plan(spark, sf_dir)
    return plan.select("measurement_id", F.coalesce("windows", F.lit(0).cast("bigint")).alias("windows"), "reject_code")


@query(
    "spec_feature_table",
    with_views(SIGNALS_SQL, SPEC_SQL)
    + "SELECT measurement_id, 'w' || lpad(CAST(w AS VARCHAR), 3, '0') AS window_id, CAST(w * 2 AS BIGINT) AS window_start, CAST(w * 2 + 4 AS BIGINT) AS window_end, "
    + ", ".join(
        f"round(avg({x}), 6) AS {c}__mean, round(sqrt(avg({x} * {x})), 6) AS {c}__rms, round(max({x}) - min({x}), 6) AS {c}__peak_to_peak"
        for c, x in ((c, f"CASE channel WHEN '{c}' THEN x END") for c in SPEC["diagnostic_channels"])
    )
    + """ FROM (SELECT *, unnest(range(0, windows)) AS w FROM plans WHERE reject_code IS NULL) JOIN multi USING (measurement_id)
WHERE idx >= w * 2 AND idx < w * 2 + 4 GROUP BY 1, w""",
)
def spec_feature_table_query(spark, sf_dir):
    from plumbline.operators.features import spec_feature_table

    table = spec_feature_table(views.multi_signals(spark, sf_dir), spec_plan(spark, sf_dir), SPEC)
    return rounded(table, *[c for c in table.columns if "__" in c])


# -- sampling facts and alignment --------------------------------------------------------------


@query(
    "sampling_facts",
    with_views(SIGNALS_SQL, STEPS_SQL)
    + """SELECT measurement_id, channel, sample_count, round(duration_sec, 5) AS duration_sec,
  round(observed_rate_hz, 9) AS observed_rate_hz, uniform_time_axis FROM facts""",
)
def sampling_facts(spark, sf_dir):
    return rounded(rounded(facts(spark, sf_dir), "duration_sec", digits=5), "observed_rate_hz", digits=9)


@query(
    "quality_flags",
    with_views(SIGNALS_SQL, STEPS_SQL)
    + """SELECT measurement_id, constant AS constant_signal, coalesce(abs(observed_rate_hz - nominal) / nominal > 0.05, FALSE) AS sampling_deviation,
  coalesce(NOT uniform_time_axis, FALSE) AS nonuniform_axis
FROM (SELECT *, sample_count / 2592000.0 AS nominal FROM facts)
JOIN (SELECT measurement_id, max(x) = min(x) AS constant FROM signals GROUP BY 1) USING (measurement_id)""",
)
def quality_flags(spark, sf_dir):
    table = facts(spark, sf_dir).withColumn("nominal_rate_hz", F.col("sample_count") / F.lit(2592000.0))
    flags = sig.quality_flags(table, views.signals(spark, sf_dir))
    return flags.select("measurement_id", "constant_signal", "sampling_deviation", "nonuniform_axis")


@query(
    "nominal_rates",
    """SELECT p_partkey, CASE WHEN p_name IN ('phase_current_1', 'phase_current_2', 'vibration_1') THEN 64000.0
  WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) * 1000 ELSE CAST(p_size AS DOUBLE) END AS nominal_rate_hz FROM part""",
)
def nominal_rates(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    raster = F.concat(F.lit("HostService "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "kHz").otherwise("Hz"))
    return part.select("p_partkey", sig.nominal_rate(F.col("p_name"), raster).alias("nominal_rate_hz"))


@query(
    "channel_alignment",
    S
    + f"""SELECT measurement_id, CASE WHEN present < 3 THEN 'MISSING_CHANNEL' WHEN unrated THEN 'NO_VERIFIED_RATE' WHEN lo <> hi THEN 'RATE_MISMATCH' WHEN shortest < ref // 4 * 4 THEN 'CHANNEL_TOO_SHORT' ELSE 'OK' END AS alignment,
  present, shortest, ref AS reference_count
FROM (SELECT measurement_id, CAST(count(*) AS BIGINT) AS present, min(n) AS shortest, max(n) FILTER (channel = 'view') AS ref,
        bool_or(channel = 'error' AND n % 7 = 0) AS unrated, min(CASE WHEN channel = 'click' AND n % 5 = 0 THEN 32 ELSE 64 END) FILTER (NOT (channel = 'error' AND n % 7 = 0)) AS lo,
        max(CASE WHEN channel = 'click' AND n % 5 = 0 THEN 32 ELSE 64 END) FILTER (NOT (channel = 'error' AND n % 7 = 0)) AS hi
      FROM (SELECT measurement_id, channel, CAST(count(*) AS BIGINT) AS n FROM multi WHERE channel IN ('view', 'click', 'error') GROUP BY 1, 2) GROUP BY 1)""",
)
def channel_alignment(spark, sf_dir):
    """Some click channels run at half the rate, some error channels name no rate."""
    counted = views.raw_signals(spark, sf_dir).groupBy("measurement_id", F.col("event_type").alias("channel")).agg(F.count("x").alias("sample_count"))
    n, channel = F.col("sample_count"), F.col("channel")
    rate = F.when((channel == "error") & (n % 7 == 0), F.lit(None).cast("double")).when((channel == "click") & (n % 5 == 0), 32.0).otherwise(64.0)
    channels = counted.withColumn("nominal_rate_hz", rate)
    return sig.align_channels(channels, ("view", "click", "error"), 4)


@query(
    "interpolated_channel",
    S
    + """, fast AS (SELECT measurement_id, idx, t, x FROM multi WHERE channel = 'view'),
slow AS (SELECT measurement_id, t, x FROM multi WHERE channel = 'purchase'),
j AS (SELECT f.measurement_id, f.idx, f.t, p.t AS pt, p.x AS px, n.t AS nt, n.x AS nx
      FROM fast f ASOF LEFT JOIN slow p ON f.measurement_id = p.measurement_id AND f.t >= p.t
      ASOF LEFT JOIN slow n ON f.measurement_id = n.measurement_id AND f.t <= n.t)
SELECT measurement_id, idx, round(CASE WHEN pt IS NULL THEN nx WHEN nt IS NULL THEN px WHEN nt = pt THEN px
  ELSE px + (nx - px) / (nt - pt) * (t - pt) END, 6) AS value_at FROM j""",
)
def interpolated_channel(spark, sf_dir):
    rows = views.multi_signals(spark, sf_dir)
    fast = rows.filter(F.col("channel") == "view").select("measurement_id", "idx", "t")
    slow = rows.filter(F.col("channel") == "purchase").select("measurement_id", "t", F.col("x").alias("value"))
    out = ordered.asof_interpolate(fast, slow, ["measurement_id"], "t", "value", views.SECONDS_PER_SLICE)
    return rounded(out, "value_at").select("measurement_id", "idx", "value_at")


@query(
    "waveform_preview",
    S
    + """, c AS (SELECT measurement_id, count(*) AS n, least(count(*), 32) AS m FROM signals GROUP BY 1),
p AS (SELECT DISTINCT measurement_id, CAST(floor(i * (n - 1) / CAST(m - 1 AS DOUBLE)) AS BIGINT) AS idx
      FROM (SELECT *, unnest(range(0, m)) AS i FROM c WHERE m > 1) UNION SELECT measurement_id, 0 FROM c)
SELECT measurement_id, idx, round(t, 6) AS t, round(x, 6) AS x FROM signals JOIN p USING (measurement_id, idx)""",
)
def waveform_preview(spark, sf_dir):
    rows = views.signals(spark, sf_dir)
    counts = rows.groupBy(*sig.CHANNEL).agg(F.count("x").alias("sample_count"))
    return rounded(sig.preview(rows, counts, 32), "t", "x").select("measurement_id", "idx", "t", "x")


# -- profile ------------------------------------------------------------------------------------


@query("feature_summary", LV + f"SELECT signal, feature, state, condition, {EIGHT_SQL} FROM levels GROUP BY 1, 2, 3, 4")
def feature_summary(spark, sf_dir):
    out = profiling.feature_summary(long_features(spark, sf_dir))
    return rounded(out, "mean", "std", "median", "q25", "q75", "min", "max", digits=8)


@query("bearing_summary", L + f"SELECT bearing_id, state, signal, feature, {EIGHT_SQL} FROM long GROUP BY 1, 2, 3, 4")
def bearing_summary(spark, sf_dir):
    out = profiling.bearing_summary(long_features(spark, sf_dir))
    return rounded(out, "mean", "std", "median", "q25", "q75", "min", "max", digits=8)


@query(
    "state_effects",
    E
    + """SELECT signal, feature, condition, healthy_count, damaged_count, round(healthy_mean, 8) AS healthy_mean,
  round(damaged_mean, 8) AS damaged_mean, round(cohens_d, 8) AS cohens_d FROM cohen""",
)
def state_effects(spark, sf_dir):
    return rounded(profiling.state_effects(long_features(spark, sf_dir)), "healthy_mean", "damaged_mean", "cohens_d", digits=8)


@query(
    "condition_effects",
    L
    + """SELECT signal, feature, state, CAST(count(*) AS BIGINT) AS condition_count, round(min(m), 6) AS min_condition_mean,
  round(max(m), 6) AS max_condition_mean,
  round(CASE WHEN avg(abs(m)) = 0 THEN 0 ELSE (max(m) - min(m)) / avg(abs(m)) END, 6) AS relative_mean_spread
FROM (SELECT signal, feature, state, condition, avg(value) AS m FROM long GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)
def condition_effects(spark, sf_dir):
    out = profiling.condition_effects(long_features(spark, sf_dir)).drop("condition_means_json")
    return rounded(out, "min_condition_mean", "max_condition_mean", "relative_mean_spread")


@query(
    "feature_correlations",
    W
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) AS corr FROM win"
        for a in sig.TIME_FEATURES
        for b in sig.TIME_FEATURES
    )
    + ")",
)
def feature_correlations(spark, sf_dir):
    return rounded(profiling.correlations(windows(spark, sf_dir), sig.TIME_FEATURES), "corr")


@query(
    "windowing_comparison",
    S
    + """, cand AS (SELECT * FROM (VALUES (0.25, 0, 16, 16), (0.25, 50, 16, 8), (0.5, 0, 32, 32), (0.5, 50, 32, 16), (1.0, 0, 64, 64), (1.0, 50, 64, 32)) c(d, o, size, step)),
w AS (SELECT measurement_id, state, d, o, size, w, sqrt(avg(x * x)) AS rms
      FROM (SELECT measurement_id, state, x, d, o, size, unnest(range(greatest(0, CAST(ceil((idx - (size - 1)) / CAST(step AS DOUBLE)) AS BIGINT)), idx // step + 1)) AS w FROM signals, cand)
      GROUP BY ALL HAVING count(*) = size),
m AS (SELECT measurement_id, state, d, o, count(*) AS windows, CASE WHEN avg(rms) = 0 THEN 0 ELSE stddev_pop(rms) / avg(rms) END AS cv FROM w GROUP BY ALL),
g AS (SELECT i.measurement_id, i.state, c.*, coalesce(windows, 0) AS windows, cv
      FROM (SELECT DISTINCT measurement_id, state FROM signals) i CROSS JOIN cand c LEFT JOIN m ON m.measurement_id = i.measurement_id AND m.d = c.d AND m.o = c.o)
SELECT CAST(d AS DOUBLE) AS window_duration_sec, CAST(o AS BIGINT) AS overlap_percent, CAST(any_value(size) AS BIGINT) AS window_samples,
  CAST(sum(windows) AS BIGINT) AS total_windows, CAST(sum(windows) FILTER (state = 'healthy') AS BIGINT) AS healthy_windows,
  CAST(sum(windows) FILTER (state = 'damaged') AS BIGINT) AS damaged_windows, CAST(min(windows) AS BIGINT) AS min_windows,
  CAST(max(windows) AS BIGINT) AS max_windows, round(avg(windows), 6) AS mean_windows, round(quantile_cont(cv, 0.5), 6) AS median_rms_cv,
  round(sum(windows) * any_value(size) * 8 / 1073741824.0, 9) AS memory_gib, d = 1.0 AND o = 0 AS selected
FROM g GROUP BY d, o""",
)
def windowing_comparison(spark, sf_dir):
    out = profiling.compare_windowings(views.signals(spark, sf_dir), 64.0)
    return rounded(rounded(out, "mean_windows", "median_rms_cv"), "memory_gib", digits=9)


@query(
    "amplitude_outliers",
    S
    + """, a AS (SELECT measurement_id, state, event_type AS channel, max(abs(x)) AS max_abs FROM raw_signals GROUP BY 1, 2, 3),
f AS (SELECT channel, quantile_cont(max_abs, 0.75) + 3 * (quantile_cont(max_abs, 0.75) - quantile_cont(max_abs, 0.25)) AS threshold FROM a GROUP BY 1)
SELECT measurement_id, state, channel, round(max_abs, 6) AS max_abs, round(threshold, 6) AS threshold, max_abs > threshold AS is_outlier
FROM a JOIN f USING (channel)""",
)
def amplitude_outliers(spark, sf_dir):
    rows = views.raw_signals(spark, sf_dir).withColumnRenamed("event_type", "channel")
    return rounded(profiling.amplitude_outliers(rows), "max_abs", "threshold")


@query(
    "channel_distributions",
    with_views(SIGNALS_SQL, STEPS_SQL)
    + """SELECT channel, CASE WHEN sample_count % 2 = 0 THEN '64000.0' ELSE 'unknown' END AS nominal_rate,
  CAST(count(*) AS BIGINT) AS recordings, CAST(count(*) FILTER (NOT uniform_time_axis) AS BIGINT) AS nonuniform FROM facts GROUP BY 1, 2""",
)
def channel_distributions(spark, sf_dir):
    rated = facts(spark, sf_dir).withColumn("nominal_rate_hz", F.when(F.col("sample_count") % 2 == 0, F.lit(64000.0)))
    return profiling.channel_distributions(rated)


def measurements(spark, sf_dir):
    return views.raw_signals(spark, sf_dir).select("measurement_id", "bearing_id", "condition", "state").distinct()


@query(
    "split_plan",
    S
    + """, b AS (SELECT bearing_id, count(DISTINCT measurement_id) FILTER (state = 'healthy') AS h, count(DISTINCT measurement_id) FILTER (state = 'damaged') AS d FROM signals GROUP BY 1)
SELECT CAST(count(*) FILTER (h > 0) AS BIGINT) AS healthy_bearings, CAST(count(*) FILTER (d > 0) AS BIGINT) AS damaged_bearings,
  count(*) FILTER (h > 0) >= 2 AND count(*) FILTER (d > 0) >= 2 AS bearing_split_feasible FROM b""",
)
def split_plan(spark, sf_dir):
    return profiling.split_plan(measurements(spark, sf_dir))


@query(
    "bearing_states",
    S + "SELECT bearing_id, state, CAST(count(DISTINCT measurement_id) AS BIGINT) AS recordings FROM signals GROUP BY 1, 2",
)
def bearing_states(spark, sf_dir):
    return profiling.bearing_states(measurements(spark, sf_dir))


@query(
    "recommended_features",
    E
    + """SELECT feature, round(avg(abs(cohens_d)), 6) AS mean_abs_d FROM cohen WHERE condition <> 'ALL' GROUP BY 1 HAVING avg(abs(cohens_d)) >= 0.5""",
)
def recommended_features(spark, sf_dir):
    effects = profiling.state_effects(long_features(spark, sf_dir))
    return rounded(profiling.recommend_features(effects, sig.TIME_FEATURES), "mean_abs_d")


@query(
    "representative_measurements",
    S
    + """SELECT state, coalesce(min(measurement_id) FILTER (condition = 'C1'), min(measurement_id)) AS measurement_id FROM signals GROUP BY 1""",
)
def representative_measurements(spark, sf_dir):
    return profiling.representatives(measurements(spark, sf_dir), "C1")
