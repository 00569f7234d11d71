"""Queries around the group split, scored windows and the forest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import evaluation as ev
from plumbline.plans import analysis, views
from plumbline.plans.registry import query, with_views
from plumbline.plans.signal_queries import feature_table
from plumbline.plans.views import SPECTRA_SQL
from plumbline.session import shared_folder

SCORED_SQL = """scored AS (SELECT measurement_id, bearing_id, condition, state, window_id,
  round(1 / (1 + exp(-(6 * CAST(samples[1] AS DOUBLE) + 4 * CAST(samples[2] AS DOUBLE)))), 3) AS probability FROM vectors)"""

SPLIT_SQL = """labelled AS (SELECT DISTINCT measurement_id, state FROM vectors),
split AS (SELECT measurement_id, state, CASE WHEN row_number() OVER (PARTITION BY state ORDER BY sha256(measurement_id || ':42'), measurement_id)
  <= ceil(count(*) OVER (PARTITION BY state) * 0.25) THEN 'test' ELSE 'train' END AS side FROM labelled)"""

V = with_views(SPECTRA_SQL)
SP = with_views(SPECTRA_SQL, SPLIT_SQL)
SC = with_views(SPECTRA_SQL, SCORED_SQL)


def scored_windows(spark, sf_dir):
    """Windows with a deterministic score, so every roll-up can be checked exactly."""
    s = F.col("samples")
    rows = views.window_arrays(spark, sf_dir)
    return rows.withColumn("probability", F.round(1 / (1 + F.exp(-(6 * s[0] + 4 * s[1]))), 3)).drop("samples", "rate_hz")


def split(spark, sf_dir):
    return ev.group_split(views.window_arrays(spark, sf_dir).select("measurement_id", "state"))


@query("group_split", SP + "SELECT measurement_id, state, side FROM split")
def group_split(spark, sf_dir):
    return split(spark, sf_dir)


@query("split_leakage", SP + "SELECT measurement_id FROM split WHERE side = 'train' INTERSECT SELECT measurement_id FROM split WHERE side = 'test'")
def split_leakage(spark, sf_dir):
    return ev.shared_groups(split(spark, sf_dir), "measurement_id")


@query(
    "row_split_leakage",
    SP
    + """SELECT measurement_id FROM (SELECT measurement_id, CAST(substr(window_id, 2) AS BIGINT) % 2 AS side FROM vectors)
GROUP BY 1 HAVING count(DISTINCT side) = 2""",
)
def row_split_leakage(spark, sf_dir):
    """A split by rows instead of measurements: every measurement on both sides is named."""
    number = F.substr("window_id", F.lit(2)).cast("bigint")
    rows = views.window_arrays(spark, sf_dir).withColumn("side", F.when(number % 2 == 0, "train").otherwise("test"))
    return ev.shared_groups(rows, "measurement_id", preview=None)


@query(
    "split_report",
    SP
    + """, j AS (SELECT v.measurement_id, v.state, v.condition, side FROM vectors v JOIN split s USING (measurement_id))
SELECT side, 'class' AS facet, state AS value, CAST(count(*) AS BIGINT) AS windows, CAST(count(DISTINCT measurement_id) AS BIGINT) AS measurements FROM j GROUP BY ALL
UNION ALL SELECT side, 'condition', condition, count(*), count(DISTINCT measurement_id) FROM j GROUP BY ALL""",
)
def split_report(spark, sf_dir):
    return ev.split_report(views.window_arrays(spark, sf_dir), split(spark, sf_dir))


@query(
    "probability_rollup",
    SC
    + """SELECT 'measurement' AS level, measurement_id AS "group", min(state) AS state, round(avg(probability), 6) AS probability, CAST(count(*) AS BIGINT) AS window_count FROM scored GROUP BY 2
UNION ALL SELECT 'bearing', bearing_id, min(state), round(avg(probability), 6), count(*) FROM scored GROUP BY 2""",
)
def probability_rollup(spark, sf_dir):
    rows = scored_windows(spark, sf_dir)
    parts = [
        ev.rollup_probability(rows, key).select(F.lit(level).alias("level"), "group", "state", F.round("probability", 6).alias("probability"), "window_count")
        for level, key in (("measurement", "measurement_id"), ("bearing", "bearing_id"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "measurement_verdicts",
    SC
    + """SELECT measurement_id, round(avg(probability), 6) AS mean_probability, CAST(count(*) AS BIGINT) AS window_count,
  CASE WHEN avg(probability) >= 0.5 THEN 'damaged' ELSE 'healthy' END AS predicted_class, CASE WHEN avg(probability) >= 0.5 THEN 'abnormal' ELSE 'normal' END AS status,
  round(CASE WHEN avg(probability) >= 0.5 THEN avg(probability) ELSE 1 - avg(probability) END, 6) AS confidence FROM scored GROUP BY 1""",
)
def measurement_verdicts(spark, sf_dir):
    out = ev.verdicts(scored_windows(spark, sf_dir), [])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_probability", "confidence")})


METRICS_SQL = """rows_ AS (
  SELECT 'window' AS level, 'ALL' AS scope, state, probability FROM scored
  UNION ALL SELECT 'measurement', 'ALL', min(state), avg(probability) FROM scored GROUP BY measurement_id
  UNION ALL SELECT 'bearing', 'ALL', min(state), avg(probability) FROM scored GROUP BY bearing_id
  UNION ALL SELECT 'condition', condition, state, probability FROM scored),
ranked AS (SELECT *, rank() OVER (PARTITION BY level, scope ORDER BY probability) + (count(*) OVER (PARTITION BY level, scope, probability) - 1) / 2.0 AS r FROM rows_),
agg AS (SELECT level, scope, count(*) AS c, count(*) FILTER (state = 'damaged' AND probability >= 0.5) AS tp, count(*) FILTER (state <> 'damaged' AND probability >= 0.5) AS fp,
  count(*) FILTER (state = 'damaged' AND probability < 0.5) AS fn, count(*) FILTER (state <> 'damaged' AND probability < 0.5) AS tn, sum(r) FILTER (state = 'damaged') AS rs FROM ranked GROUP BY 1, 2)"""


@query(
    "binary_metrics",
    with_views(SPECTRA_SQL, SCORED_SQL, METRICS_SQL)
    + """SELECT level, scope, CAST(c AS BIGINT) AS sample_count, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  round((tp + tn) / CAST(c AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1,
  round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (rs - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn) * (fp + tn)) END, 6) AS roc_auc FROM agg""",
)
def binary_metrics(spark, sf_dir):
    out = ev.binary_metrics(ev.levels_of(scored_windows(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")})


@query(
    "label_metrics",
    """WITH rows_ AS (SELECT quality, CAST(doc_id % 100 AS DOUBLE) / 100 AS s FROM labels),
r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM rows_)
SELECT 'labels' AS level, CAST(count(*) AS BIGINT) AS sample_count, round(avg(((s >= 0.5) = (quality = 1))::INT), 6) AS accuracy,
  round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc FROM r""",
)
def label_metrics(spark, sf_dir):
    rows = views.table(spark, sf_dir, "labels").select(
        F.lit("labels").alias("level"),
        F.when(F.col("quality") == 1, "damaged").otherwise("healthy").alias("state"),
        ((F.col("doc_id") % 100).cast("double") / 100).alias("probability"),
    )
    out = ev.binary_metrics(rows, ["level"])
    return out.select("level", "sample_count", F.round("accuracy", 6).alias("accuracy"), F.round("roc_auc", 6).alias("roc_auc"))


RUNS: dict[tuple[str, str], str] = {}


def stored_run(spark, sf_dir):
    """Folder of the one baseline run that all forest queries of an application share."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in RUNS:
        folder = f"{shared_folder(spark)}/forest/{uuid.uuid4().hex}"
        analysis.baseline_run(feature_table(spark, sf_dir), folder)
        RUNS[key] = folder
    return RUNS[key]


@query("forest_predictions")
def forest_predictions(spark, sf_dir):
    """Train on the train side of the split and score every window of the test side."""
    scored = spark.read.parquet(f"{stored_run(spark, sf_dir)}/scores")
    label = F.when(F.col("probability") >= ev.THRESHOLD, "damaged").otherwise("healthy")
    return scored.select("measurement_id", "bearing_id", "condition", "window_id", "state", "probability", label.alias("predicted_class"))


@query("forest_importance")
def forest_importance(spark, sf_dir):
    return spark.read.parquet(f"{stored_run(spark, sf_dir)}/importance")


@query("forest_metrics")
def forest_metrics(spark, sf_dir):
    return spark.read.parquet(f"{stored_run(spark, sf_dir)}/metrics")


@query("batch_verdicts")
def batch_verdicts(spark, sf_dir):
    """Verdict for every measurement with its mean key features."""
    model, windows = analysis.load_run(spark, stored_run(spark, sf_dir))
    keys = [f"vibration_1__{f}" for f in ("rms", "kurtosis", "crest_factor", "spectral_centroid_hz")]
    return ev.verdicts(analysis.score(model, windows), keys)


@query(
    "prediction_targets",
    SP
    + """SELECT m.measurement_id, m.state, m.condition, CAST(count(*) AS BIGINT) AS windows, CAST(0 AS BIGINT) AS unknown
FROM vectors m JOIN split s USING (measurement_id) WHERE side = 'test' GROUP BY ALL""",
)
def prediction_targets(spark, sf_dir):
    """Predictions joined to the measurement table for their label and condition, which they do not carry."""
    predicted = forest_predictions(spark, sf_dir).select("measurement_id", "window_id", "probability")
    known = views.window_arrays(spark, sf_dir).select("measurement_id", "state", "condition").distinct()
    joined = predicted.join(known, "measurement_id", "left")
    return joined.groupBy("measurement_id", "state", "condition").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("probability").isNull() | ~F.col("probability").between(0, 1)).alias("unknown")
    )
