"""Group splits, probability roll-ups and binary metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import ordinal, running_total

# Share of test measurements, seed and decision threshold.
TEST_SHARE = 0.25
SEED = 42
THRESHOLD = 0.5
SLICES = 1024


def group_split(measurements: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Deterministic stratified split of whole measurements.

    Per label the ``ceil(share * n)`` measurements with the smallest seeded hash are the test side,
    so all windows of a measurement stay together and any engine finds the same split.
    """
    digest = F.sha2(F.concat(F.col("measurement_id"), F.lit(":"), F.lit(str(seed))), 256)
    labels = measurements.groupBy("measurement_id").agg(F.min("state").alias("state"), F.max("state").alias("_other"))
    checked = labels.withColumn(
        "state",
        F.when(F.col("state") == F.col("_other"), F.col("state")).otherwise(
            F.raise_error(F.concat(F.lit("inconsistent label for "), F.col("measurement_id")))
        ),
    ).drop("_other")
    hashed = checked.withColumn("_h", digest)
    slot = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = ordinal(hashed, ["state"], slot, ["_h", "measurement_id"], "_rank")
    sizes = checked.groupBy("state").agg(F.ceil(F.count(F.lit(1)) * share).alias("_test"))
    side = F.when(F.col("_rank") <= F.col("_test"), "test").otherwise("train")
    return ranked.join(F.broadcast(sizes), "state").select("measurement_id", "state", side.alias("side"))


def shared_groups(split: DataFrame, key: str, preview: int | None = 5) -> DataFrame:
    """Up to ``preview`` group keys found on both sides (None: all); an empty result means no leakage."""
    train = split.filter(F.col("side") == "train").select(key)
    test = split.filter(F.col("side") == "test").select(key)
    shared = train.intersect(test)
    return shared if preview is None else shared.limit(preview)


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    common = [r[0] for r in left.select(key).intersect(right.select(key)).limit(5).collect()]
    if common:
        raise ValueError(f"groups on both sides: {common}")


def split_report(windows: DataFrame, split: DataFrame) -> DataFrame:
    """Windows and measurements per side and class, and per side and condition."""
    joined = windows.select("measurement_id", "state", "condition").join(split.select("measurement_id", "side"), "measurement_id")
    per_measurement = joined.groupBy("measurement_id", "side", "state", "condition").agg(F.count(F.lit(1)).alias("n"))
    facets = F.array(
        F.struct(F.lit("class").alias("facet"), F.col("state").alias("value")),
        F.struct(F.lit("condition").alias("facet"), F.col("condition").alias("value")),
    )
    return (
        per_measurement.select("side", "n", F.inline(facets))
        .groupBy("side", "facet", "value")
        .agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("measurements"))
    )


def rollup_probability(scored: DataFrame, key: str) -> DataFrame:
    """Mean probability per group with its label and window count."""
    return scored.groupBy(F.col(key).alias("group")).agg(
        F.min("state").alias("state"), F.avg("probability").alias("probability"), F.count(F.lit(1)).alias("window_count")
    )


def verdicts(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Verdict per measurement: mean probability, threshold, confidence, mean key features."""
    grouped = scored.groupBy("measurement_id").agg(
        F.avg("probability").alias("mean_probability"),
        F.count(F.lit(1)).alias("window_count"),
        *[F.avg(f).alias(f.split("__", 1)[-1]) for f in features],
    )
    damaged = F.col("mean_probability") >= THRESHOLD
    return grouped.withColumns(
        {
            "predicted_class": F.when(damaged, "damaged").otherwise("healthy"),
            "status": F.when(damaged, "abnormal").otherwise("normal"),
            "confidence": F.when(damaged, F.col("mean_probability")).otherwise(1 - F.col("mean_probability")),
        }
    )


def levels_of(scored: DataFrame) -> DataFrame:
    """Rows to evaluate at window, measurement, bearing and condition level, in one frame."""

    def shape(df: DataFrame, level: str, scope: Column) -> DataFrame:
        return df.select(F.lit(level).alias("level"), scope.alias("scope"), "state", "probability")

    everything = F.lit("ALL")
    return (
        shape(scored, "window", everything)
        .unionByName(shape(rollup_probability(scored, "measurement_id"), "measurement", everything))
        .unionByName(shape(rollup_probability(scored, "bearing_id"), "bearing", everything))
        .unionByName(shape(scored, "condition", F.col("condition")))
    )


def binary_metrics(rows: DataFrame, keys: Sequence[str] = ("level", "scope")) -> DataFrame:
    """Accuracy, precision, recall, F1, confusion counts and exact ROC AUC per key.

    The AUC is the Mann-Whitney statistic over distinct scores. Rows are folded to one row per
    score before the ordered pass, and that pass runs in score slices.
    """
    positive = F.col("state") == "damaged"
    called = F.col("probability") >= THRESHOLD
    counts = rows.groupBy(*keys, "probability").agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")
    )
    slot = F.floor(F.col("probability") * SLICES)
    below = running_total(counts, list(keys), slot, ["probability"], {"n_upto": F.col("n")})
    wins = F.col("p") * (F.col("n_upto") - F.col("n") + F.col("n") / 2)

    def when(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    sums = below.groupBy(*keys).agg(
        F.sum(F.col("p") + F.col("n")).alias("sample_count"),
        when(called, "p").alias("tp"),
        when(called, "n").alias("fp"),
        when(~called, "p").alias("fn"),
        when(~called, "n").alias("tn"),
        F.sum(wins).alias("_wins"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return sums.withColumns(
        {
            "accuracy": ratio(tp + tn, F.col("sample_count")),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "roc_auc": F.when(((tp + fn) > 0) & ((fp + tn) > 0), F.col("_wins") / ((tp + fn) * (fp + tn))),
        }
    ).drop("_wins")


def rank_importance(importance: DataFrame) -> DataFrame:
    """Feature ranks by importance; the table has one row per model feature."""
    from pyspark.sql import Window

    order = Window.partitionBy("model_id").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(order).cast("bigint"))


def check_model(metadata: Mapping, bundle: Mapping) -> None:
    """The stored model and its metadata must agree on id, feature order and version."""
    for field in ("model_id", "feature_list", "feature_version"):
        if metadata.get(field) != bundle.get(field):
            raise ValueError(f"model metadata and artifact differ in {field}")
