import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.spectrum import frequency_features, relative_spectrum
from plumbline.operators import evaluation as ev
from plumbline.operators import features, profiling
from plumbline.operators import signals as sig
from plumbline.plans import analysis


def long_signal(spark, values, channel="vibration_1", rate=64.0):
    rows = [("m", channel, i, i / rate, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "measurement_id string, channel string, idx bigint, t double, x double")


@pytest.mark.parametrize("overlap, count", [(0.0, 4), (0.5, 7)])
def test_window_counts(spark, overlap, count):
    size, step = sig.window_shape(1000, 1.0, overlap)
    df = spark.createDataFrame([("m", 4000)], "measurement_id string, sample_count bigint")
    rows = sig.window_bounds(df, F.lit(size).cast("bigint"), F.lit(step).cast("bigint")).orderBy("window").collect()
    assert len(rows) == count and rows[1].window_id == "w001" and rows[-1].window_end <= 4000


def test_window_shape_rules():
    assert sig.window_shape(5, 0.5, 0)[0] == 2  # 2.5 rounds to even
    for bad in ((0, 1, 0), (1, 0, 0), (1, 1, 1.0), (1, 0.1, 0)):
        with pytest.raises(ValueError):
            sig.window_shape(*bad)


def test_short_signal_has_no_window(spark):
    df = spark.createDataFrame([("m", 3)], "measurement_id string, sample_count bigint")
    assert sig.window_bounds(df, F.lit(4).cast("bigint"), F.lit(4).cast("bigint")).count() == 0


def test_time_features_closed_form(spark):
    row = sig.channel_features(long_signal(spark, [3, 4]), ("measurement_id",)).first()
    assert row.rms == pytest.approx(math.sqrt(12.5)) and row.peak == 4 and row.peak_to_peak == 1
    flat = sig.channel_features(long_signal(spark, [0] * 16), ("measurement_id",)).first()
    assert (flat.skewness, flat.kurtosis, flat.crest_factor) == (0, 0, 0)


def test_array_and_long_features_agree(spark):
    values = np.random.default_rng(1).normal(size=64)
    arrays = spark.createDataFrame([("m", [float(v) for v in values])], "measurement_id string, samples array<double>")
    a = features.array_time_features(arrays).first()
    b = sig.channel_features(long_signal(spark, values), ("measurement_id",)).first()
    for name in sig.TIME_FEATURES:
        assert a[name] == pytest.approx(b[name])


def test_spectrum_of_a_sine_and_of_zeros(spark):
    sine = [float(v) for v in np.sin(2 * np.pi * 50 * np.arange(1000) / 1000)]
    df = spark.createDataFrame([("sine", sine, 1000.0), ("zero", [0.0] * 32, 1000.0)], "id string, s array<double>, r double")
    rows = {r.id: r.f for r in df.select("id", frequency_features("s", "r").alias("f")).collect()}
    assert rows["sine"].dominant_frequency_hz == pytest.approx(50.0)
    assert 0 <= rows["sine"].spectral_entropy <= 1
    assert set(rows["zero"]) == {0.0}
    levels = {r.id: r.db for r in df.select("id", relative_spectrum("s").alias("db")).collect()}
    assert max(levels["sine"]) == 0.0 and set(levels["zero"]) == {-160.0}


def test_non_finite_samples_fail(spark):
    df = spark.createDataFrame([([0.0, float("nan")], 1.0)], "s array<double>, r double")
    with pytest.raises(Exception, match="finite"):
        df.select(frequency_features("s", "r")).collect()


def test_sampling_facts_and_flags(spark):
    even = long_signal(spark, [1.0] * 9)
    facts = sig.sampling_facts(even)
    row = facts.first()
    assert row.uniform_time_axis and row.observed_rate_hz == pytest.approx(64.0)
    flags = sig.quality_flags(facts.withColumn("nominal_rate_hz", F.lit(100.0)), even).first()
    assert flags.constant_signal and flags.sampling_deviation and not flags.nonuniform_axis


def test_nominal_rates(spark):
    rows = [("vibration_1", "x"), ("force", "HostService 4kHz"), ("temp", "1Hz"), ("temp", "none")]
    df = spark.createDataFrame(rows, "c string, r string")
    assert [r[0] for r in df.select(sig.nominal_rate(F.col("c"), F.col("r"))).collect()] == [64000.0, 4000.0, 1.0, None]


def test_alignment(spark):
    rows = [("a", "x", 64, 64.0), ("a", "y", 64, 64.0), ("b", "x", 64, 64.0), ("c", "x", 64, 64.0), ("c", "y", 64, 32.0), ("d", "x", 64, 64.0), ("d", "y", 10, 64.0)]
    df = spark.createDataFrame(rows, "measurement_id string, channel string, sample_count bigint, nominal_rate_hz double")
    got = {r.measurement_id: r.alignment for r in sig.align_channels(df, ("x", "y"), 32).collect()}
    assert got == {"a": "OK", "b": "MISSING_CHANNEL", "c": "RATE_MISMATCH", "d": "CHANNEL_TOO_SHORT"}


def test_feature_spec(spark):
    with pytest.raises(ValueError):
        features.check_spec({})
    effects = spark.createDataFrame([("v", "spectral_energy", "C1", 0.9)], "signal string, feature string, condition string, cohens_d double")
    spec = profiling.feature_spec(profiling.recommend_features(effects), ("v",), sig.TIME_FEATURES).first()
    assert spec.frequency_domain_features == ["spectral_energy"] and spec.split.group == "measurement_id"


def test_condition_means_json(spark):
    rows = [("v", "rms", "healthy", "C2", 2.0), ("v", "rms", "healthy", "C1", 1.0)]
    df = spark.createDataFrame(rows, "signal string, feature string, state string, condition string, value double")
    assert profiling.condition_effects(df).first().condition_means_json == '{"C1":1.0,"C2":2.0}'


def test_split_is_disjoint_and_labels_are_consistent(spark):
    rows = [(f"m{i}", "healthy" if i % 3 else "damaged") for i in range(40)]
    df = spark.createDataFrame(rows, "measurement_id string, state string")
    split = ev.group_split(df)
    assert split.filter("side = 'test'").count() == math.ceil(0.25 * 26) + math.ceil(0.25 * 14)
    train, test = split.filter("side = 'train'"), split.filter("side = 'test'")
    ev.assert_disjoint(train, test, "measurement_id")
    with pytest.raises(ValueError):
        ev.assert_disjoint(train, train, "measurement_id")
    with pytest.raises(Exception, match="inconsistent label"):
        ev.group_split(df.unionByName(df.withColumn("state", F.lit("other")))).collect()


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([("w", "damaged", 0.9), ("w", "damaged", 0.2)], "level string, state string, probability double")
    row = ev.binary_metrics(df, ["level"]).first()
    assert row.roc_auc is None and row.precision == 1.0 and row.recall == 0.5


def test_small_forest(spark):
    rng = np.random.default_rng(0)
    rows = [
        (f"m{i // 4}", f"w{i}", "healthy" if (i // 4) % 2 else "damaged", float(rng.normal(0 if (i // 4) % 2 else 4)), float(rng.normal()))
        for i in range(96)
    ]
    df = spark.createDataFrame(rows, "measurement_id string, window_id string, state string, v__rms double, v__std double")
    model, scored, _ = analysis.train_and_score(df, trees=5, depth=3)
    assert ev.binary_metrics(scored.withColumn("level", F.lit("w")), ["level"]).first().accuracy > 0.9
    ranks = analysis.importance(model, analysis.feature_columns(df), "forest").orderBy("rank").collect()
    assert ranks[0].feature == "v__rms"


def test_baseline_run_stores_its_scores(spark, tmp_path):
    """Metrics and predictions read the stored scores of the test side instead of shipping the forest again."""
    rng = np.random.default_rng(1)
    rows = [
        (f"m{i // 4}", f"b{i % 2}", "c", f"w{i}", "healthy" if (i // 4) % 2 else "damaged", float(rng.normal((i // 4) % 2)), float(rng.normal()))
        for i in range(96)
    ]
    names = "measurement_id string, bearing_id string, condition string, window_id string, state string, v__rms double, v__std double"
    analysis.baseline_run(spark.createDataFrame(rows, names), str(tmp_path), trees=3, depth=2)
    scores = spark.read.parquet(f"{tmp_path}/scores")
    model, windows = analysis.load_run(spark, str(tmp_path))
    tested = {r.measurement_id for r in spark.read.parquet(f"{tmp_path}/split").filter("side = 'test'").collect()}
    again = analysis.score(model, windows).filter(F.col("measurement_id").isin(tested))
    pairs = ["window_id", "probability"]
    assert sorted(scores.select(pairs).collect()) == sorted(again.select(pairs).collect()) and scores.count() == 4 * len(tested)
    whole = spark.read.parquet(f"{tmp_path}/metrics").filter("level = 'window'").first()
    assert whole.sample_count == scores.count()


def test_a_forest_is_fitted_in_few_partitions(spark, monkeypatch):
    """Each partition sends the statistics of all nodes of a level; more of them than the cores need only add to that."""
    rows = [(f"m{i}", "healthy" if i % 2 else "damaged", float(i % 7), float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "measurement_id string, state string, v__rms double, v__std double")
    parts = []

    class Fitted:
        def __init__(self, stages):
            pass

        def fit(self, train):
            parts.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(analysis, "Pipeline", Fitted)
    most = analysis.FIT_TASKS * spark.sparkContext.defaultParallelism
    analysis.fit(df.repartition(5 * most))
    analysis.fit(df.repartition(2))
    assert parts == [(most, 400), (2, 400)]


def test_model_check():
    meta = {"model_id": "a", "feature_list": ["x"], "feature_version": "1"}
    ev.check_model(meta, dict(meta))
    with pytest.raises(ValueError):
        ev.check_model(meta, {**meta, "feature_list": ["y"]})
