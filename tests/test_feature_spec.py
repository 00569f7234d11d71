"""The feature table over channels of a specification against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.features import spec_feature_table, window_plan

SPEC = {
    "diagnostic_channels": ["vibration_1", "phase_current_1"],
    "window_duration_sec": 2.0,
    "overlap_percent": 50,
    "time_domain_features": ["mean", "std"],
    "frequency_domain_features": ["dominant_frequency_hz"],
    "split": {"group": "measurement_id"},
}
#: measurement: (state, {channel: (samples, rate)})
RECORDED = {
    "ok4": ("healthy", {"vibration_1": (21, 4.0), "phase_current_1": (25, 4.0), "other": (9, 1.0)}),
    "ok2": ("damaged", {"vibration_1": (9, 2.0), "phase_current_1": (8, 2.0)}),
    "tiny": ("damaged", {"vibration_1": (3, 2.0), "phase_current_1": (3, 2.0)}),
    "short": ("damaged", {"vibration_1": (9, 2.0), "phase_current_1": (7, 2.0)}),
    "lacks": ("healthy", {"vibration_1": (9, 2.0)}),
    "mixed": ("healthy", {"vibration_1": (9, 2.0), "phase_current_1": (9, 4.0)}),
    "unrated": ("healthy", {"vibration_1": (9, 2.0), "phase_current_1": (9, None)}),
    "odd": ("unknown", {"vibration_1": (9, 2.0), "phase_current_1": (9, 2.0)}),
}


def value(m, c, i):
    return float((hash_of(m) + 7 * hash_of(c) + i * i) % 11)


def hash_of(text):
    return sum(map(ord, text))


@pytest.fixture(scope="module")
def recording(spark):
    rows = [(m, c, i, value(m, c, i)) for m, (_, cs) in RECORDED.items() for c, (n, _) in cs.items() for i in range(n)]
    facts = [(m, s, c, r, n) for m, (s, cs) in RECORDED.items() for c, (n, r) in cs.items()]
    signals = spark.createDataFrame(rows, "measurement_id string, channel string, idx long, x double")
    return signals, spark.createDataFrame(facts, "measurement_id string, state string, channel string, nominal_rate_hz double, sample_count long")


def test_measurements_that_do_not_fit_are_named(recording):
    got = {r.measurement_id: (r.windows, r.reject_code) for r in window_plan(recording[1], SPEC).collect()}
    assert got["ok4"] == (4, None) and got["ok2"] == (3, None) and got["tiny"] == (0, None)
    assert {m: c for m, (_, c) in got.items() if c} == {
        "short": "CHANNEL_TOO_SHORT", "lacks": "MISSING_CHANNEL", "mixed": "RATE_MISMATCH", "unrated": "NO_VERIFIED_RATE", "odd": "STATE_UNKNOWN",
    }


def test_windows_of_all_channels_follow_the_reference(recording):
    signals, facts = recording
    got = {(r.measurement_id, r.window_id): r for r in spec_feature_table(signals, window_plan(facts, SPEC), SPEC).collect()}
    assert set(got) == {("ok4", f"w{w:03d}") for w in range(4)} | {("ok2", f"w{w:03d}") for w in range(3)}
    for (m, name), r in got.items():
        size, w = {"ok4": 8, "ok2": 4}[m], int(name[1:])
        assert (r.window_start, r.window_end) == (w * size // 2, w * size // 2 + size)
        for c in SPEC["diagnostic_channels"]:
            x = np.array([value(m, c, i) for i in range(r.window_start, r.window_end)])
            assert r[f"{c}__mean"] == pytest.approx(x.mean()) and r[f"{c}__std"] == pytest.approx(x.std())
            assert 0 <= r[f"{c}__dominant_frequency_hz"] <= {"ok4": 2.0, "ok2": 1.0}[m]


@pytest.mark.parametrize("change", [{"split": {"group": "bearing_id"}}, {"time_domain_features": ["mean", "loudness"]}, {"overlap_percent": None}])
def test_a_bad_specification_is_rejected(recording, change):
    spec = {k: v for k, v in (SPEC | change).items() if v is not None}
    with pytest.raises(ValueError):
        signals, facts = recording
        spec_feature_table(signals, window_plan(facts, spec), spec)


def test_a_feature_that_is_not_finite_fails(recording):
    signals, facts = recording
    broken = signals.withColumn("x", F.when(F.col("idx") == 5, float("nan")).otherwise(F.col("x")))
    timed = SPEC | {"frequency_domain_features": []}
    with pytest.raises(Exception, match="not finite"):
        spec_feature_table(broken, window_plan(facts, timed), timed).collect()
