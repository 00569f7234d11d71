"""Replayed streams against the same aggregates over the whole table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import windows

START = dt.datetime(2024, 5, 1)
HOUR = 3600


def recording(spark, n=400, hours=30):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), START + dt.timedelta(seconds=rng.uniform(0, hours * HOUR)), float(rng.randint(0, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, at timestamp, x double")


def replayed(rows, folder, behind=1, hours=12):
    return windows.replay(windows.deliveries(rows, "at", hours * HOUR, behind, "id"), str(folder), files=3, end="at")


def comparable(df):
    return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("width,slide", [("4 hours", None), ("6 hours", "2 hours")])
def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path, width, slide):
    rows = recording(spark)
    got = windows.stream_window_features(replayed(rows, tmp_path / "in"), str(tmp_path / "out"), "f", "at", "x", ["key"], "24 hours", width, slide)
    want = windows.window_features(rows, "at", "x", ["key"], width, slide)
    assert comparable(got) == comparable(want.select(*got.columns))


def test_every_session_is_closed(spark, tmp_path):
    rows = recording(spark, n=120)
    got = windows.stream_sessions(replayed(rows, tmp_path / "in"), str(tmp_path / "out"), "s", "at", "x", ["key"], "24 hours", "30 minutes")
    assert comparable(got) == comparable(windows.sessions(rows, "at", "x", ["key"], "30 minutes").select(*got.columns))
    assert got.agg(F.sum("n")).first()[0] == 120


def test_rows_behind_the_watermark_are_reported(spark, tmp_path):
    with pytest.raises(windows.LateRows):
        stream = replayed(recording(spark), tmp_path / "in", behind=4, hours=6)
        windows.stream_window_features(stream, str(tmp_path / "out"), "f", "at", "x", ["key"], "1 hour", "1 hour")


def test_deliveries_hold_every_row_once_and_at_most_so_late(spark):
    rows = recording(spark)
    parts = [[(r["id"], r["at"]) for r in p.collect()] for p in windows.deliveries(rows, "at", 12 * HOUR, 1, "id")]
    assert sorted(i for p in parts for i, _ in p) == list(range(400))
    assert all(max(t for _, t in p) - min(t for _, t in p) <= dt.timedelta(hours=24) for p in parts)
    assert list(windows.deliveries(rows.limit(0), "at", HOUR, 1, "id")) == []
