"""Streams over many files, delivered newest first, one file per batch."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.plans import QUERIES
from plumbline.session import shared_folder
from plumbline.streaming import jobs


def write_files(frames, folder):
    """One file per frame, the last frame oldest by modification time."""
    folder.mkdir()
    now = time.time()
    for i, frame in enumerate(frames):
        path = folder / f"part-{i}.parquet"
        frame.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (now - 1000 + i, now - 1000 + i))


def stream_of(spark, folder):
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_no_event_is_lost_and_none_twice(spark, tmp_path):
    rows = [(f"e{r}_{i}", f"r{r}", i, "diagnose", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=r)) for r in range(40) for i in range(1, 5)]
    frames = [pd.DataFrame(part, columns=["event_id", "run_id", "sequence", "node", "at"]) for part in (rows[100:], rows[50:120], rows[:60])]
    write_files(frames, tmp_path / "in")
    out = jobs.append_events(stream_of(spark, tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(r.event_id for r in out.collect()) == sorted(r[0] for r in rows)
    assert len(list((tmp_path / "out" / "events").glob("run=*"))) == 3


STATE_COLUMNS = ["event_id", "run_id", "sequence", "node", "event_type"]


def state_rows():
    return [(f"e{r}_{i}", f"r{r}", i, "diagnose" if i % 2 else "retrieve_knowledge", "workflow_completed" if i == 6 else "node") for r in range(5) for i in range(1, 7)]


def test_states_add_up_over_batches_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 2)
    rows = state_rows()
    frames = [pd.DataFrame(rows[k::5], columns=STATE_COLUMNS) for k in range(5)]
    write_files([*frames[::-1], frames[1], frames[3]], tmp_path / "in")
    got = {tuple(r) for r in jobs.materialise_states(stream_of(spark, tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {(f"r{r}", 6, "retrieve_knowledge", 6, 3, 1) for r in range(5)}


def test_events_delivered_again_count_once(spark, tmp_path):
    frame = pd.DataFrame(state_rows(), columns=STATE_COLUMNS)
    write_files([frame, frame, pd.concat([frame, frame])], tmp_path / "in")
    got = {tuple(r) for r in jobs.materialise_states(stream_of(spark, tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {(f"r{r}", 6, "retrieve_knowledge", 6, 3, 1) for r in range(5)}


def test_a_log_of_many_batches_keeps_few_folders_and_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 4)
    log = jobs.KeyedLog(spark, str(tmp_path / "log"), spark.range(1).schema, lambda rows: rows)
    for number in range(70):
        log.write(spark.range(number * 10, number * 10 + 10).coalesce(1), number)
        if number % 9 == 0:
            log.write(spark.range(number * 10, number * 10 + 10).coalesce(1), number)  # the batch runs again
    folders = sorted(p.name for p in (tmp_path / "log").glob("run=*"))
    assert folders == ["run=0-63", "run=64-67", "run=68-68", "run=69-69"]
    assert sorted(r.id for r in log.read().collect()) == list(range(700))
    assert sorted(r.id for r in log.read(before=69).collect()) == list(range(690))


def test_answers_are_judged_in_order_of_position(spark, tmp_path):
    many = 12_000
    big = pd.DataFrame({"run_id": "a", "kind": ["response"] * (many - 1) + ["request"], "request_id": "q", "position": range(many - 1, -1, -1)})
    late_request = pd.DataFrame([("b", "response", "q", 2), ("b", "response", "q", 3)], columns=["run_id", "kind", "request_id", "position"])
    request = pd.DataFrame([("b", "request", "q", 1), ("c", "request", "q", 5), ("c", "response", "x", 6)], columns=["run_id", "kind", "request_id", "position"])
    write_files([pd.concat([big, late_request]), request], tmp_path / "in")
    out = jobs.outcomes(stream_of(spark, tmp_path / "in"), str(tmp_path / "out"))
    got = {tuple(r)[:2]: r["n"] for r in out.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {
        ("a", "WAITING"): 1, ("a", "RESUMED"): 1, ("a", "ALREADY_RESOLVED"): many - 2,
        ("b", "WAITING"): 1, ("b", "RESUMED"): 1, ("b", "ALREADY_RESOLVED"): 1,
        ("c", "WAITING"): 1, ("c", "REQUEST_MISMATCH"): 1,
    }


def test_tables_of_part_files_are_read(spark, sf, tmp_path):
    for name in ("conversations", "orders"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.event_id for r in QUERIES["stream_append"](spark, str(tmp_path)).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_nothing_written_is_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("event_id string, run_id string, sequence long, node string").parquet(str(tmp_path / "in"))
    assert jobs.append_events(stream, str(tmp_path / "out")).collect() == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


class Kept:
    """A state of one run that counts the calls on it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def _call(self, value):
        self.calls.append(1)
        self.value = value

    def get(self):
        self.calls.append(1)
        return self.value

    def update(self, value):
        self._call(value)

    put = update

    def clear(self):
        self._call(None)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, *_):
        return Kept(self.calls)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls.append(1)
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append(1)
        self.timers.remove(at)


class Clock:
    now = 1000

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_a_run_costs_few_calls_on_its_state():
    """Every call is a round trip; a held answer expires, meets its request, or is judged after it."""
    handle, clock, judge = Handle(), Clock(), jobs.WaitResume(hold_ms=50)
    judge.init(handle)

    def told(*messages):
        handle.calls.clear()
        rows = [Row(run_id="a", position=p, kind=k, request_id=r) for p, k, r in messages]
        return [r.outcome for r in judge.handleInputRows(("a",), iter(rows), clock)]

    assert told((2, "response", "q"), (1, "request", "q"), (3, "response", "q")) == ["WAITING", "RESUMED", "ALREADY_RESOLVED"]
    assert len(handle.calls) <= 3 and handle.timers == {1000 + jobs.KEEP_MS}
    assert told((4, "request", "r")) == ["WAITING"] and handle.timers == set()
    assert told((5, "response", "x")) == ["REQUEST_MISMATCH"] and len(handle.calls) == 1
    judge.init(handle)
    assert told((2, "response", "q")) == [] and handle.timers == {1050}
    assert told((1, "request", "q")) == ["WAITING", "RESUMED"] and handle.timers == {1000 + jobs.KEEP_MS}
    handle.timers.clear()
    judge.init(handle)
    assert told((2, "response", "q")) == []
    assert [r.outcome for r in judge.handleExpiredTimer(("a",), clock, None)] == ["NO_PENDING_REQUEST"]
    handle.timers.clear()
    assert told((3, "request", "q")) == ["WAITING"]


class Bucket(Handle):
    """The states and the timer of one bucket."""

    def getValueState(self, *_):
        return Kept(self.calls)

    def getListState(self, *_):
        parts = Kept(self.calls)
        parts.value = []
        parts.appendValue = lambda part: parts.put([*parts.value, part])
        parts.clear = lambda: parts.put([])
        return parts


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_runs_of_a_bucket_share_its_calls_and_timer(monkeypatch):
    """Each run ends as it would alone, a bucket costs as many calls for many runs as for one, and parts of its state are merged."""
    monkeypatch.setattr(jobs, "COMPACT", 3)
    handle, clock, bucket = Bucket(), Clock(), jobs.WaitResumeBuckets(hold_ms=50)
    bucket.init(handle)

    def told(now, *messages):
        handle.calls.clear()
        monkeypatch.setattr(Clock, "now", now)
        frame = pd.DataFrame(messages, columns=["run_id", "position", "kind", "request_id"])
        return [tuple(r) for out in bucket.handleInputRows((1,), iter([frame[:1], frame[1:]]), clock) for r in out.itertuples(index=False)]

    def rings(at):
        monkeypatch.setattr(Clock, "now", at)
        due = [t for t in handle.timers if t <= at]
        out = [tuple(r) for t in due for frame in bucket.handleExpiredTimer((1,), clock, Expired(t)) for r in frame.itertuples(index=False)]
        handle.timers -= set(due)
        return out

    assert told(1000, ("a", 2, "response", "q"), (None, 1, "request", "n"), ("a", 1, "request", "q"), ("b", 5, "response", "x")) == [("a", "q", "WAITING"), ("a", "q", "RESUMED"), (None, "n", "WAITING")]
    assert handle.timers == {1050}  # b waits for its request, a is remembered for longer
    many = [(f"m{i}", 1, "request", "q") for i in range(500)]
    assert len(told(1010, *many)) == 500 and len(handle.calls) <= 4
    assert told(1020, ("b", 1, "request", "x"), ("m7", 2, "response", "q"), (None, 2, "response", "other")) == [("b", "x", "WAITING"), ("b", "x", "RESUMED"), ("m7", "q", "RESUMED"), (None, "other", "REQUEST_MISMATCH")]
    assert handle.timers == {1000 + jobs.KEEP_MS} and len(bucket.parts.value) == 1
    assert told(1030, ("late", 1, "response", "z"), ("a", 3, "response", "q")) == [("a", "q", "ALREADY_RESOLVED")]
    assert handle.timers == {1080} and rings(1080) == [("late", "z", "NO_PENDING_REQUEST")]
    assert rings(2000 + jobs.KEEP_MS) == [] and handle.timers == set()
    assert told(3000 + jobs.KEEP_MS, ("a", 9, "response", "q"), ("m8", 3, "response", "q")) == [("m8", "q", "RESUMED")]


def test_runs_are_judged_in_buckets(spark, tmp_path, monkeypatch):
    """Two batches over few buckets; the state of many runs is found again in the second."""
    monkeypatch.setattr(jobs, "RUN_BUCKETS", 5)
    columns = ["run_id", "kind", "request_id", "position"]
    first = [(f"r{i}", "request", f"q{i}", 1) for i in range(200)] + [(f"s{i}", "response", "p", 2) for i in range(50)]
    second = [(f"r{i}", "response", f"q{i}" if i % 2 else "x", 2) for i in range(200)] + [(f"s{i}", "request", "p", 1) for i in range(50)]
    write_files([pd.DataFrame(first, columns=columns), pd.DataFrame(second, columns=columns)], tmp_path / "in")
    stream = jobs.wait_resume(stream_of(spark, tmp_path / "in"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan
    out = jobs.outcomes(stream_of(spark, tmp_path / "in"), str(tmp_path / "out"))
    got = {tuple(r): r["count"] for r in out.groupBy(F.substring("run_id", 1, 1).alias("k"), "outcome").count().select("k", "outcome", "count").collect()}
    assert {k[:2]: n for k, n in got.items()} == {("r", "WAITING"): 200, ("r", "RESUMED"): 100, ("r", "REQUEST_MISMATCH"): 100, ("s", "WAITING"): 50, ("s", "RESUMED"): 50}
