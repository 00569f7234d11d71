"""Structured Streaming jobs over run events.

Results and checkpoints go below one shared folder. The jobs use ``availableNow``, so the same
code drains a backlog and, with another trigger, runs continuously. Results are logs of keyed batches:
every micro-batch writes its own folder, a repeated batch replaces itself, and a read merges the
batches by key. COMPACT folders of a size are merged into one of the next size and then removed, so
a log of n batches has about COMPACT * log(n) folders, holds its rows at most twice for a batch's time,
and writes a row again log(n) times.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators import events as ev
from plumbline.operators import memory as mem
from plumbline.session import STATE_STORE, shared_folder

COMPACT = 16  # folders of one size that are merged into one
EVENT_BUCKETS = 64  # parts of the event log by id, so that a batch looks up only the buckets it touches
RUN_BUCKETS = 4096  # keys of the wait/resume state; a stream keeps the number that it started with
HOLD_MS = 600_000  # how long an answer waits for a request that has not come yet, unless told otherwise
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
KEEP_MS = 86_400_000  # how long a resolved request is remembered


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names."""
    return f"{shared_folder(spark)}/jobs/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream with the schema of its files: one file, or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if not _status(spark, path).isDirectory():
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _status(spark: SparkSession, path: str):
    files, target = _files(spark, path)
    return files.getFileStatus(target)


def run_to_end(stream: DataFrame, folder: str, name: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Run a stream to the end of its input, one call of ``write`` per batch.

    Returns how many rows its operators left out because they came after the watermark (of the batches
    whose progress the session keeps).
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_{name}").trigger(availableNow=True)
    query = writer.foreachBatch(lambda batch, number: write(batch, number)).start()
    query.awaitTermination()
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


class KeyedLog:
    """Rows of micro-batches under a folder, merged by key on read.

    A folder ``run=<first>-<last>`` holds the merged rows of these batches. ``merge`` must give the same
    rows whether it sees all batches or earlier merges of some of them. With ``bucket`` each folder is
    split by that column, and a filter on ``_bucket`` reads only its parts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], bucket: Column | None = None) -> None:
        self.spark, self.folder, self.merge, self.bucket = spark, folder, merge, bucket
        added = [T.StructField("_batch", T.LongType())] + ([] if bucket is None else [T.StructField("_bucket", T.IntegerType())])
        self.schema = T.StructType([*schema.fields, *added])

    def _folders(self) -> dict[tuple[int, int], bool]:
        """(first, last) of all folders, and whether they are whole."""
        files, target = _files(self.spark, self.folder)
        if not files.exists(target):
            return {}
        found = {m: s.getPath() for s in files.listStatus(target) if (m := re.fullmatch(r"run=(\d+)-(\d+)", s.getPath().getName()))}
        return {(int(m[1]), int(m[2])): files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for m, p in found.items()}

    def runs(self, before: int, start: int = 0, but: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """The widest whole folders that hold the batches from ``start`` up to ``before``."""
        whole = sorted((first, -last) for (first, last), done in self._folders().items() if done and last < before and (first, last) != but)
        out: list[tuple[int, int]] = []
        for first, last in whole:
            if first >= start and (not out or first > out[-1][1]):
                out.append((first, -last))
        return out

    def rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.folder}/run={first}-{last}" for first, last in runs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*paths).select(*self.schema.fieldNames())

    def read(self, before: int = 2**62) -> DataFrame:
        """The merged table of all batches below ``before``."""
        return self.merge(self.rows(self.runs(before))).drop("_batch", "_bucket")

    def _save(self, rows: DataFrame, first: int, last: int) -> None:
        rows = rows.select(*self.schema.fieldNames())
        writer = rows.write if self.bucket is None else rows.repartition("_bucket").write.partitionBy("_bucket")
        writer.mode("overwrite").parquet(f"{self.folder}/run={first}-{last}")

    def _remove_merged(self, number: int) -> None:
        """Folders whose batches a wider one holds. Batches before ``number`` are committed and never run again."""
        wide = self.runs(number)
        files, _ = _files(self.spark, self.folder)
        for first, last in self._folders():
            if last < number and (first, last) not in wide:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run={first}-{last}"), True)

    def write(self, rows: DataFrame, number: int) -> None:
        self._remove_merged(number)
        rows = rows.withColumn("_batch", F.lit(number).cast("long"))
        self._save(rows if self.bucket is None else rows.withColumn("_bucket", self.bucket), number, number)
        size = COMPACT
        while (number + 1) % size == 0:
            first = number + 1 - size
            self._save(self.merge(self.rows(self.runs(number + 1, first, but=(first, number)))), first, number)
            size *= COMPACT


class EventLog(KeyedLog):
    """Every event id once, however late and however often it is delivered."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int = EVENT_BUCKETS) -> None:
        super().__init__(spark, folder, schema, lambda rows: rows, F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))

    def append(self, batch: DataFrame, number: int) -> DataFrame:
        """Store the events of a batch that no earlier batch had, and return them as stored.

        A batch is reduced to its first deliveries and joined against the ids in the buckets that it
        touches; there is no delay after which an event is lost or a repeat is kept.
        """
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(self.bucket.alias("b")).distinct().collect()]  # at most the number of buckets
            known = self.rows(self.runs(number)).filter(F.col("_bucket").isin(touched)) if touched else self.rows([])
            self.write(ev.append_new(known, batch), number)
        finally:
            batch.unpersist()
        return self.rows([(number, number)]).drop("_batch", "_bucket")


def append_events(events: DataFrame, folder: str) -> DataFrame:
    """All events of a stream, each id once."""
    log = EventLog(events.sparkSession, f"{folder}/events", events.schema)
    run_to_end(events, folder, "events", lambda batch, number: log.append(batch, number))
    return log.read()


def merge_states(parts: DataFrame) -> DataFrame:
    """Run states from partial states of disjoint events."""
    return parts.groupBy("run_id").agg(
        F.max("last_sequence").alias("last_sequence"),
        F.max_by("current_node", "last_sequence").alias("current_node"),
        F.sum("event_count").alias("event_count"),
        F.sum("retrievals").alias("retrievals"),
        F.max("completed").alias("completed"),
        F.max("_batch").alias("_batch"),
    )


def materialise_states(events: DataFrame, folder: str) -> DataFrame:
    """State per run: batches store partial states of the events that are new in them, a read adds them up.

    An event that is delivered again, in its batch or in a later one, counts once.
    """
    spark = events.sparkSession
    seen = EventLog(spark, f"{folder}/events", events.schema)
    states = KeyedLog(spark, f"{folder}/run_state", ev.run_state(events).schema, merge_states)
    run_to_end(events, folder, "run_state", lambda batch, number: states.write(ev.run_state(seen.append(batch, number)), number))
    return states.read()


def merge_records(parts: DataFrame) -> DataFrame:
    """Newest content of every natural key, as a stored upsert gives it."""
    return mem.latest(parts, mem.KEY, F.struct("event_time", "_batch", "memory_id"))


def memory_sink(runs: DataFrame, folder: str) -> DataFrame:
    """Memory records of runs that reached COMPLETED, upserted by their natural key."""
    log = KeyedLog(runs.sparkSession, f"{folder}/memory", mem.records_from_runs(runs).schema, merge_records)
    run_to_end(runs, folder, "memory", lambda batch, number: log.write(mem.records_from_runs(batch), number))
    return log.read()


class WaitResume(StatefulProcessor):
    """Per run: WAITING on a request until the matching response, which counts once.

    All rows of a micro-batch are put in order of position before they are judged. Each call on the state goes
    from the worker to the executor and back, so a run's request, status and timer are one value. An answer whose request has not been seen waits for it in state, ``hold_ms`` at
    most; a resolved request leaves the state after KEEP_MS.
    """

    def __init__(self, hold_ms: int = HOLD_MS) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """``until`` is the time of the run's timer, 0 without one; answers are held only under the status HELD."""
        request = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("until", T.LongType())])
        answer = T.StructType([T.StructField("position", T.LongType()), T.StructField("request_id", T.StringType())])
        self.handle = handle
        self.state = handle.getValueState("request", request)
        self.held = handle.getListState("held", answer)

    def judged(self, messages: list[tuple], now: int) -> list[tuple]:
        """Outcomes (request_id, outcome) of the messages (position, kind, request_id) of a run in a micro-batch."""
        request, status, timer = self.state.get() or (None, None, 0)
        before, until = (request, status), 0
        if status == "HELD":
            messages = [(position, "response", answer) for position, answer in self.held.get()] + messages
            self.held.clear()
            status = None
        messages.sort(key=lambda m: m[0])
        early, out = [], []
        for position, kind, request_id in messages:
            if kind == "request":
                if status != "WAITING":
                    request, status = request_id, "WAITING"
                    out.append((request_id, "WAITING"))
            elif status is None:
                early.append((position, request_id))
            elif request_id != request:
                out.append((request_id, "REQUEST_MISMATCH"))
            elif status == "RESUMED":
                out.append((request_id, "ALREADY_RESOLVED"))
            else:
                status = "RESUMED"
                out.append((request_id, "RESUMED"))
        if status is None:
            status, until = "HELD", now + self.hold_ms
            self.held.put(early)
        else:
            out += [(request_id, "NO_PENDING_REQUEST") for _, request_id in early]
            until = now + KEEP_MS if status == "RESUMED" else 0
        if timer not in (0, until):
            self.handle.deleteTimer(timer)
        if until not in (0, timer):
            self.handle.registerTimer(until)
        if (request, status) != before or until != timer:
            self.state.update((request, status, until))
        return out

    def expired(self) -> list[tuple]:
        """Outcomes of the answers that waited in vain, if that is why the run's timer went off; the run is forgotten."""
        _, status, _ = self.state.get() or (None, None, 0)
        out = []
        if status == "HELD":
            out = [(request_id, "NO_PENDING_REQUEST") for _, request_id in self.held.get()]
            self.held.clear()
        self.state.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        messages = [(r["position"], r["kind"], r["request_id"]) for r in rows]
        for request_id, outcome in self.judged(messages, timers.getCurrentProcessingTimeInMs()):
            yield Row(run_id=key[0], request_id=request_id, outcome=outcome)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        for request_id, outcome in self.expired():
            yield Row(run_id=key[0], request_id=request_id, outcome=outcome)

    def close(self) -> None:
        pass


class InMemory:
    """A run's value or list while its bucket is judged; calls on it are no round trips."""

    value = None

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value

    put = update

    def clear(self) -> None:
        self.value = None


class Untimed:
    """Stands for the timers of single runs: a run's time is part of its value, and its bucket has the timer."""

    def registerTimer(self, at: int) -> None:
        pass

    deleteTimer = registerTimer


class WaitResumeBuckets(StatefulProcessor):
    """WaitResume for all runs of a bucket at once.

    A key costs several round trips, a record batch and a scan of its own, so a key stands for many runs. Their states
    are a list of compressed parts: a micro-batch appends the runs that it changed, later parts win, and every COMPACT
    parts become one. The bucket's timer goes off at the earliest time of its runs.
    """

    def __init__(self, hold_ms: int = HOLD_MS) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("runs", T.StructType([T.StructField("part", T.BinaryType())]))
        self.alarm = handle.getValueState("alarm", T.StructType([T.StructField("until", T.LongType())]))
        self.judge = WaitResume(self.hold_ms)
        self.judge.handle, self.judge.state, self.judge.held = Untimed(), InMemory(), InMemory()

    def _load(self) -> None:
        self.runs, self.changed, self.read = {}, {}, 0
        for (part,) in self.parts.get():
            self.runs.update((run, state) for run, state in json.loads(zlib.decompress(bytes(part))))
            self.read += 1

    def _told(self, run, call: Callable[[], list[tuple]]) -> list[tuple]:
        """Outcomes of a call on the judge with the state of a run, [value, held]; None is a run that is forgotten."""
        state = self.runs.get(run)
        self.judge.state.value, self.judge.held.value = state or (None, None)
        out = call()
        after = None if self.judge.state.value is None else [list(self.judge.state.value), self.judge.held.value]
        if after != state:
            self.runs[run] = self.changed[run] = after
        return out

    def _keep(self, expiring: int = 0) -> None:
        """Append what changed and set the timer; ``expiring`` is a timer that goes away by itself."""
        if self.changed:
            if self.read + 1 < COMPACT:
                self.parts.appendValue((zlib.compress(json.dumps(list(self.changed.items())).encode(), 1),))
            elif living := [(run, state) for run, state in self.runs.items() if state is not None]:
                self.parts.put([(zlib.compress(json.dumps(living).encode(), 1),)])
            else:
                self.parts.clear()
        first = min((state[0][2] for state in self.runs.values() if state is not None and state[0][2]), default=0)
        before = (self.alarm.get() or (0,))[0]
        if before != first:
            if before not in (0, expiring):
                self.handle.deleteTimer(before)
            if first:
                self.handle.registerTimer(first)
            self.alarm.update((first,))

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["run_id", "request_id", "outcome"], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        self._load()
        now, told, out = timers.getCurrentProcessingTimeInMs(), {}, []
        for batch in rows:
            for run, *message in zip(*(batch[c].tolist() for c in ("run_id", "position", "kind", "request_id"))):
                told.setdefault(run, []).append(tuple(message))
        for run, messages in told.items():
            out += [(run, *outcome) for outcome in self._told(run, lambda: self.judge.judged(messages, now))]
        self._keep()
        yield self._rows(out)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self._load()
        now, out = timers.getCurrentProcessingTimeInMs(), []
        for run in [run for run, state in self.runs.items() if state is not None and 0 < state[0][2] <= now]:
            out += [(run, *outcome) for outcome in self._told(run, self.judge.expired)]
        self._keep(expired.getExpiryTimeInMs())
        yield self._rows(out)

    def close(self) -> None:
        pass


def wait_resume(messages: DataFrame, hold_ms: int = HOLD_MS) -> DataFrame:
    """Outcome per message (run_id, kind, request_id, position) in the order of positions, judged in buckets of runs."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int").alias("bucket")
    return messages.select("run_id", "kind", "request_id", "position", bucket).groupBy("bucket").transformWithStateInPandas(
        WaitResumeBuckets(hold_ms), outputStructType="run_id string, request_id string, outcome string", outputMode="Append", timeMode="ProcessingTime"
    )


def outcomes(messages: DataFrame, folder: str, hold_ms: int = HOLD_MS) -> DataFrame:
    """All outcomes of a stream of messages, drained once.

    Timers keep a stream busy with batches that have no data, so these are off while it drains.
    """
    spark, stream = messages.sparkSession, wait_resume(messages, hold_ms)
    log = KeyedLog(spark, f"{folder}/outcomes", stream.schema, lambda rows: rows)
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        run_to_end(stream, folder, "outcomes", lambda batch, number: log.write(batch, number))
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    return log.read()
