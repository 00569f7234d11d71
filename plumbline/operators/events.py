"""Run events: numbering, idempotent append, cursors and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators.ordered import ordinal, with_next

# Fixed value: events a viewer keeps per run.
KEPT_EVENTS = 500
SLICE = 1000


def number_events(events: DataFrame, position: str = "position") -> DataFrame:
    """Sequence 1..n per run in the order of ``position``."""
    return ordinal(events, ["run_id"], F.floor(F.col(position) / SLICE), [position], "sequence")


def append_new(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events that are new; the first delivery of an event id wins."""
    rest = [c for c in incoming.columns if c != "event_id"]
    first = incoming.groupBy("event_id").agg(F.min(F.struct("sequence", *[c for c in rest if c != "sequence"])).alias("_e"))
    return first.select("event_id", "_e.*").join(stored.select("event_id"), "event_id", "left_anti")


def merge_last(parts: DataFrame, version: str) -> DataFrame:
    """State merge: the last write of an event id wins."""
    rest = [c for c in parts.columns if c not in ("event_id", version)]
    return parts.groupBy("event_id").agg(F.max_by(F.struct(*rest), F.col(version)).alias("_e")).select("event_id", "_e.*")


def keep_last(events: DataFrame, limit: int = KEPT_EVENTS) -> DataFrame:
    """Newest ``limit`` events per run."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy(F.desc("sequence"))
    return events.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")


def events_after(events: DataFrame, run_id: str, sequence: int) -> DataFrame:
    """Cursor read: both filters reach the file scan."""
    return events.filter((F.col("run_id") == run_id) & (F.col("sequence") > sequence)).orderBy("sequence")


def run_state(events: DataFrame) -> DataFrame:
    """Latest node and counters per run (mergeable, so also a streaming aggregate)."""
    at = F.col("sequence")
    return events.groupBy("run_id").agg(
        F.max("sequence").alias("last_sequence"),
        F.max_by("node", at).alias("current_node"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("node") == "retrieve_knowledge").alias("retrievals"),
        F.max((F.col("event_type") == "workflow_completed").cast("int")).alias("completed"),
    )


def error_events(runs: DataFrame, events: DataFrame) -> DataFrame:
    """One error event per failed run, after its last sequence."""
    last = events.groupBy("run_id").agg(F.max("sequence").alias("_last"))
    failed = runs.filter(F.col("workflow_status") == "FAILED").select("run_id")
    sequence = F.coalesce("_last", F.lit(0)) + 1
    return failed.join(last, "run_id", "left").select(
        "run_id",
        sequence.cast("bigint").alias("sequence"),
        tx.short_hash("event_", F.col("run_id"), F.lit("workflow_error"), sequence.cast("string")).alias("event_id"),
        F.lit("workflow_error").alias("event_type"),
        F.lit("system").alias("node"),
        F.lit("SYSTEM").alias("agent_role"),
    )


def event_contract(events: DataFrame, position: str) -> DataFrame:
    """Per run: unique and ordered sequences, roles present, completion event seen.

    Order is judged between neighbours by arrival position, in blocks.
    """
    pairs = with_next(events.select("run_id", position, "sequence"), ["run_id"], position, {"_next": "sequence"})
    ordered = pairs.groupBy("run_id").agg(F.every(F.coalesce(F.col("_next") >= F.col("sequence"), F.lit(True))).alias("ordered_sequence"))
    facts = events.groupBy("run_id").agg(
        (F.count(F.lit(1)) == F.count_distinct("sequence")).alias("unique_sequence"),
        F.every(F.col("agent_role").isNotNull() & (F.col("agent_role") != "")).alias("roles_present"),
        F.some(F.col("event_type") == "workflow_completed").alias("completed_event"),
    )
    return facts.join(ordered, "run_id")
