"""Equipment memory: records from completed runs, upserts, context selection and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx

# History depth, rows per type and the types a context shows.
HISTORY_LIMIT = 100
RECENT_LIMIT = 5
CONTEXT_TYPES = ("MEASUREMENT", "ANALYSIS", "DIAGNOSIS", "HUMAN_OBSERVATION")
UNRESOLVED_TYPES = ("DIAGNOSIS", "ACTION")
KEY = ("equipment_id", "memory_type", "source_type", "source_id")


def memory_id(equipment: Column, kind: Column, source: Column) -> Column:
    return tx.short_hash("memory_", equipment, kind, source)


def latest(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Newest row per key as a mergeable aggregate; no key is sorted whole."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Union of stored and new records; the newest content of a natural key wins."""
    return latest(stored.unionByName(new), KEY, F.struct("recorded_at", "memory_id"))


def records_from_runs(runs: DataFrame) -> DataFrame:
    """Typed records of completed runs: one row per record kind the run has.

    Columns used: run_id, equipment_id, measurement_id, condition, analysis_status,
    predicted_class, model_id, candidates, plan_steps, actions, images (array<string>),
    observations (array<string>), event_time.
    """

    def record(kind: str, source: str, source_id: Column, status: str, summary: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("memory_type"),
            F.lit(source).alias("source_type"),
            source_id.alias("source_id"),
            F.lit(status).alias("status"),
            summary.alias("summary"),
        )

    run = F.col("run_id")
    condition = F.coalesce("condition", F.lit("unknown"))
    single = F.array_compact(
        F.array(
            record(
                "MEASUREMENT", "SENSOR", run, "MEASURED",
                F.concat(F.lit("Measurement "), F.col("measurement_id"), F.lit(" was processed under condition "), condition, F.lit(".")),
            ),
            record(
                "ANALYSIS", "ML_MODEL", run, "MEASURED",
                F.format_string("ML analysis classified measurement %s as %s (%s) using %s.", "measurement_id", "predicted_class", "analysis_status", "model_id"),
            ),
            F.when(
                F.col("candidates") > 0,
                record(
                    "DIAGNOSIS", "AGENT", run, "INFERRED",
                    F.format_string(
                        "Agent produced %d inferred diagnosis candidate(s): %s. These are not confirmed equipment facts.",
                        "candidates",
                        F.array_join(F.array_repeat(F.lit("bearing_condition_anomaly"), F.col("candidates").cast("int")), ", "),
                    ),
                ),
            ),
            F.when(
                F.col("plan_steps") > 0,
                record("INSPECTION", "AGENT", run, "INFERRED", F.format_string("Agent generated %d inspection step(s).", "plan_steps")),
            ),
            F.when(
                F.col("actions") > 0,
                record("ACTION", "AGENT", run, "INFERRED", F.format_string("Agent generated %d decision-support action recommendation(s).", "actions")),
            ),
            record("OUTCOME", "SYSTEM", run, "CONFIRMED", F.lit("Diagnostic workflow completed and a final report was generated.")),
        )
    )
    seen = F.transform(
        "images", lambda i: record("INSPECTION", "VISION_MODEL", i, "OBSERVED", F.concat(F.lit("Inspection image "), i, F.lit(" was observed.")))
    )
    told = F.transform(
        "observations",
        lambda o, i: record(
            "HUMAN_OBSERVATION", "HUMAN", F.concat_ws(":", run, i.cast("string")), "OBSERVED",
            F.concat(F.lit("Human observation recorded for "), o, F.lit(".")),
        ),
    )
    done = runs.filter((F.col("workflow_status") == "COMPLETED") & F.col("analysis_status").isNotNull())
    rows = done.select("equipment_id", "run_id", "condition", "event_time", F.inline_outer(F.concat(single, seen, told)))
    return rows.withColumn("memory_id", memory_id(F.col("equipment_id"), F.col("memory_type"), F.col("source_id")))


def maintenance_records(maintenance: DataFrame) -> DataFrame:
    kind = F.lit("MAINTENANCE")
    return maintenance.select(
        memory_id(F.col("equipment_id"), kind, F.col("maintenance_id")).alias("memory_id"),
        "equipment_id",
        kind.alias("memory_type"),
        F.lit("MAINTENANCE_RECORD").alias("source_type"),
        F.col("maintenance_id").alias("source_id"),
        F.lit("CONFIRMED").alias("status"),
        F.concat(F.lit("Explicit maintenance record: "), F.col("maintenance_type"), F.lit(" — "), F.col("description")).alias("summary"),
        F.col("performed_at").alias("event_time"),
    )


def recent(df: DataFrame, keys: Sequence[str], limit: int, order: Sequence[Column]) -> DataFrame:
    """Newest ``limit`` rows per key; the rank filter also runs before the shuffle."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_r") <= limit).drop("_r")


def newest_first() -> list[Column]:
    return [F.desc("event_time"), F.desc("source_id")]


def context(memory: DataFrame, wanted: DataFrame) -> DataFrame:
    """History shown to a run: per type the newest rows, same condition first where there are any.

    ``wanted``: equipment_id, wanted_condition. Only the newest hundred records of an equipment
    count; unresolved items ignore the condition.
    """
    head = recent(memory, ["equipment_id"], HISTORY_LIMIT, newest_first()).join(wanted, "equipment_id")
    match = F.coalesce(F.col("condition") == F.col("wanted_condition"), F.lit(False))
    typed = head.filter(F.col("memory_type").isin(*CONTEXT_TYPES)).withColumn("_m", match)
    any_match = F.max("_m").over(Window.partitionBy("equipment_id", "memory_type"))
    chosen = typed.withColumn("_any", any_match).filter(~F.col("_any") | F.col("_m")).drop("_any", "_m")
    shown = recent(chosen, ["equipment_id", "memory_type"], RECENT_LIMIT, newest_first()).withColumn("section", F.col("memory_type"))
    open_items = head.filter(F.col("memory_type").isin(*UNRESOLVED_TYPES) & (F.col("status") == "INFERRED"))
    unresolved = recent(open_items, ["equipment_id"], RECENT_LIMIT, newest_first()).withColumn("section", F.lit("UNRESOLVED"))
    return shown.unionByName(unresolved)


def used_ids(selected: DataFrame) -> DataFrame:
    """Distinct records per equipment that a context used (at most twenty-five)."""
    return selected.groupBy("equipment_id").agg(F.count_distinct("source_id", "memory_type").alias("memory_used"))


def history(memory: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Analysis points of the newest records, for ascending display."""
    head = recent(memory, ["equipment_id"], limit, newest_first())
    return head.filter(F.col("memory_type") == "ANALYSIS").select(
        "equipment_id", "source_id", "event_time", "condition", "analysis_status", "feature_rms"
    )


def trend(points: DataFrame) -> DataFrame:
    return points.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("analysis_status") == "abnormal").alias("abnormal_count")
    )


def memory_count(memory: DataFrame) -> DataFrame:
    return memory.groupBy("equipment_id").agg(F.count(F.lit(1)).alias("records"))


def delete_equipment(memory: DataFrame, removed: DataFrame) -> DataFrame:
    return memory.join(removed.select("equipment_id"), "equipment_id", "left_anti")
