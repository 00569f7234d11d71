"""Audits over workflow tables: routes, leaks, timings, store health and the release gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stages of the timing report, label terms and component sets.
STAGE_NODES = {
    "ml_ms": ("run_detection",),
    "rag_ms": ("retrieve_knowledge", "build_rag_query", "refine_query"),
    "reasoning_ms": ("diagnose", "verify_evidence"),
    "vision_ms": ("analyze_inspection_image", "merge_visual_context"),
    "memory_ms": ("load_equipment_memory",),
}
LABEL_TERMS = ("ground_truth", "damage_location", "fact_sheet_answer")
CRITICAL = ("backend_api", "ml_model")
REQUIRED = (
    "backend_api",
    "ml_model",
    "dataset",
    "knowledge_base",
    "vector_db",
    "workflow_graph",
    "checkpoint_store",
    "run_database",
    "long_term_memory",
)


def route_audit(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected nodes per run (run_id, node) that never completed, as a per-run verdict."""
    done = events.select("run_id", "node").distinct().withColumn("_d", F.lit(1))
    return expected.join(done, ["run_id", "node"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("expected_nodes"),
        F.count_if(F.col("_d").isNull()).alias("missing_nodes"),
        F.every(F.col("_d").isNotNull()).alias("passed"),
    )


def leak_audit(df: DataFrame, terms: Sequence[str] = LABEL_TERMS, by: Sequence[str] = ()) -> DataFrame:
    """Rows, per group if asked, whose serialised columns mention a label term in a name or a value."""
    body = F.lower(F.to_json(F.struct("*")))
    leaks = reduce(lambda a, b: a | b, [body.contains(t) for t in terms])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(leaks).alias("leaking_rows"), (~F.some(leaks)).alias("passed"))


def stage_timing(timings: DataFrame, stages: Mapping[str, Sequence[str]] = STAGE_NODES) -> DataFrame:
    node = F.col("node")
    return timings.groupBy("run_id").agg(
        F.round(F.sum("duration_ms"), 3).alias("total_ms"),
        *[F.round(F.sum(F.when(node.isin(*nodes), F.col("duration_ms")).otherwise(0)), 3).alias(stage) for stage, nodes in stages.items()],
    )


def store_counts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and distinct keys per table, as one frame."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys")).select(F.lit(name).alias("component_id"), "rows", "distinct_keys")
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def overall_status(components: DataFrame, critical: Sequence[str] = CRITICAL, required: Sequence[str] = REQUIRED) -> DataFrame:
    """UNAVAILABLE without every critical component, DEGRADED without every required one."""
    ready = F.col("status") == "READY"
    names = F.col("component_id")
    return components.agg(
        F.count_distinct(F.when(ready & names.isin(*critical), names)).alias("critical_ready"),
        F.count_distinct(F.when(ready & names.isin(*required), names)).alias("required_ready"),
    ).withColumn(
        "overall_status",
        F.when(F.col("critical_ready") < len(critical), "UNAVAILABLE").when(F.col("required_ready") < len(required), "DEGRADED").otherwise("READY"),
    )


def release_gate(audits: DataFrame) -> DataFrame:
    return audits.agg(F.count(F.lit(1)).alias("audits"), F.every("passed").alias("released"))
