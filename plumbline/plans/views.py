"""Domain views over the supplied tables, each with its SQL twin.

Every view covers its whole base table. Row numbers that a real recording would carry are
derived with the slice-wise ``ordinal`` operator, never with one window over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import ordinal
from plumbline.session import bounded_batches

SECONDS_PER_SLICE = 5 * 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give a small input with few splits one task per core before heavy per-row work.

    An input that already has a split per core, as any large table has, is left in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session time zone is."""
    column = F.col(ts) if isinstance(ts, str) else ts
    zone_less = column.cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), zone_less) / F.lit(1e6)


# -- recorded signals -------------------------------------------------------------------------

SIGNALS_SQL = """raw_signals AS (
  SELECT 'm:' || user_id AS measurement_id, 'rig-' || (user_id % 10) AS equipment_id,
         'B' || (user_id % 6) AS bearing_id, 'C' || (user_id % 4) AS condition,
         CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'damaged' END AS state,
         event_type, event_id, epoch_us(ts) / 1000000.0 AS t, value AS x
  FROM events),
signals AS (
  SELECT measurement_id, equipment_id, bearing_id, condition, state, 'vibration_1' AS channel,
         CAST(row_number() OVER (PARTITION BY measurement_id ORDER BY t, event_id) - 1 AS BIGINT) AS idx, t, x
  FROM raw_signals),
multi AS (
  SELECT measurement_id, equipment_id, bearing_id, condition, state, event_type AS channel,
         CAST(row_number() OVER (PARTITION BY measurement_id, event_type ORDER BY t, event_id) - 1 AS BIGINT) AS idx,
         t, x
  FROM raw_signals)"""


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m:"), user.cast("string")).alias("measurement_id"),
        F.concat(F.lit("rig-"), (user % 10).cast("string")).alias("equipment_id"),
        F.concat(F.lit("B"), (user % 6).cast("string")).alias("bearing_id"),
        F.concat(F.lit("C"), (user % 4).cast("string")).alias("condition"),
        F.when(user % 3 == 0, "healthy").otherwise("damaged").alias("state"),
        "event_type",
        "event_id",
        epoch_seconds("ts").alias("t"),
        F.col("value").alias("x"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sampled channel per measurement, in long form."""
    numbered = ordinal(
        raw_signals(spark, sf_dir).drop("event_type"),
        ["measurement_id"],
        F.floor(F.col("t") / SECONDS_PER_SLICE),
        ["t", "event_id"],
        "idx",
        start=0,
    )
    return numbered.withColumn("channel", F.lit("vibration_1")).drop("event_id")


def multi_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several channels per measurement, one per event type."""
    numbered = ordinal(
        raw_signals(spark, sf_dir).withColumnRenamed("event_type", "channel"),
        ["measurement_id", "channel"],
        F.floor(F.col("t") / SECONDS_PER_SLICE),
        ["t", "event_id"],
        "idx",
        start=0,
    )
    return numbered.drop("event_id")


SPECTRA_SQL = """vectors AS (
  SELECT 'm:' || label || ':' || (vec_id // 40) AS measurement_id, 'B' || label AS bearing_id,
         'C' || ((vec_id // 40) % 4) AS condition,
         CASE WHEN label < 3 THEN 'healthy' ELSE 'damaged' END AS state,
         'v' || vec_id AS window_id, CAST(64 AS DOUBLE) AS rate_hz, embedding AS samples
  FROM embeddings)"""


def window_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete windows stored as arrays: 64 samples at a nominal 64 Hz."""
    label, vec = F.col("label").cast("string"), F.col("vec_id")
    group = F.floor(vec / 40)
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("m:"), label, F.lit(":"), group.cast("string")).alias("measurement_id"),
        F.concat(F.lit("B"), label).alias("bearing_id"),
        F.concat(F.lit("C"), (group % 4).cast("string")).alias("condition"),
        F.when(F.col("label") < 3, "healthy").otherwise("damaged").alias("state"),
        F.concat(F.lit("v"), vec.cast("string")).alias("window_id"),
        F.lit(64.0).cast("double").alias("rate_hz"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


# -- labelled process rows --------------------------------------------------------------------

QUALITY_SQL = """quality AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS serial_no, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS received_at,
         l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, l_tax AS f4,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS passorfail, CAST(l_linenumber AS BIGINT) AS row_index
  FROM lineitem)"""

FEATURES = ("f1", "f2", "f3", "f4")


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("serial_no"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("received_at"),
        F.col("l_quantity").alias("f1"),
        F.col("l_extendedprice").alias("f2"),
        F.col("l_discount").alias("f3"),
        F.col("l_tax").alias("f4"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("passorfail"),
        F.col("l_linenumber").cast("bigint").alias("row_index"),
    )


# -- workflow records -------------------------------------------------------------------------

RUN_EVENTS_SQL = """run_events AS (
  SELECT 'run_' || conv_id AS run_id, turn + 1 AS sequence, 'event_' || conv_id || '_' || turn AS event_id,
         role AS agent_role, text AS message, length(text) AS duration_ms,
         CASE role WHEN 'system' THEN 'initialize_run' WHEN 'user' THEN 'retrieve_knowledge' ELSE 'diagnose' END AS node,
         CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'workflow_completed' ELSE 'node_completed' END AS event_type
  FROM conversations)"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("_end"))
    run, turn = F.col("conv_id").cast("string"), F.col("turn")
    return turns.join(ends, "conv_id").select(
        F.concat(F.lit("run_"), run).alias("run_id"),
        (turn + 1).alias("sequence"),
        F.concat(F.lit("event_"), run, F.lit("_"), turn.cast("string")).alias("event_id"),
        F.col("role").alias("agent_role"),
        F.col("text").alias("message"),
        F.length("text").cast("bigint").alias("duration_ms"),
        F.when(F.col("role") == "system", "initialize_run")
        .when(F.col("role") == "user", "retrieve_knowledge")
        .otherwise("diagnose")
        .alias("node"),
        F.when(turn == F.col("_end"), "workflow_completed").otherwise("node_completed").alias("event_type"),
    )


RUNS_SQL = """runs AS (
  SELECT 'run_' || o_orderkey AS run_id, 'rig-' || o_custkey AS equipment_id, 'm:' || o_orderkey AS measurement_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'WAITING' WHEN '2-HIGH' THEN 'FAILED' WHEN '3-MEDIUM' THEN 'RUNNING'
              ELSE 'COMPLETED' END AS workflow_status,
         CASE WHEN o_orderstatus = 'O' THEN 'normal' ELSE 'abnormal' END AS analysis_status,
         CASE WHEN o_orderstatus = 'O' THEN 'healthy' ELSE 'damaged' END AS predicted_class,
         'C' || (o_custkey % 4) AS condition, 0.5 + (o_orderkey % 50) / 100.0 AS confidence,
         floor(o_totalprice) / 1000.0 AS rms,
         CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS created_at, o_orderkey % 3 AS retries,
         o_orderkey % 4 AS information_rounds
  FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    priority = F.col("o_orderpriority")
    normal = F.col("o_orderstatus") == "O"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("rig-"), cust.cast("string")).alias("equipment_id"),
        F.concat(F.lit("m:"), key.cast("string")).alias("measurement_id"),
        F.when(priority == "1-URGENT", "WAITING")
        .when(priority == "2-HIGH", "FAILED")
        .when(priority == "3-MEDIUM", "RUNNING")
        .otherwise("COMPLETED")
        .alias("workflow_status"),
        F.when(normal, "normal").otherwise("abnormal").alias("analysis_status"),
        F.when(normal, "healthy").otherwise("damaged").alias("predicted_class"),
        F.concat(F.lit("C"), (cust % 4).cast("string")).alias("condition"),
        (F.lit(0.5).cast("double") + (key % 50) / F.lit(100.0)).alias("confidence"),
        (F.floor("o_totalprice") / F.lit(1000.0)).alias("rms"),
        F.floor(epoch_seconds("o_orderdate")).cast("bigint").alias("created_at"),
        (key % 3).alias("retries"),
        (key % 4).alias("information_rounds"),
    )


EVIDENCE_SQL = """evidence AS (
  SELECT 'run_' || l_orderkey AS run_id, 'doc_' || l_suppkey || ':c' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS chunk_id,
         'doc_' || l_suppkey AS document_id,
         CASE l_returnflag WHEN 'R' THEN 'DIAGNOSTIC_EVIDENCE' WHEN 'A' THEN 'INSPECTION_ACTION' ELSE 'DATASET_EVIDENCE' END AS purpose,
         CAST(l_linenumber AS BIGINT) AS query_ordinal, l_discount * 10 AS score, CAST(1 + l_suppkey % 4 AS BIGINT) AS source_tier,
         CASE WHEN l_tax >= 0.08 THEN TRUE ELSE FALSE END AS contradicts, l_extendedprice AS tie
  FROM lineitem)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows found for the runs, before the per-run union."""
    flag = F.col("l_returnflag")
    doc = F.concat(F.lit("doc_"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run_"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.concat(doc, F.lit(":c"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("chunk_id"),
        doc.alias("document_id"),
        F.when(flag == "R", "DIAGNOSTIC_EVIDENCE")
        .when(flag == "A", "INSPECTION_ACTION")
        .otherwise("DATASET_EVIDENCE")
        .alias("purpose"),
        F.col("l_linenumber").cast("bigint").alias("query_ordinal"),
        (F.col("l_discount") * 10).alias("score"),
        (1 + F.col("l_suppkey") % 4).cast("bigint").alias("source_tier"),
        (F.col("l_tax") >= 0.08).alias("contradicts"),
        F.col("l_extendedprice").alias("tie"),
    )


MEMORY_SQL = """memory AS (
  SELECT 'rig-' || o_custkey AS equipment_id,
         CASE o_orderstatus WHEN 'O' THEN 'ANALYSIS' WHEN 'F' THEN 'DIAGNOSIS' ELSE 'ACTION' END AS memory_type,
         'AGENT' AS source_type, 'run_' || o_orderkey AS source_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'INFERRED' ELSE 'MEASURED' END AS status,
         o_orderpriority AS condition, CASE WHEN o_totalprice > 250000 THEN 'abnormal' ELSE 'normal' END AS analysis_status,
         o_totalprice AS feature_rms, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS event_time
  FROM orders)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("rig-"), F.col("o_custkey").cast("string")).alias("equipment_id"),
        F.when(status == "O", "ANALYSIS").when(status == "F", "DIAGNOSIS").otherwise("ACTION").alias("memory_type"),
        F.lit("AGENT").alias("source_type"),
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("source_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "INFERRED").otherwise("MEASURED").alias("status"),
        F.col("o_orderpriority").alias("condition"),
        F.when(F.col("o_totalprice") > 250000, "abnormal").otherwise("normal").alias("analysis_status"),
        F.col("o_totalprice").alias("feature_rms"),
        F.floor(epoch_seconds("o_orderdate")).cast("bigint").alias("event_time"),
    )
