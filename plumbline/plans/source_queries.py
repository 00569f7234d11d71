"""Queries over sources: measurement index, manifests, inventories, pages, images and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import images as im
from plumbline.functions.html import html_blocks
from plumbline.operators import chunks as ch
from plumbline.plans import views
from plumbline.plans.registry import query, with_views
from plumbline.plans.text_queries import CHUNKS_SQL, DOCS_SQL, PAGES_SQL, document_chunks
from plumbline.plans.views import RUN_EVENTS_SQL, RUNS_SQL, SIGNALS_SQL
from plumbline.session import shared_folder
from plumbline.sources import documents as docs, images as imgs, measurements as ms
from plumbline.streaming import jobs, windows

FILES_SQL = """files AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_nationkey % 5 = 4 THEN 'notes_' || s_suppkey || '.txt' ELSE
  CASE s_suppkey % 3 WHEN 0 THEN 'N09' ELSE 'N15' END || '_M07_F' || CASE s_suppkey % 2 WHEN 0 THEN '10' ELSE '04' END || '_' ||
  CASE s_nationkey % 4 WHEN 0 THEN 'K001' WHEN 1 THEN 'KA01' WHEN 2 THEN 'KI01' ELSE 'K' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') END || '_' || s_suppkey || '.mat' END AS name FROM supplier),
idx AS (SELECT regexp_extract(name, '^(N\\d+_M\\d+_F\\d+)_', 1) AS condition, regexp_extract(name, '_(K[A-Z]?\\d+)_', 1) AS bearing_id, s_suppkey AS run, 'raw/' || name AS source_reference FROM files WHERE name LIKE '%.mat'),
idx2 AS (SELECT *, 'rig:' || bearing_id || ':' || condition || ':' || CASE WHEN run < 100 THEN lpad(CAST(run AS VARCHAR), 2, '0') ELSE CAST(run AS VARCHAR) END AS measurement_id FROM idx)"""


def files(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    bearing = (
        F.when(nation % 4 == 0, "K001").when(nation % 4 == 1, "KA01").when(nation % 4 == 2, "KI01")
        .otherwise(F.concat(F.lit("K"), F.lpad(nation.cast("string"), 3, "0")))
    )
    name = F.when(nation % 5 == 4, F.concat(F.lit("notes_"), key.cast("string"), F.lit(".txt"))).otherwise(
        F.concat(
            F.when(key % 3 == 0, "N09").otherwise("N15"), F.lit("_M07_F"), F.when(key % 2 == 0, "10").otherwise("04"),
            F.lit("_"), bearing, F.lit("_"), key.cast("string"), F.lit(".mat"),
        )
    )
    return views.table(spark, sf_dir, "supplier").select("*", name.alias("name"), F.concat(F.lit("/data/raw/"), name).alias("path"))


@query(
    "measurement_index",
    with_views(FILES_SQL)
    + """SELECT measurement_id, source_reference, CASE bearing_id WHEN 'K001' THEN 'healthy' WHEN 'KA01' THEN 'damaged' WHEN 'KI01' THEN 'damaged' ELSE 'unknown' END AS state,
  CASE bearing_id WHEN 'KA01' THEN 'outer_ring_raceway' WHEN 'KI01' THEN 'inner_ring_raceway' END AS damage_location,
  CASE condition WHEN 'N15_M07_F10' THEN 1500 WHEN 'N09_M07_F10' THEN 900 WHEN 'N15_M07_F04' THEN 1500 END AS rpm, CASE WHEN condition IN ('N15_M07_F10', 'N09_M07_F10', 'N15_M07_F04') THEN 0.7::DOUBLE END AS load_torque_nm FROM idx2""",
)
def measurement_index(spark, sf_dir):
    found = ms.enrich(ms.index_measurements(files(spark, sf_dir).select("path"), "rig", "/data/"))
    return found.select("measurement_id", "source_reference", "state", "damage_location", "rpm", "load_torque_nm")


@query("file_types", with_views(FILES_SQL) + "SELECT CASE WHEN name LIKE '%.mat' THEN '.mat' ELSE '.txt' END AS extension, CAST(count(*) AS BIGINT) AS files FROM files GROUP BY 1")
def file_types(spark, sf_dir):
    return ms.inspection_summary(files(spark, sf_dir))


@query("measurement_lookup", with_views(FILES_SQL) + "SELECT measurement_id, source_reference FROM idx2 WHERE bearing_id = 'K001'")
def measurement_lookup(spark, sf_dir):
    found = ms.index_measurements(files(spark, sf_dir).select("path"), "rig", "/data/")
    return ms.by_id(found, "bearing_id", "K001").select("measurement_id", "source_reference")


RAW_SQL = """faulty AS (SELECT measurement_id, channel, idx, CASE WHEN x > 300 THEN 'NaN' WHEN x < 0.02 THEN 'bad' WHEN x BETWEEN 250 AND 260 THEN NULL ELSE 'ok' END AS f FROM multi),
chan AS (SELECT measurement_id, channel, count(*) AS n, bool_or(f = 'NaN') AS nf, bool_or(f = 'bad') AS bad, bool_or(f IS NULL) AS nul FROM faulty GROUP BY 1, 2)"""


def raw_rows(spark, sf_dir):
    rows, x = views.multi_signals(spark, sf_dir), F.col("x")
    return rows.select(
        "measurement_id", "channel", F.lit("HostService").alias("raster"), F.lit(1).alias("axis_index"), F.lit(2).alias("axis_count"), "idx",
        F.col("t").cast("string").alias("t"),
        F.when(x > 300, "NaN").when(x < 0.02, "bad").when(x.between(250, 260), F.lit(None)).otherwise(x.cast("string")).alias("x"),
    )


@query(
    "signal_normalisation",
    with_views(SIGNALS_SQL, RAW_SQL)
    + """SELECT measurement_id, channel, CAST(n AS BIGINT) AS sample_count,
  concat_ws(',', CASE WHEN nul THEN 'LENGTH_MISMATCH' END, CASE WHEN bad THEN 'NON_NUMERIC_SIGNAL' END, CASE WHEN nf THEN 'NON_FINITE_SIGNAL' END) AS errors FROM chan""",
)
def signal_normalisation(spark, sf_dir):
    good, bad = ms.normalise_signals(raw_rows(spark, sf_dir))
    both = good.withColumn("errors", F.lit("")).unionByName(bad.withColumn("errors", F.array_join("errors", ",")))
    return both.select("measurement_id", "channel", "sample_count", "errors")


@query(
    "dataset_validation",
    with_views(SIGNALS_SQL, RAW_SQL)
    + """, good AS (SELECT * FROM chan WHERE NOT (nf OR bad OR nul)), m AS (SELECT DISTINCT measurement_id, condition, state FROM raw_signals)
SELECT 'state' AS facet, state AS value, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS shortest, CAST(NULL AS BIGINT) AS longest FROM m GROUP BY 2
UNION ALL SELECT 'condition', condition, count(*), NULL, NULL FROM m GROUP BY 2
UNION ALL SELECT 'channel', channel, count(*), min(n), max(n) FROM good GROUP BY 2
UNION ALL SELECT 'status', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(DISTINCT measurement_id), NULL, NULL FROM chan WHERE nf OR bad OR nul""",
)
def dataset_validation(spark, sf_dir):
    good, bad = ms.normalise_signals(raw_rows(spark, sf_dir))
    known = views.raw_signals(spark, sf_dir).select("measurement_id", "condition", "state").distinct()
    return ms.validate_dataset(known, good, bad)


@query(
    "sample_blocks",
    with_views(SIGNALS_SQL)
    + """SELECT measurement_id, idx // 16 AS block, CAST(count(*) AS BIGINT) AS n, round(arg_min(x, idx), 6) AS first_x, round(arg_max(x, idx), 6) AS last_x FROM signals GROUP BY 1, 2""",
)
def sample_blocks(spark, sf_dir):
    out = ms.sample_blocks(views.signals(spark, sf_dir), 16)
    return out.select(
        "measurement_id", "block", F.size("values").cast("bigint").alias("n"),
        F.round(F.element_at("values", 1), 6).alias("first_x"), F.round(F.element_at("values", -1), 6).alias("last_x"),
    )


@query(
    "measurement_headers",
    """SELECT 'm:' || event_id AS measurement_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS measurement_id_in_file,
  event_type AS recorded_at_raw, round(value, 6) AS measurement_duration_sec FROM events""",
)
def measurement_headers(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    header = F.to_json(
        F.struct(
            F.struct(F.get_json_object("props", "$.k").alias("MeasurementID")).alias("Info"),
            F.struct(
                F.struct(F.col("event_type").alias("DateTime")).alias("General"), F.struct(F.col("value").alias("Length")).alias("Measurement")
            ).alias("Description"),
        )
    )
    raw = events.select(F.concat(F.lit("m:"), F.col("event_id").cast("string")).alias("measurement_id"), header.alias("header"))
    return ms.measurement_meta(raw).withColumn("measurement_duration_sec", F.round("measurement_duration_sec", 6))


# -- manifests, checksums, inventory -----------------------------------------------------------

MANIFEST_SQL = """man AS (SELECT 'SRC_' || s_suppkey AS source_id, 'docs/' || s_suppkey AS local_path, ['pdf', 'html', 'rar_collection', 'pdf_collection', 'csv'][s_nationkey % 5 + 1] AS file_type,
  sha256(s_name) AS sha, s_acctbal FROM supplier),
members AS (SELECT DISTINCT 'docs/' || l_suppkey AS collection, 'docs/' || l_suppkey || '/K' || l_partkey || '/sheet.pdf' AS path, sha256('part' || l_partkey) AS sha FROM lineitem),
digests AS (SELECT collection, sha256(string_agg(path || chr(0) || sha || chr(10), '' ORDER BY path)) AS collection_sha256, CAST(count(*) AS BIGINT) AS files FROM members GROUP BY 1)"""


def manifest(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    kinds = F.array(*[F.lit(k) for k in ("pdf", "html", "rar_collection", "pdf_collection", "csv")])
    return views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SRC_"), key).alias("source_id"),
        F.col("s_name").alias("title"),
        F.concat(F.lit("docs/"), key).alias("local_path"),
        F.get(kinds, (F.col("s_nationkey") % 5).cast("int")).alias("file_type"),
        F.sha2("s_name", 256).alias("sha256"),
        "s_acctbal",
    )


def members(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    folder = F.concat(F.lit("docs/"), F.col("l_suppkey").cast("string"))
    part = F.col("l_partkey").cast("string")
    return rows.select(
        folder.alias("collection"),
        F.concat(folder, F.lit("/K"), part, F.lit("/sheet.pdf")).alias("path"),
        F.sha2(F.concat(F.lit("part"), part), 256).alias("sha256"),
    )


@query("collection_digests", with_views(MANIFEST_SQL) + "SELECT * FROM digests")
def collection_digests(spark, sf_dir):
    return docs.collection_digests(members(spark, sf_dir))


def statuses(spark, sf_dir):
    """Manifest with the right digest for rich suppliers' collections, over the files present."""
    listed = manifest(spark, sf_dir)
    singles = listed.filter(F.col("s_acctbal") >= 0).select(
        F.lit(None).cast("string").alias("collection"),
        F.col("local_path").alias("path"),
        F.when(F.col("s_acctbal") < 6000, F.col("sha256")).otherwise(F.lit("changed")).alias("sha256"),
    )
    known = docs.collection_digests(members(spark, sf_dir)).select(F.col("collection").alias("local_path"), F.col("collection_sha256").alias("_d"))
    declared = listed.join(known, "local_path", "left").withColumn(
        "sha256",
        F.when((F.col("file_type") == "pdf_collection") & (F.col("s_acctbal") >= 4000), F.coalesce("_d", "sha256")).otherwise(F.col("sha256")),
    ).drop("_d")
    present = singles.unionByName(members(spark, sf_dir))
    return docs.source_statuses(declared, present), present


STATUS_SQL = """stat AS (SELECT source_id, local_path, file_type, CASE WHEN file_type IN ('rar_collection', 'csv') THEN 'UNSUPPORTED'
    WHEN file_type IN ('pdf', 'html') THEN CASE WHEN s_acctbal < 0 THEN 'MISSING' WHEN s_acctbal >= 6000 THEN 'INVALID' ELSE 'READY' END
    WHEN files IS NULL THEN 'MISSING' WHEN s_acctbal >= 4000 THEN 'READY' ELSE 'INVALID' END AS status, files
  FROM man LEFT JOIN digests ON local_path = collection)"""


@query(
    "manifest_statuses",
    with_views(MANIFEST_SQL, STATUS_SQL)
    + "SELECT source_id, status, CAST(CASE WHEN status <> 'READY' THEN 0 WHEN file_type = 'pdf_collection' THEN files ELSE 1 END AS BIGINT) AS document_count FROM stat",
)
def manifest_statuses(spark, sf_dir):
    return statuses(spark, sf_dir)[0].select("source_id", "status", "document_count")


@query(
    "expanded_documents",
    with_views(MANIFEST_SQL, STATUS_SQL)
    + """SELECT lower(source_id) || coalesce('_k' || regexp_extract(path, '/K(\\d+)/', 1), '') AS document_id, source_id, coalesce(path, local_path) AS local_path
FROM stat LEFT JOIN members ON local_path = collection AND file_type = 'pdf_collection' WHERE status = 'READY'""",
)
def expanded_documents(spark, sf_dir):
    rows, present = statuses(spark, sf_dir)
    expanded = docs.expand_documents(rows, present).select("document_id", "source_id", "local_path")
    return docs.unique_documents(expanded)


@query(
    "acquisition_inventory",
    """SELECT CAST(count(*) AS BIGINT) AS expected_count, CAST(count(*) FILTER (s_acctbal >= 0) AS BIGINT) AS present_count, CAST(count(*) FILTER (s_acctbal >= 0 AND s_nationkey % 2 = 1) AS BIGINT) AS bad_signatures,
  CAST(sum(s_suppkey * 10) FILTER (s_acctbal >= 0) AS BIGINT) AS total_size, count(*) FILTER (s_acctbal >= 0) < count(*) AS partial FROM supplier""",
)
def acquisition_inventory(spark, sf_dir):
    suppliers = views.table(spark, sf_dir, "supplier")
    present = suppliers.filter(F.col("s_acctbal") >= 0).select(
        F.col("s_name").alias("name"), (F.col("s_suppkey") * 10).alias("size"), F.when(F.col("s_nationkey") % 2 == 0, "Rar!\u001a").otherwise("<html>").alias("head")
    )
    return docs.inventory(suppliers.select(F.col("s_name").alias("name")), present, "Rar!")


@query(
    "stale_documents",
    with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL)
    + """SELECT document_id, bool_or(document_type = 'de' OR source_tier = 4 OR tokens < 60) AS stale FROM chunks GROUP BY 1""",
)
def stale_documents(spark, sf_dir):
    """Stored table: no German documents, changed checksums in tier 4, no short chunks."""
    chunks = document_chunks(spark, sf_dir).select("document_id", "chunk_id", "document_type", "source_tier", "tokens", F.md5("content").alias("sha256"), F.lit("v1").alias("embedding_version"))
    stored = chunks.filter((F.col("document_type") != "de") & (F.col("tokens") >= 60)).withColumn(
        "sha256", F.when(F.col("source_tier") == 4, "old").otherwise(F.col("sha256"))
    )
    return docs.stale_documents(chunks, stored)


@query(
    "chunk_upsert",
    with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL) + "SELECT chunk_id, CASE WHEN source_tier = 1 THEN 'new' ELSE 'old' END AS version FROM chunks",
)
def chunk_upsert(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).select("chunk_id", "source_tier")
    old = chunks.withColumn("version", F.lit("old"))
    new = chunks.filter(F.col("source_tier") == 1).withColumn("version", F.lit("new"))
    return docs.upsert_chunks(old, new).select("chunk_id", "version")


@query(
    "chunk_table_life",
    with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL)
    + """SELECT chunk_id, document_id, CASE WHEN source_tier = 1 THEN 'new' ELSE 'old' END AS version FROM chunks WHERE CAST(substr(document_id, 5) AS BIGINT) % 7 <> 0""",
)
def chunk_table_life(spark, sf_dir):
    """The table is written, stale documents are replaced, others deleted, and it is read back."""
    path = f"{shared_folder(spark)}/chunks/{uuid.uuid4().hex}"
    chunks = document_chunks(spark, sf_dir).select("document_id", "chunk_id", "source_tier", F.md5("content").alias("sha256"))
    docs.write_chunks(chunks.withColumns({"version": F.lit("old"), "embedding_version": F.lit("1")}), path, buckets=16)
    fresh = F.when(F.col("source_tier") == 1, "2").otherwise("1")
    offered = chunks.withColumns({"version": F.lit("new"), "embedding_version": fresh})
    stale = docs.stale_documents(offered, spark.read.parquet(path)).filter("stale").select("document_id")
    docs.write_chunks(docs.merge_chunks(offered.join(stale, "document_id"), path), path)
    number = F.substr("document_id", F.lit(5)).cast("bigint")
    docs.delete_chunks(spark.read.parquet(path).filter(number % 7 == 0).select("document_id").distinct(), path)
    return spark.read.parquet(path).select("chunk_id", "document_id", "version")


# -- pages and images -----------------------------------------------------------------------------


@query("html_blocks")
def html_block_rows(spark, sf_dir):
    pages = views.spread(views.table(spark, sf_dir, "pages"))
    rows = pages.select("page_id", F.posexplode_outer(html_blocks("html")).alias("i", "b"))
    return rows.filter("b IS NOT NULL").select("page_id", F.col("i").cast("bigint").alias("block"), "b.section", "b.text", "b.element")


@query("html_chunks")
def html_chunks(spark, sf_dir):
    """Chunks of web pages: neighbouring blocks under one heading are joined first."""
    pages = views.spread(views.table(spark, sf_dir, "pages")).select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("document_id"), "html")
    blocks = F.transform(
        html_blocks("html"), lambda b: F.struct(F.lit(None).cast("int").alias("page"), b["section"].alias("section"), b["text"].alias("text"))
    )
    found = pages.withColumn("_blocks", blocks).drop("html")
    return ch.chunk_documents(found, F.col("_blocks")).select("chunk_id", "document_id", "chunk_index", "section", "tokens")


GRAY_SQL = "px AS (SELECT vec_id, greatest(0, least(255, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 0.5) * 255) AS BIGINT))) AS v FROM embeddings)"


def gray_images(spark, sf_dir):
    """Each vector as an eight by eight gray image."""
    byte = F.transform(
        "embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255))).cast("bigint")), 2, "0")
    )
    side = F.lit(8)
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("image_"), F.col("vec_id").cast("string")).alias("image_id"),
        side.alias("height"), side.alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data"),
    )


@query("image_metrics", f"WITH {GRAY_SQL} SELECT vec_id, round(avg(v), 6) AS brightness, round(stddev_pop(v), 6) AS contrast FROM px GROUP BY 1")
def image_metric_rows(spark, sf_dir):
    out = imgs.with_metrics(gray_images(spark, sf_dir))
    return out.select("vec_id", F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))


@query("image_observations")
def image_observations(spark, sf_dir):
    measured = imgs.with_metrics(gray_images(spark, sf_dir))
    done = measured.filter(F.col("brightness") > 150).select("image_id")
    out = imgs.observe(measured, done)
    return out.select("image_id", "quality", F.array_join("limitations", ",").alias("limitations"), "observation_id")


@query(
    "image_quality_rules",
    """SELECT p_partkey, concat_ws(',', CASE WHEN b < 28 THEN 'dark' END, CASE WHEN b > 238 THEN 'overexposed' END, CASE WHEN c < 7 OR e < 8 THEN 'blur_or_low_contrast' END, CASE WHEN s < 160 THEN 'low_resolution' END) AS limitations
FROM (SELECT p_partkey, p_size * 5.0 AS b, p_partkey % 40 AS c, p_partkey % 90 AS e, 100 + p_partkey % 200 AS s FROM part)""",
)
def image_quality_rules(spark, sf_dir):
    key = F.col("p_partkey")
    limits = im.quality_limits(F.col("p_size") * 5.0, key % 40, key % 90, 100 + key % 200)
    return views.table(spark, sf_dir, "part").select("p_partkey", F.array_join(limits, ",").alias("limitations"))


@query(
    "image_attachments",
    """SELECT 'image_' || o_orderkey AS image_id, CASE WHEN o_totalprice < 50000 THEN 'NOT_FOUND' WHEN o_orderstatus = 'F' THEN 'OTHER_EQUIPMENT' WHEN o_orderkey % 3 = 2 THEN 'OWNED_BY_OTHER_RUN' END AS rejection FROM orders""",
)
def image_attachments(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    image, run = F.concat(F.lit("image_"), key), F.concat(F.lit("run_"), key)
    stored = orders.filter(F.col("o_totalprice") >= 50000).select(
        image.alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "rig-x").otherwise("rig-1").alias("equipment_id"),
        F.when(F.col("o_orderkey") % 3 == 1, run).when(F.col("o_orderkey") % 3 == 2, "run_x").alias("run_id"),
    )
    asked = orders.select(run.alias("run_id"), F.lit("rig-1").alias("equipment_id"), image.alias("image_id"))
    return imgs.attach(asked, stored).select("image_id", "rejection")


# -- streams ---------------------------------------------------------------------------------------


def event_stream(spark, sf_dir):
    return run_event_columns(jobs.read_stream(spark, sf_dir, "conversations"))


def run_event_columns(turns):
    run, turn = F.col("conv_id").cast("string"), F.col("turn")
    return turns.select(
        F.concat(F.lit("run_"), run).alias("run_id"),
        (turn + 1).alias("sequence"),
        F.concat(F.lit("event_"), run, F.lit("_"), turn.cast("string")).alias("event_id"),
        F.when(F.col("role") == "system", "initialize_run").when(F.col("role") == "user", "retrieve_knowledge").otherwise("diagnose").alias("node"),
        F.when(turn >= 3, "workflow_completed").otherwise("node_completed").alias("event_type"),
        F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 60 + turn).alias("at"),
    )


@query("stream_append", with_views(RUN_EVENTS_SQL) + "SELECT event_id, run_id, sequence, node FROM run_events")
def stream_append(spark, sf_dir):
    """Every event arrives twice and is kept once."""
    stream = event_stream(spark, sf_dir)
    once = jobs.append_events(stream.union(stream), jobs.work_folder(spark))
    return once.select("event_id", "run_id", "sequence", "node")


@query(
    "stream_run_states",
    with_views(RUN_EVENTS_SQL)
    + """SELECT run_id, max(sequence) AS last_sequence, arg_max(node, sequence) AS current_node, CAST(count(*) AS BIGINT) AS event_count,
  CAST(count(*) FILTER (node = 'retrieve_knowledge') AS BIGINT) AS retrievals, max((sequence >= 4)::INT) AS completed FROM run_events GROUP BY 1""",
)
def stream_run_states(spark, sf_dir):
    """Every event arrives twice, in two batches, and counts once."""
    folder, turns = jobs.work_folder(spark), views.table(spark, sf_dir, "conversations")
    stream = windows.replay(iter([turns, turns]), f"{folder}/deliveries", files=2)
    return jobs.materialise_states(run_event_columns(stream), folder)


@query(
    "stream_memory",
    with_views(RUNS_SQL)
    + """SELECT run_id, memory_type FROM runs, (VALUES ('MEASUREMENT'), ('ANALYSIS'), ('OUTCOME')) m(memory_type) WHERE workflow_status = 'COMPLETED'""",
)
def stream_memory(spark, sf_dir):
    orders = jobs.read_stream(spark, sf_dir, "orders")
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    zero, none = F.lit(0), F.array().cast("array<string>")
    runs = orders.select(
        F.concat(F.lit("run_"), key).alias("run_id"),
        F.concat(F.lit("rig-"), F.col("o_custkey").cast("string")).alias("equipment_id"),
        F.concat(F.lit("m:"), key).alias("measurement_id"),
        F.when(priority.isin("4-NOT SPECIFIED", "5-LOW"), "COMPLETED").otherwise("RUNNING").alias("workflow_status"),
        F.lit("normal").alias("analysis_status"), F.lit("healthy").alias("predicted_class"), F.lit("C1").alias("condition"),
        F.lit("forest").alias("model_id"), zero.alias("candidates"), zero.alias("plan_steps"), zero.alias("actions"),
        none.alias("images"), none.alias("observations"), F.lit(0).alias("event_time"),
    )
    return jobs.memory_sink(runs, jobs.work_folder(spark)).select("run_id", "memory_type")


@query(
    "stream_wait_resume",
    """SELECT 'run_' || o_orderkey AS run_id, outcome FROM orders, (VALUES (1, 'WAITING'), (2, 'RESUMED'), (3, 'ALREADY_RESOLVED')) m(i, outcome) WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'run_' || o_orderkey, outcome FROM orders, (VALUES (1, 'WAITING'), (2, 'REQUEST_MISMATCH'), (3, 'REQUEST_MISMATCH')) m(i, outcome) WHERE o_orderstatus = 'P'""",
)
def stream_wait_resume(spark, sf_dir):
    """One request and two answers per run; answers of P orders name another request."""
    orders = jobs.read_stream(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    right, wrong = F.concat(F.lit("request_"), key), F.lit("request_other")
    answer = F.when(F.col("o_orderstatus") == "P", wrong).otherwise(right)

    def message(kind, request, position):
        return F.struct(F.lit(kind).alias("kind"), request.alias("request_id"), F.lit(position).alias("position"))

    messages = orders.select(
        F.concat(F.lit("run_"), key).alias("run_id"),
        F.inline(F.array(message("request", right, 1), message("response", answer, 2), message("response", answer, 3))),
    )
    return jobs.outcomes(messages, jobs.work_folder(spark)).select("run_id", "outcome")


# -- recordings replayed as streams ------------------------------------------------------------------

DAY = 86_400
BURST = 6 * 3600
RECORDED_SQL = """recorded AS (
  SELECT 'rig-' || (user_id % 10) AS equipment_id, 'm:' || user_id AS measurement_id, event_type AS channel, epoch_us(ts) AS us, value AS x FROM events)"""
FEATURES_SQL = """CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak,
  round(max(x) - min(x), 6) AS peak_to_peak, round(CASE WHEN max(x) = min(x) THEN 0 WHEN count(x) > 2 THEN skewness(x) ELSE 0 END, 6) AS skewness"""


def recorded_stream(spark, sf_dir, folder):
    """Events delivered in slices of five days, each up to one slice late, as small files, with an end mark."""
    at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    user = F.col("user_id")
    rows = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("rig-"), (user % 10).cast("string")).alias("equipment_id"),
        F.concat(F.lit("m:"), user.cast("string")).alias("measurement_id"),
        F.col("event_type").alias("channel"),
        "event_id",
        at.alias("at"),
        F.col("value").alias("x"),
    )
    return windows.replay(windows.deliveries(rows, "at", 5 * DAY, 1, "event_id"), f"{folder}/deliveries", files=4, end="at")


def feature_rows(found):
    at = F.unix_seconds("window.start").alias("window_start")
    columns = [F.round(c, 6).alias(c) for c in ("mean", "rms", "peak", "peak_to_peak")]
    skewness = F.round(F.when(F.col("n") > 2, F.col("skewness")).otherwise(0.0), 6).alias("skewness")
    return found.select("equipment_id", "channel", at, "n", *columns, skewness)


@query(
    "stream_features",
    with_views(RECORDED_SQL)
    + f"SELECT equipment_id, channel, us // {DAY * 1_000_000} * {DAY} AS window_start, {FEATURES_SQL} FROM recorded GROUP BY 1, 2, 3",
)
def stream_features(spark, sf_dir):
    """Tumbling windows of a day over a replayed recording."""
    folder = jobs.work_folder(spark)
    stream = recorded_stream(spark, sf_dir, folder)
    return feature_rows(windows.stream_window_features(stream, folder, "features", "at", "x", ["equipment_id", "channel"], "10 days", "1 day"))


@query(
    "stream_sliding_features",
    with_views(RECORDED_SQL)
    + f"""SELECT equipment_id, channel, (us // {DAY * 1_000_000} - back) * {DAY} AS window_start, {FEATURES_SQL}
FROM recorded, (VALUES (0), (1), (2)) b(back) GROUP BY 1, 2, 3""",
)
def stream_sliding_features(spark, sf_dir):
    """Windows of three days that start every day."""
    folder = jobs.work_folder(spark)
    stream = recorded_stream(spark, sf_dir, folder)
    return feature_rows(windows.stream_window_features(stream, folder, "sliding", "at", "x", ["equipment_id", "channel"], "10 days", "3 days", "1 day"))


@query(
    "stream_sessions",
    with_views(RECORDED_SQL)
    + f""", marked AS (SELECT *, us - lag(us) OVER w >= {BURST * 1_000_000} AS apart FROM recorded WINDOW w AS (PARTITION BY measurement_id ORDER BY us)),
numbered AS (SELECT *, sum(coalesce(apart, TRUE)::INT) OVER (PARTITION BY measurement_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT measurement_id, min(us) AS first_us, max(us) AS last_us, CAST(count(*) AS BIGINT) AS n, round(sum(x), 6) AS total FROM numbered GROUP BY measurement_id, session""",
)
def stream_sessions(spark, sf_dir):
    """Bursts of a measurement's events, at most six hours between neighbours, the last ones included."""
    folder = jobs.work_folder(spark)
    stream = recorded_stream(spark, sf_dir, folder)
    found = windows.stream_sessions(stream, folder, "sessions", "at", "x", ["measurement_id"], "10 days", "6 hours")
    return found.select(
        "measurement_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n", F.round("total", 6).alias("total")
    )
