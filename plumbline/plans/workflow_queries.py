"""Queries over runs, evidence, memory and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import audits, events as ev, memory as mem, queries as qb, retrieval as rt, workflow as wf
from plumbline.plans import views
from plumbline.plans.registry import query, with_views
from plumbline.plans.views import EVIDENCE_SQL, MEMORY_SQL, RUN_EVENTS_SQL, RUNS_SQL
from plumbline.session import cut_lineage

UNION_SQL = """ev AS (SELECT *, 'evidence_' || substr(sha256(run_id || ':' || purpose || ':' || chunk_id), 1, 20) AS evidence_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY query_ordinal, score DESC, tie) AS r FROM evidence) WHERE r = 1)"""

STATE_SQL = """abnormal AS (SELECT *, 'analysis_' || substr(run_id, 5) AS analysis_id FROM runs WHERE analysis_status = 'abnormal'),
digest AS (
  SELECT run_id, count(*) AS evidence_count, bool_or(purpose = 'DIAGNOSTIC_EVIDENCE') AS has_d, bool_or(purpose = 'INSPECTION_ACTION') AS has_i, bool_or(contradicts) AS contradicted
  FROM ev GROUP BY 1),
firsts AS (SELECT run_id, max(evidence_id) FILTER (purpose = 'DIAGNOSTIC_EVIDENCE' AND k = 1) AS first_d, max(evidence_id) FILTER (purpose = 'INSPECTION_ACTION' AND k = 1) AS first_i
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, purpose ORDER BY query_ordinal, score DESC, chunk_id) AS k FROM ev) GROUP BY 1),
tops AS (SELECT run_id, string_agg(evidence_id, ':' ORDER BY k) AS ids, count(*) AS supporting FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY query_ordinal, score DESC, chunk_id) AS k FROM ev) WHERE k <= 8 GROUP BY 1),
state AS (
  SELECT a.*, coalesce(evidence_count, 0) AS evidence_count, coalesce(has_d, FALSE) AS has_d, coalesce(has_i, FALSE) AS has_i, supporting, first_d, first_i,
    CASE WHEN evidence_count > 0 THEN 'candidate_' || substr(sha256(analysis_id || ':' || ids), 1, 16) END AS candidate_id,
    CASE WHEN evidence_count IS NULL THEN 'INSUFFICIENT' WHEN contradicted THEN 'CONFLICTING' WHEN NOT (has_d AND has_i) THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS evidence_status
  FROM abnormal a LEFT JOIN digest USING (run_id) LEFT JOIN firsts USING (run_id) LEFT JOIN tops USING (run_id)),
routed AS (SELECT *, CASE WHEN evidence_status = 'SUFFICIENT' THEN 'sufficient' WHEN evidence_status = 'INSUFFICIENT' OR retries >= 2
    THEN CASE WHEN information_rounds >= 2 THEN 'limited_report' ELSE 'additional_information' END
    WHEN evidence_status = 'PARTIAL' THEN 'refine' ELSE 'counter_evidence' END AS route,
  CASE evidence_status WHEN 'INSUFFICIENT' THEN 'diagnostic and inspection technical evidence'
    WHEN 'PARTIAL' THEN CASE WHEN has_d THEN 'inspection evidence' WHEN has_i THEN 'diagnostic evidence' ELSE 'diagnostic evidence; inspection evidence' END ELSE '' END AS missing FROM state)"""

PLANNED_SQL = f"""SELECT run_id, CAST(1 AS BIGINT) AS ordinal, 'DIAGNOSTIC_EVIDENCE' AS purpose, '{qb.DIAGNOSTIC_PHRASE} analysis status abnormal predicted class damaged signal feature rms '
    || format('{{:.6g}}', rms) || ' operating condition ' || condition AS query_text FROM runs WHERE analysis_status = 'abnormal'
UNION ALL SELECT run_id, 2, 'INSPECTION_ACTION', '{qb.INSPECTION_PHRASE} analysis status abnormal predicted class damaged operating condition ' || condition FROM runs WHERE analysis_status = 'abnormal'
UNION ALL SELECT run_id, 3, 'DIAGNOSTIC_EVIDENCE', 'human observation inspection_observation ' || equipment_id FROM runs WHERE analysis_status = 'abnormal' AND information_rounds > 0
UNION ALL SELECT run_id, 4, 'INSPECTION_ACTION', 'visible exterior observation rust ' || condition FROM runs WHERE analysis_status = 'abnormal' AND retries = 0"""

R = with_views(RUNS_SQL)
X = with_views(RUNS_SQL, EVIDENCE_SQL, UNION_SQL, STATE_SQL)


def evidence_table(spark, sf_dir):
    rows = rt.union_evidence(views.evidence(spark, sf_dir))
    return rows.withColumn("evidence_id", tx.short_hash("evidence_", F.col("run_id"), F.col("purpose"), F.col("chunk_id")))


def run_states(spark, sf_dir):
    two, one = F.lit(2).cast("bigint"), F.lit(1).cast("bigint")
    return views.runs(spark, sf_dir).withColumns(
        {
            "analysis_id": F.concat(F.lit("analysis_"), F.substr("run_id", F.lit(5))),
            "signal_features": F.create_map(F.lit("rms"), F.col("rms")),
            "max_retries": two,
            "max_information_rounds": two,
            "max_revision_rounds": one,
            "revisions": F.lit(0).cast("bigint"),
        }
    )


def abnormal_runs(spark, sf_dir):
    return run_states(spark, sf_dir).filter(wf.route_verdict(F.col("analysis_status")) == "abnormal")


def observed_runs(spark, sf_dir):
    """Abnormal runs with the human observations and visible findings that their queries may name."""
    none = F.array().cast("array<struct<type:string,value:string>>")
    seen = F.array(F.struct(F.lit("inspection_observation").alias("type"), F.col("equipment_id").alias("value")))
    return abnormal_runs(spark, sf_dir).withColumns(
        {
            "observations": F.when(F.col("information_rounds") > 0, seen).otherwise(none),
            "visible_terms": F.when(F.col("retries") == 0, F.array(F.lit("rust"), F.col("condition"))).otherwise(F.array().cast("array<string>")),
        }
    )


def routed(spark, sf_dir):
    return wf.WorkflowStages().run(abnormal_runs(spark, sf_dir), evidence_table(spark, sf_dir))


@query(
    "initialised_runs",
    R
    + """SELECT run_id, coalesce(req.equipment_id, runs.equipment_id) AS equipment_id,
  CASE WHEN req.equipment_id <> runs.equipment_id THEN 'FAILED' ELSE 'RUNNING' END AS workflow_status,
  CASE WHEN req.equipment_id <> runs.equipment_id THEN 'TARGET_MISMATCH' END AS error_code, CAST(2 AS BIGINT) AS max_retries
FROM runs JOIN (SELECT 'run_' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN 'rig-' || (o_custkey + o_orderkey % 2) END AS equipment_id FROM orders) req USING (run_id)""",
)
def initialised_runs(spark, sf_dir):
    known = views.runs(spark, sf_dir).select("measurement_id", "equipment_id")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    requests = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("m:"), key.cast("string")).alias("measurement_id"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("rig-"), (cust + key % 2).cast("string"))).alias("equipment_id"),
    )
    return wf.init_runs(requests, known).select("run_id", "equipment_id", "workflow_status", "error_code", "max_retries")


@query(
    "target_mismatches",
    "SELECT 'run_' || o_orderkey AS run_id, 'rig-' || o_custkey AS owner FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 1",
)
def target_mismatches(spark, sf_dir):
    known = views.runs(spark, sf_dir).select("measurement_id", "equipment_id")
    key = F.col("o_orderkey")
    requests = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("m:"), key.cast("string")).alias("measurement_id"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("rig-"), (F.col("o_custkey") + key % 2).cast("string"))).alias("equipment_id"),
    )
    return wf.check_targets(requests, known).select("run_id", "owner")


@query("verdict_routes", R + "SELECT CASE analysis_status WHEN 'normal' THEN 'normal' ELSE 'abnormal' END AS route, workflow_status, CAST(count(*) AS BIGINT) AS runs FROM runs GROUP BY 1, 2")
def verdict_routes(spark, sf_dir):
    rows = views.runs(spark, sf_dir)
    return rows.groupBy(wf.route_verdict(F.col("analysis_status")).alias("route"), "workflow_status").agg(F.count(F.lit(1)).alias("runs"))


@query("planned_queries", R + PLANNED_SQL)
def planned_queries(spark, sf_dir):
    return wf.plan_queries(observed_runs(spark, sf_dir))


@query(
    "diagnosed_runs",
    X
    + """SELECT run_id, candidate_id, CAST(evidence_count AS BIGINT) AS evidence_count, evidence_status, route, missing,
  CAST(CASE WHEN candidate_id IS NULL THEN 0 ELSE (first_d IS NOT NULL)::INT + (first_i IS NOT NULL)::INT END AS BIGINT) AS plan_steps,
  CASE WHEN candidate_id IS NOT NULL AND (first_d IS NOT NULL OR first_i IS NOT NULL) THEN 'action_' || substr(sha256(concat_ws(':', first_d, first_i)), 1, 16) END AS action_id FROM routed""",
)
def diagnosed_runs(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "run_id",
        "candidate_id",
        F.col("evidence_count").cast("bigint").alias("evidence_count"),
        "evidence_status",
        "route",
        F.array_join("missing", "; ").alias("missing"),
        F.size("plan").cast("bigint").alias("plan_steps"),
        "action_id",
    )


@query("evidence_routes", X + "SELECT evidence_status, route, CAST(count(*) AS BIGINT) AS runs FROM routed GROUP BY 1, 2")
def evidence_routes(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("evidence_status", "route").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "refinement_queries",
    X
    + f"""SELECT run_id, retries + 3 AS ordinal, CASE WHEN route = 'refine' AND contains(missing, 'inspection') THEN 'INSPECTION_ACTION' ELSE 'DIAGNOSTIC_EVIDENCE' END AS purpose,
  CASE WHEN route = 'refine' THEN 'bearing technical evidence needed to address ' || replace(missing, '; ', ', ') || ' workflow refinement ' || (retries + 1) ELSE '{qb.COUNTER_PHRASE}' END AS query_text
FROM routed WHERE route IN ('refine', 'counter_evidence')""",
)
def refinement_queries(spark, sf_dir):
    return wf.refinement_queries(routed(spark, sf_dir))


@query(
    "inspection_steps",
    X
    + """SELECT run_id, 'INS-' || lpad(CAST(o AS VARCHAR), 3, '0') AS step_id, topic, evidence_id FROM (
  SELECT run_id, topic, evidence_id, row_number() OVER (PARTITION BY run_id ORDER BY n) AS o FROM (
    SELECT run_id, 1 AS n, 'condition' AS topic, first_d AS evidence_id FROM routed WHERE first_d IS NOT NULL
    UNION ALL SELECT run_id, 2, 'indicators', first_i FROM routed WHERE first_i IS NOT NULL))""",
)
def inspection_steps(spark, sf_dir):
    return routed(spark, sf_dir).select("run_id", F.inline_outer("plan")).filter(F.col("step_id").isNotNull()).select("run_id", "step_id", "topic", "evidence_id")


ACTIONS_SQL = """acts AS (SELECT 'run_' || o_orderkey AS run_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'SHUTDOWN_CHECK' WHEN '2-HIGH' THEN 'SCHEDULE_MAINTENANCE' WHEN '3-MEDIUM' THEN 'AUTOMATIC_CONTROL' ELSE 'INSPECT' END AS action_type,
    CASE WHEN o_totalprice > 400000 THEN 'high' ELSE 'medium' END AS priority, o_orderstatus AS s, o_orderkey % 5 AS k FROM orders),
judged AS (SELECT *, action_type IN ('SHUTDOWN_CHECK', 'SCHEDULE_MAINTENANCE') OR priority = 'high' AS important,
  CASE WHEN action_type = 'AUTOMATIC_CONTROL' THEN 'ACTION_NOT_ALLOWED' WHEN s = 'P' AND k = 0 THEN 'UNKNOWN_EVIDENCE' WHEN k = 1 THEN 'AUTOMATIC_CONTROL'
    WHEN (action_type IN ('SHUTDOWN_CHECK', 'SCHEDULE_MAINTENANCE') OR priority = 'high') AND s = 'O' THEN 'MISSING_EVIDENCE' END AS violation FROM acts)"""


def judged_actions(spark, sf_dir):
    priority, status, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 5
    none = F.array().cast("array<string>")
    acts = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.when(priority == "1-URGENT", "SHUTDOWN_CHECK")
        .when(priority == "2-HIGH", "SCHEDULE_MAINTENANCE")
        .when(priority == "3-MEDIUM", "AUTOMATIC_CONTROL")
        .otherwise("INSPECT")
        .alias("action_type"),
        F.when(F.col("o_totalprice") > 400000, "high").otherwise("medium").alias("priority"),
        F.when(k == 1, "Please bypass interlock now").otherwise("Inspect the rig").alias("summary"),
        F.lit("Evidence supports it").alias("reason"),
        F.when(status == "O", none).when((status == "P") & (k == 0), F.array(F.lit("e9"))).otherwise(F.array(F.lit("e1"))).alias("supporting_ids"),
        F.array(F.lit("e1"), F.lit("e2")).alias("known_ids"),
        F.array(F.lit("note"), F.lit("note")).alias("limitations"),
    )
    return wf.apply_policy(acts)


@query(
    "action_policy",
    with_views(ACTIONS_SQL)
    + """SELECT run_id, violation, CASE WHEN violation IS NULL THEN important END AS requires_human_approval,
  CAST(CASE WHEN action_type = 'SHUTDOWN_CHECK' THEN 2 ELSE 1 END AS BIGINT) AS limitations FROM judged""",
)
def action_policy(spark, sf_dir):
    return judged_actions(spark, sf_dir).select("run_id", "violation", "requires_human_approval", F.size("limitations").cast("bigint").alias("limitations"))


REQUESTS_SQL = """approvals AS (SELECT r.*, coalesce(j.violation IS NULL AND j.important, FALSE) AS approval FROM routed r LEFT JOIN judged j USING (run_id)),
requests AS (
  SELECT run_id, CASE WHEN approval THEN 'APPROVAL' ELSE 'ADDITIONAL_INFORMATION' END AS request_type, missing,
    'request_' || substr(sha256(run_id || CASE WHEN approval THEN ':APPROVAL:act_' || run_id || ':0' ELSE ':ADDITIONAL_INFORMATION:' || (information_rounds + 1) END), 1, 20) AS request_id,
    approval, information_rounds FROM approvals WHERE approval OR route = 'additional_information')"""


def waiting_requests(spark, sf_dir):
    judged = judged_actions(spark, sf_dir).select("run_id", F.coalesce("requires_human_approval", F.lit(False)).alias("requires_human_approval"))
    state = routed(spark, sf_dir).drop("action_id").join(judged, "run_id").withColumn("action_id", F.concat(F.lit("act_"), F.col("run_id")))
    return wf.human_requests(state)


REQ = with_views(RUNS_SQL, EVIDENCE_SQL, UNION_SQL, STATE_SQL, ACTIONS_SQL, REQUESTS_SQL)


@query(
    "human_requests",
    REQ
    + """SELECT run_id, request_type, request_id, CAST(CASE WHEN approval THEN 0 ELSE 2 END AS BIGINT) AS requested_fields,
  CASE WHEN missing = '' THEN 'Additional evidence context is required.' ELSE missing END AS reason FROM requests""",
)
def human_requests(spark, sf_dir):
    return waiting_requests(spark, sf_dir).withColumn("requested_fields", F.size("requested_fields").cast("bigint"))


RESPONSES_SQL = """answered AS (
  SELECT run_id, request_type, CAST(substr(run_id, 5) AS BIGINT) % 4 AS d, CAST(substr(run_id, 5) AS BIGINT) % 3 AS e FROM requests),
answer1 AS (SELECT *, CASE WHEN d < 3 THEN ['APPROVED', 'REJECTED', 'NEEDS_REVISION'][d + 1] ELSE 'MAYBE' END AS decision,
  CASE WHEN d = 3 AND e = 2 THEN 'REQUEST_MISMATCH' WHEN request_type = 'APPROVAL' AND d = 3 THEN 'INVALID_DECISION'
  WHEN request_type <> 'APPROVAL' AND e = 0 THEN 'MISSING_FIELDS' END AS rejection FROM answered),
verdicts AS (SELECT run_id, request_type, decision, rejection FROM answer1
  UNION ALL SELECT run_id, request_type, CASE WHEN d = 3 THEN 'APPROVED' ELSE decision END,
    CASE WHEN d = 3 AND rejection IS NOT NULL THEN NULL ELSE coalesce(rejection, 'ALREADY_RESOLVED') END FROM answer1)"""


def validated(spark, sf_dir):
    """Two answers to each request; where the first is a MAYBE, the second is in order. The requests are stored once."""
    requests = cut_lineage(waiting_requests(spark, sf_dir)).withColumn("workflow_status", F.lit("WAITING"))
    number = F.substr("run_id", F.lit(5)).cast("bigint")
    d, e = number % 4, number % 3
    twice = requests.select("run_id", "request_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("received_order"))
    better = (d == 3) & (F.col("received_order") == 2)
    decision = F.when(d == 0, "APPROVED").when(d == 1, "REJECTED").when(d == 2, "NEEDS_REVISION").when(better, "APPROVED").otherwise("MAYBE")
    observed = F.when((e == 0) & ~better, "").otherwise("seen")
    body = F.create_map(F.lit("decision"), decision, F.lit("inspection_observation"), observed, F.lit("operating_condition_confirmation"), F.lit("yes"))
    responses = twice.select(
        "run_id",
        F.when((d == 3) & (e == 2) & ~better, F.lit("request_wrong")).otherwise(F.col("request_id")).alias("request_id"),
        body.alias("response"),
        "received_order",
    )
    return wf.validate_responses(requests, responses)


V = with_views(RUNS_SQL, EVIDENCE_SQL, UNION_SQL, STATE_SQL, ACTIONS_SQL, REQUESTS_SQL, RESPONSES_SQL)


@query(
    "response_checks",
    V
    + "SELECT coalesce(rejection, 'ACCEPTED') AS rejection, count(*) AS n FROM verdicts GROUP BY 1",
)
def response_checks(spark, sf_dir):
    return validated(spark, sf_dir).groupBy(F.coalesce("rejection", F.lit("ACCEPTED")).alias("rejection")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "resumed_runs",
    V
    + """SELECT run_id, r.information_rounds + (request_type = 'ADDITIONAL_INFORMATION' AND v.run_id IS NOT NULL)::INT AS information_rounds,
  CASE WHEN v.run_id IS NULL THEN NULL WHEN request_type = 'ADDITIONAL_INFORMATION' THEN 'update_context' WHEN decision = 'NEEDS_REVISION' THEN 'revise' ELSE 'report' END AS next_step
FROM abnormal r LEFT JOIN (SELECT * FROM verdicts WHERE rejection IS NULL) v USING (run_id)""".replace(
        "r.information_rounds + (request_type = 'ADDITIONAL_INFORMATION' AND v.run_id IS NOT NULL)::INT",
        "r.information_rounds + coalesce((request_type = 'ADDITIONAL_INFORMATION')::BIGINT, 0)",
    ),
)
def resumed_runs(spark, sf_dir):
    accepted = validated(spark, sf_dir).filter(F.col("rejection").isNull())
    return wf.apply_responses(abnormal_runs(spark, sf_dir), accepted).select("run_id", "information_rounds", "next_step")


@query(
    "human_observations",
    V
    + """SELECT run_id, type, CASE type WHEN 'inspection_observation' THEN 'seen' ELSE 'yes' END AS value
FROM verdicts, (VALUES ('inspection_observation'), ('operating_condition_confirmation')) f(type) WHERE rejection IS NULL AND request_type = 'ADDITIONAL_INFORMATION'""",
)
def human_observations(spark, sf_dir):
    accepted = validated(spark, sf_dir).filter(F.col("rejection").isNull())
    return wf.observation_rows(accepted).select("run_id", "type", "value")


@query(
    "final_reports",
    X
    + """, allruns AS (SELECT runs.*, s.evidence_status, CASE workflow_status WHEN 'FAILED' THEN 'REJECTED' WHEN 'RUNNING' THEN 'NEEDS_REVISION' END AS last_decision FROM runs LEFT JOIN (SELECT run_id, evidence_status FROM routed) s USING (run_id)),
c AS (SELECT run_id, count(*) AS n FROM ev GROUP BY 1)
SELECT run_id, CASE analysis_status WHEN 'normal' THEN 'normal_report' ELSE 'diagnostic_report' END AS report_type,
  CAST(CASE analysis_status WHEN 'normal' THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS citation_count,
  CASE analysis_status WHEN 'normal' THEN 'normal' ELSE concat_ws(',', 'confidence', 'control', CASE WHEN evidence_status IS DISTINCT FROM 'SUFFICIENT' THEN 'evidence' END,
    CASE WHEN information_rounds > 0 THEN 'human' END, CASE WHEN information_rounds > 0 AND last_decision = 'REJECTED' THEN 'rejected' END,
    CASE WHEN information_rounds > 0 AND last_decision = 'NEEDS_REVISION' THEN 'revision' END) END AS limitations
FROM allruns LEFT JOIN c USING (run_id)""",
)
def final_reports(spark, sf_dir):
    status = F.col("workflow_status")
    state = routed(spark, sf_dir).select("run_id", "evidence_status")
    rows = run_states(spark, sf_dir).join(state, "run_id", "left").withColumns(
        {
            "interactions": F.col("information_rounds"),
            "last_decision": F.when(status == "FAILED", "REJECTED").when(status == "RUNNING", "NEEDS_REVISION"),
        }
    )
    out = wf.reports(rows, evidence_table(spark, sf_dir))
    return out.select("run_id", "report_type", "citation_count", F.array_join("limitations", ",").alias("limitations"))


@query(
    "stage_events",
    R
    + """SELECT run_id, CAST(10 + i AS BIGINT) AS sequence, event_type, 'event_' || substr(sha256(run_id || ':retrieve_knowledge:' || event_type || ':' || retries || ':' || information_rounds || ':0:0'), 1, 20) AS event_id
FROM runs, (VALUES (1, 'node_started'), (2, 'node_completed'), (3, 'retrieval_completed')) e(i, event_type)""",
)
def stage_events(spark, sf_dir):
    rows = run_states(spark, sf_dir).withColumns({"event_offset": F.lit(10).cast("bigint"), "interactions": F.lit(0)})
    out = wf.emit_events(rows, "retrieve_knowledge", "RAG_AGENT", "Technical evidence retrieved.", ["retrieval_completed"])
    return out.select("run_id", F.col("sequence").cast("bigint").alias("sequence"), "event_type", "event_id")


@query(
    "unknown_references",
    with_views(EVIDENCE_SQL, UNION_SQL)
    + """SELECT run_id, chunk_id FROM ev WHERE source_tier = 4""",
)
def unknown_references(spark, sf_dir):
    table = evidence_table(spark, sf_dir)
    known = table.filter(F.col("source_tier") < 4)
    return wf.unknown_references(table, known).select("run_id", "chunk_id")


@query(
    "citation_trace",
    with_views(EVIDENCE_SQL, UNION_SQL)
    + """SELECT run_id, CAST(count(*) AS BIGINT) AS citations, CAST(count(kept) AS BIGINT) AS with_evidence, CAST(count(s_suppkey) AS BIGINT) AS with_source, bool_and(s_suppkey IS NOT NULL) AS traced
FROM (SELECT *, CASE WHEN score >= 0.2 THEN document_id END AS kept FROM ev) e
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) s ON e.kept = 'doc_' || s_suppkey GROUP BY 1""",
)
def citation_trace(spark, sf_dir):
    """Weak evidence was not kept, so its citations lead nowhere."""
    table = evidence_table(spark, sf_dir).withColumn("source_id", F.col("document_id"))
    listed = views.table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0)
    sources = listed.select(F.concat(F.lit("doc_"), F.col("s_suppkey").cast("string")).alias("source_id"))
    return wf.trace_citations(table.select("run_id", "evidence_id"), table.filter(F.col("score") >= 0.2), sources)


def listed_runs(spark, sf_dir):
    """Run rows as a service stores them: JSON analysis, open request, final report."""
    return views.runs(spark, sf_dir).select(
        "*",
        F.to_json(F.struct(F.col("analysis_status").alias("status"), "predicted_class", "confidence")).alias("analysis_json"),
        F.when(F.col("workflow_status") == "WAITING", F.concat(F.lit("request_"), F.col("run_id"))).alias("pending_request_id"),
        F.when(F.col("workflow_status") == "COMPLETED", F.lit("{}")).alias("final_report_json"),
    )


@query(
    "hitl_statuses",
    R
    + """SELECT run_id, CASE WHEN workflow_status = 'WAITING' THEN 'PENDING' WHEN EXISTS (SELECT 1 FROM lineitem l WHERE 'run_' || l.l_orderkey = runs.run_id AND l_returnflag = 'R') THEN 'RESOLVED' ELSE 'NONE' END AS hitl_status FROM runs""",
)
def hitl_statuses(spark, sf_dir):
    resolved = views.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.concat(F.lit("run_"), F.col("l_orderkey").cast("string")).alias("run_id"))
    return wf.hitl_status(listed_runs(spark, sf_dir), resolved).select("run_id", "hitl_status")


@query(
    "run_search",
    R + "SELECT run_id, equipment_id, analysis_status AS ml_prediction, round(confidence, 6) AS ml_confidence, workflow_status = 'COMPLETED' AS final_report_available FROM runs WHERE workflow_status = 'COMPLETED' AND contains(lower(equipment_id), 'ig-1') AND analysis_status = 'abnormal'",
)
def run_search(spark, sf_dir):
    found = wf.filter_runs(listed_runs(spark, sf_dir), workflow_status="COMPLETED", equipment_id="IG-1", ml_prediction="abnormal")
    return wf.run_summary(found).select("run_id", "equipment_id", "ml_prediction", F.round("ml_confidence", 6).alias("ml_confidence"), "final_report_available")


@query("run_page", R + "SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20 OFFSET 40")
def run_page(spark, sf_dir):
    """The third page of twenty runs, newest first."""
    rows, _ = wf.page(views.runs(spark, sf_dir), 3, 20, [F.desc("created_at"), F.desc("run_id")])
    return rows.select("run_id", "created_at")


@query(
    "run_page_after",
    R
    + """SELECT run_id, created_at FROM runs WHERE (created_at, run_id) < (SELECT (created_at, run_id) FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 1 OFFSET 39)
ORDER BY created_at DESC, run_id DESC LIMIT 20""",
)
def run_page_after(spark, sf_dir):
    """The third page again, found from the last row of the second."""
    runs, order = views.runs(spark, sf_dir), ["created_at", "run_id"]
    last = wf.page_after(runs, 40, order).orderBy(*order).select(*order).first()  # one row
    return wf.page_after(runs, 20, order, tuple(last) if last else None).select("run_id", "created_at")


@query("run_page_totals", R + "SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM runs")
def run_page_totals(spark, sf_dir):
    return wf.page(views.runs(spark, sf_dir), 1, 20, [F.desc("created_at")])[1]


@query(
    "run_views",
    with_views(RUNS_SQL, RUN_EVENTS_SQL)
    + """SELECT run_id, workflow_status, node AS current_node, last_sequence, CASE WHEN workflow_status = 'WAITING' THEN 'request_' || run_id END AS request_id
FROM runs LEFT JOIN (SELECT run_id, max(sequence) AS last_sequence, arg_max(node, sequence) AS node FROM run_events GROUP BY 1) USING (run_id)""",
)
def run_views(spark, sf_dir):
    states = ev.run_state(views.run_events(spark, sf_dir)).select("run_id", "current_node", "last_sequence")
    listed = listed_runs(spark, sf_dir)
    pending = listed.filter(F.col("pending_request_id").isNotNull()).select("run_id", F.col("pending_request_id").alias("request_id"))
    return wf.run_view(listed.drop("pending_request_id"), states, pending).select("run_id", "workflow_status", "current_node", "last_sequence", "request_id")


@query(
    "serving_contexts",
    R + "SELECT run_id AS analysis_id, measurement_id, coalesce('B' || NULLIF(substr(measurement_id, 3, 1), '0'), 'unknown') AS bearing_id, condition FROM runs",
)
def serving_contexts(spark, sf_dir):
    rows = views.runs(spark, sf_dir)
    digit = F.substring("measurement_id", 3, 1)
    meta = rows.filter(digit != "0").select("measurement_id", F.concat(F.lit("B"), digit).alias("bearing_id"), "condition", F.lit("damaged").alias("state"))
    analysis = rows.select(
        F.col("run_id").alias("analysis_id"), "measurement_id", F.col("analysis_status").alias("status"), "predicted_class", "confidence",
        F.lit("unknown").alias("bearing_id"), "condition",
    )
    return wf.serving_context(analysis, meta).select("analysis_id", "measurement_id", "bearing_id", "condition")


@query(
    "serving_leaks",
    R
    + """SELECT condition, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (leaks) AS BIGINT) AS leaking_rows, NOT bool_or(leaks) AS passed
FROM (SELECT condition, condition = 'C1' AND CAST(substr(run_id, 5) AS BIGINT) % 7 = 0 AS leaks FROM runs) GROUP BY 1""",
)
def serving_leaks(spark, sf_dir):
    """Per condition; a note of some runs under C1 carries the answer along."""
    leaks = (F.col("condition") == "C1") & (F.substr("analysis_id", F.lit(5)).cast("bigint") % 7 == 0)
    noted = serving_contexts(spark, sf_dir).withColumn("note", F.when(leaks, "see Ground_Truth sheet").otherwise("none"))
    return audits.leak_audit(noted, by=["condition"])


# -- memory ---------------------------------------------------------------------------------------

M = with_views(MEMORY_SQL)


@query(
    "memory_records",
    R
    + """, done AS (SELECT *, CASE WHEN analysis_status = 'abnormal' THEN 1 ELSE 0 END AS c FROM runs WHERE workflow_status = 'COMPLETED')
, recs AS (
SELECT run_id, equipment_id, 'MEASUREMENT' AS memory_type, run_id AS source_id, 'Measurement ' || measurement_id || ' was processed under condition ' || condition || '.' AS summary FROM done
UNION ALL SELECT run_id, equipment_id, 'ANALYSIS', run_id, 'ML analysis classified measurement ' || measurement_id || ' as ' || predicted_class || ' (' || analysis_status || ') using forest.' FROM done
UNION ALL SELECT run_id, equipment_id, 'DIAGNOSIS', run_id, 'Agent produced 1 inferred diagnosis candidate(s): bearing_condition_anomaly. These are not confirmed equipment facts.' FROM done WHERE c = 1
UNION ALL SELECT run_id, equipment_id, 'INSPECTION', run_id, 'Agent generated 2 inspection step(s).' FROM done WHERE c = 1
UNION ALL SELECT run_id, equipment_id, 'ACTION', run_id, 'Agent generated 1 decision-support action recommendation(s).' FROM done WHERE c = 1
UNION ALL SELECT run_id, equipment_id, 'OUTCOME', run_id, 'Diagnostic workflow completed and a final report was generated.' FROM done
UNION ALL SELECT run_id, equipment_id, 'INSPECTION', 'image_' || run_id, 'Inspection image image_' || run_id || ' was observed.' FROM done WHERE retries = 0
UNION ALL SELECT run_id, equipment_id, 'HUMAN_OBSERVATION', run_id || ':0', 'Human observation recorded for inspection_observation.' FROM done WHERE information_rounds > 0)
SELECT run_id, memory_type, source_id, summary, 'memory_' || substr(sha256(equipment_id || ':' || memory_type || ':' || source_id), 1, 20) AS memory_id FROM recs""",
)
def memory_records(spark, sf_dir):
    abnormal = F.col("analysis_status") == "abnormal"
    none = F.array().cast("array<string>")
    rows = views.runs(spark, sf_dir).withColumns(
        {
            "model_id": F.lit("forest"),
            "candidates": F.when(abnormal, 1).otherwise(0),
            "plan_steps": F.when(abnormal, 2).otherwise(0),
            "actions": F.when(abnormal, 1).otherwise(0),
            "images": F.when(F.col("retries") == 0, F.array(F.concat(F.lit("image_"), F.col("run_id")))).otherwise(none),
            "observations": F.when(F.col("information_rounds") > 0, F.array(F.lit("inspection_observation"))).otherwise(none),
            "event_time": F.col("created_at"),
        }
    )
    return mem.records_from_runs(rows).select("run_id", "memory_type", "source_id", "summary", "memory_id")


@query(
    "memory_upsert",
    M
    + """, u AS (SELECT equipment_id, memory_type, source_type, status AS source_id, feature_rms, event_time, source_id AS content FROM memory)
SELECT equipment_id, memory_type, source_id, content FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id, memory_type, source_type, source_id ORDER BY event_time DESC, content DESC) AS r FROM u) WHERE r = 1""",
)
def memory_upsert(spark, sf_dir):
    """Repeated writes to one natural key keep the newest content."""
    rows = views.memory(spark, sf_dir).select(
        "equipment_id", "memory_type", "source_type", F.col("status").alias("source_id"), F.col("source_id").alias("content"),
        F.col("event_time").alias("recorded_at"), F.col("source_id").alias("memory_id"),
    )
    old = rows.filter(F.col("recorded_at") < 900_000_000)
    new = rows.filter(F.col("recorded_at") >= 900_000_000)
    return mem.upsert(old, new).select("equipment_id", "memory_type", "source_id", "content")


CONTEXT_SQL = """head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY event_time DESC, source_id DESC) AS r FROM memory) WHERE r <= 100),
typed AS (SELECT *, condition = '1-URGENT' AS m, bool_or(condition = '1-URGENT') OVER (PARTITION BY equipment_id, memory_type) AS am FROM head WHERE memory_type IN ('MEASUREMENT', 'ANALYSIS', 'DIAGNOSIS', 'HUMAN_OBSERVATION')),
shown AS (SELECT equipment_id, memory_type AS section, source_id FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id, memory_type ORDER BY event_time DESC, source_id DESC) AS k FROM typed WHERE m OR NOT am) WHERE k <= 5
  UNION ALL SELECT equipment_id, 'UNRESOLVED', source_id FROM (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY event_time DESC, source_id DESC) AS k FROM head WHERE memory_type IN ('DIAGNOSIS', 'ACTION') AND status = 'INFERRED') WHERE k <= 5)"""


def contexts(spark, sf_dir):
    memory = views.memory(spark, sf_dir)
    wanted = memory.select("equipment_id").distinct().withColumn("wanted_condition", F.lit("1-URGENT"))
    return mem.context(memory, wanted)


@query("memory_context", with_views(MEMORY_SQL, CONTEXT_SQL) + "SELECT * FROM shown")
def memory_context(spark, sf_dir):
    return contexts(spark, sf_dir).select("equipment_id", "section", "source_id")


@query("memory_used", with_views(MEMORY_SQL, CONTEXT_SQL) + "SELECT equipment_id, CAST(count(DISTINCT source_id) AS BIGINT) AS memory_used FROM shown GROUP BY 1")
def memory_used(spark, sf_dir):
    return mem.used_ids(contexts(spark, sf_dir))


@query(
    "memory_history",
    with_views(MEMORY_SQL, CONTEXT_SQL) + "SELECT equipment_id, source_id, event_time, analysis_status, round(feature_rms, 6) AS feature_rms FROM head WHERE memory_type = 'ANALYSIS'",
)
def memory_history(spark, sf_dir):
    out = mem.history(views.memory(spark, sf_dir))
    return out.select("equipment_id", "source_id", "event_time", "analysis_status", F.round("feature_rms", 6).alias("feature_rms"))


@query(
    "memory_trend",
    with_views(MEMORY_SQL, CONTEXT_SQL)
    + "SELECT equipment_id, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER (analysis_status = 'abnormal') AS BIGINT) AS abnormal_count FROM head WHERE memory_type = 'ANALYSIS' GROUP BY 1",
)
def memory_trend(spark, sf_dir):
    return mem.trend(mem.history(views.memory(spark, sf_dir)))


@query("memory_counts", M + "SELECT equipment_id, CAST(count(*) AS BIGINT) AS records FROM memory GROUP BY 1")
def memory_counts(spark, sf_dir):
    return mem.memory_count(views.memory(spark, sf_dir))


@query(
    "maintenance_memory",
    """SELECT 'memory_' || substr(sha256('rig-' || s_nationkey || ':MAINTENANCE:maintenance_' || s_suppkey), 1, 20) AS memory_id, 'rig-' || s_nationkey AS equipment_id, 'CONFIRMED' AS status,
  'Explicit maintenance record: replace — ' || s_name AS summary FROM supplier""",
)
def maintenance_memory(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("rig-"), F.col("s_nationkey").cast("string")).alias("equipment_id"),
        F.concat(F.lit("maintenance_"), F.col("s_suppkey").cast("string")).alias("maintenance_id"),
        F.lit("replace").alias("maintenance_type"),
        F.col("s_name").alias("description"),
        F.lit(0).alias("performed_at"),
    )
    return mem.maintenance_records(rows).select("memory_id", "equipment_id", "status", "summary")


@query(
    "deleted_equipment",
    M + "SELECT equipment_id, CAST(count(*) AS BIGINT) AS records FROM memory WHERE equipment_id NOT IN (SELECT 'rig-' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
)
def deleted_equipment(spark, sf_dir):
    gone = views.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0).select(F.concat(F.lit("rig-"), F.col("c_custkey").cast("string")).alias("equipment_id"))
    return mem.memory_count(mem.delete_equipment(views.memory(spark, sf_dir), gone))


# -- events and audits -----------------------------------------------------------------------------

EV = with_views(RUN_EVENTS_SQL)


@query("numbered_events", EV + "SELECT run_id, event_id, sequence FROM run_events")
def numbered_events(spark, sf_dir):
    rows = views.run_events(spark, sf_dir).withColumn("position", F.col("sequence") * 10).drop("sequence")
    return ev.number_events(rows).select("run_id", "event_id", "sequence")


@query("idempotent_append", EV + "SELECT run_id, event_id, sequence, node FROM run_events WHERE agent_role <> 'system'")
def idempotent_append(spark, sf_dir):
    """Every event is delivered twice; events of the system role are stored already."""
    rows = views.run_events(spark, sf_dir)
    return ev.append_new(rows.filter(F.col("agent_role") == "system"), rows.unionByName(rows)).select("run_id", "event_id", "sequence", "node")


@query("merged_events", EV + "SELECT event_id, run_id, 'second' AS origin FROM run_events")
def merged_events(spark, sf_dir):
    rows = views.run_events(spark, sf_dir).select("event_id", "run_id")
    first, second = rows.withColumns({"origin": F.lit("first"), "version": F.lit(1)}), rows.withColumns({"origin": F.lit("second"), "version": F.lit(2)})
    return ev.merge_last(first.unionByName(second), "version").select("event_id", "run_id", "origin")


@query("kept_events", EV + "SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) AS r FROM run_events) WHERE r <= 500")
def kept_events(spark, sf_dir):
    return ev.keep_last(views.run_events(spark, sf_dir)).select("run_id", "event_id")


@query("cursor_read", EV + "SELECT event_id, sequence FROM run_events WHERE run_id = 'run_7' AND sequence > 1")
def cursor_read(spark, sf_dir):
    return ev.events_after(views.run_events(spark, sf_dir), "run_7", 1).select("event_id", "sequence")


@query(
    "run_states",
    EV
    + """SELECT run_id, max(sequence) AS last_sequence, arg_max(node, sequence) AS current_node, CAST(count(*) AS BIGINT) AS event_count,
  CAST(count(*) FILTER (node = 'retrieve_knowledge') AS BIGINT) AS retrievals, max((event_type = 'workflow_completed')::INT) AS completed FROM run_events GROUP BY 1""",
)
def run_state_query(spark, sf_dir):
    return ev.run_state(views.run_events(spark, sf_dir))


@query(
    "error_events",
    with_views(RUNS_SQL, RUN_EVENTS_SQL)
    + """SELECT run_id, coalesce(m, 0) + 1 AS sequence, 'event_' || substr(sha256(run_id || ':workflow_error:' || (coalesce(m, 0) + 1)), 1, 20) AS event_id
FROM runs LEFT JOIN (SELECT run_id, max(sequence) AS m FROM run_events GROUP BY 1) USING (run_id) WHERE workflow_status = 'FAILED'""",
)
def error_events(spark, sf_dir):
    return ev.error_events(views.runs(spark, sf_dir), views.run_events(spark, sf_dir)).select("run_id", "sequence", "event_id")


@query(
    "event_contract",
    EV
    + """, told AS (SELECT run_id, sequence AS position, CASE WHEN k % 11 = 0 AND sequence = 3 THEN 1 ELSE sequence END AS sequence,
  CASE WHEN k % 17 = 0 AND sequence = 2 THEN '' ELSE agent_role END AS agent_role, CASE WHEN k % 13 = 0 THEN 'node_completed' ELSE event_type END AS event_type
  FROM (SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS k FROM run_events)),
steps AS (SELECT *, lag(sequence) OVER (PARTITION BY run_id ORDER BY position) AS before FROM told)
SELECT run_id, count(*) = count(DISTINCT sequence) AS unique_sequence, bool_and(agent_role <> '') AS roles_present,
  bool_or(event_type = 'workflow_completed') AS completed_event, bool_and(coalesce(sequence >= before, TRUE)) AS ordered_sequence FROM steps GROUP BY 1""",
)
def event_contract(spark, sf_dir):
    """Some runs repeat a sequence, leave a role out or never complete."""
    rows, number = views.run_events(spark, sf_dir), F.substr("run_id", F.lit(5)).cast("bigint")
    told = rows.withColumns(
        {
            "position": F.col("sequence") - 1,
            "sequence": F.when((number % 11 == 0) & (F.col("sequence") == 3), 1).otherwise(F.col("sequence")),
            "agent_role": F.when((number % 17 == 0) & (F.col("sequence") == 2), "").otherwise(F.col("agent_role")),
            "event_type": F.when(number % 13 == 0, "node_completed").otherwise(F.col("event_type")),
        }
    )
    return ev.event_contract(told, "position")


@query(
    "route_audit",
    EV
    + """SELECT run_id, CAST(3 AS BIGINT) AS expected_nodes, CAST(3 - count(DISTINCT node) AS BIGINT) AS missing_nodes, count(DISTINCT node) = 3 AS passed FROM run_events GROUP BY 1""",
)
def route_audit(spark, sf_dir):
    rows = views.run_events(spark, sf_dir)
    nodes = F.array(*[F.lit(n) for n in ("initialize_run", "retrieve_knowledge", "diagnose")])
    return audits.route_audit(rows, rows.select("run_id").distinct().withColumn("node", F.explode(nodes)))


@query(
    "stage_timing",
    EV
    + """SELECT run_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(0 AS BIGINT) AS ml_ms, CAST(sum(CASE WHEN node = 'retrieve_knowledge' THEN duration_ms ELSE 0 END) AS BIGINT) AS rag_ms,
  CAST(sum(CASE WHEN node = 'diagnose' THEN duration_ms ELSE 0 END) AS BIGINT) AS reasoning_ms, CAST(0 AS BIGINT) AS vision_ms, CAST(0 AS BIGINT) AS memory_ms FROM run_events GROUP BY 1""",
)
def stage_timing(spark, sf_dir):
    return audits.stage_timing(views.run_events(spark, sf_dir))


@query(
    "store_counts",
    with_views(RUNS_SQL, MEMORY_SQL, RUN_EVENTS_SQL)
    + """SELECT 'run_database' AS component_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT run_id) AS BIGINT) AS distinct_keys FROM runs
UNION ALL SELECT 'long_term_memory', count(*), count(DISTINCT equipment_id) FROM memory UNION ALL SELECT 'checkpoint_store', count(*), count(DISTINCT run_id) FROM run_events""",
)
def store_counts(spark, sf_dir):
    return audits.store_counts(
        {
            "run_database": (views.runs(spark, sf_dir), "run_id"),
            "long_term_memory": (views.memory(spark, sf_dir), "equipment_id"),
            "checkpoint_store": (views.run_events(spark, sf_dir), "run_id"),
        }
    )


@query("overall_status", "SELECT CAST(0 AS BIGINT) AS critical_ready, CAST(count(DISTINCT n) AS BIGINT) AS required_ready, 'UNAVAILABLE' AS overall_status FROM (SELECT 'run_database' AS n FROM orders UNION SELECT 'checkpoint_store' FROM conversations UNION SELECT 'long_term_memory' FROM orders)")
def overall_status(spark, sf_dir):
    ready = store_counts(spark, sf_dir).withColumn("status", F.when(F.col("rows") > 0, "READY").otherwise("UNAVAILABLE"))
    return audits.overall_status(ready)


@query("release_gate", EV + "SELECT CAST(count(*) AS BIGINT) AS audits, bool_and(n = 3) AS released FROM (SELECT run_id, count(DISTINCT node) AS n FROM run_events GROUP BY 1)")
def release_gate(spark, sf_dir):
    return audits.release_gate(route_audit(spark, sf_dir))


# -- error capture, record shapes, ordered ids, page sections ---------------------------------------


@query(
    "captured_errors",
    R
    + """SELECT run_id, CASE WHEN workflow_status <> 'FAILED' AND (predicted_class IS NULL OR confidence < 0.3) THEN 'FAILED' ELSE workflow_status END AS workflow_status,
  CASE WHEN workflow_status <> 'FAILED' AND predicted_class IS NULL THEN 'ANALYSIS_ERROR' WHEN workflow_status <> 'FAILED' AND confidence < 0.3 THEN 'RETRIEVAL_ERROR' END AS error_code FROM runs""",
)
def captured_errors(spark, sf_dir):
    """Two stages fail for some runs; a run that failed keeps its first code, the others go on."""
    runs = views.runs(spark, sf_dir).withColumn("error_code", F.lit(None).cast("string"))
    first = wf.capture_errors(runs, F.col("predicted_class").isNull(), "ANALYSIS_ERROR")
    return wf.capture_errors(first, F.coalesce(F.col("confidence") < 0.3, F.lit(False)), "RETRIEVAL_ERROR").select("run_id", "workflow_status", "error_code")


@query(
    "contract_violations",
    """SELECT error, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN l_suppkey % 5 = l_partkey % 5 THEN 'SUPPORT_AND_CONTRADICT' WHEN l_linenumber = 4 THEN 'INVALID_LEVEL' WHEN l_quantity < 10 THEN 'TIME_WITHOUT_ZONE' ELSE 'OK' END AS error
  FROM lineitem) GROUP BY 1""",
)
def contract_violations(spark, sf_dir):
    number = F.col("l_linenumber")
    level = F.when(number == 4, "certain").when(number < 3, "low").when(number < 6, "medium").otherwise("high")
    time = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")

    def ids(column):
        return F.array(F.concat(F.lit("e"), (F.col(column) % 5).cast("string")))

    records = views.table(spark, sf_dir, "lineitem").select(
        ids("l_suppkey").alias("supporting_ids"),
        ids("l_partkey").alias("contradicting_ids"),
        level.alias("confidence_level"),
        F.when(F.col("l_quantity") < 10, time).otherwise(F.concat(time, F.lit("+09:00"))).alias("recorded_at"),
    )
    out = wf.contract_violations(records, "recorded_at")
    return out.groupBy(F.coalesce("contract_error", F.lit("OK")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ordered_ids",
    """SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM (
  SELECT o_orderkey, list_filter(coalesce(a, []) || b, lambda x: x IS NOT NULL) AS l FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN ['m' || o_custkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_custkey % 5 END] END AS a,
      ['m' || o_orderkey % 5, 'm' || o_custkey % 5] AS b FROM orders))""",
)
def ordered_ids(spark, sf_dir):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")

    def name(number):
        return F.concat(F.lit("m"), number.cast("string"))

    first = F.when(order % 3 > 0, F.array(name(customer % 7), F.when(order % 2 == 0, name(customer % 5))))
    second = F.array(name(order % 5), name(customer % 5))
    rows = views.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.array_join(tx.ordered_distinct(first, second), ",").alias("ids"))


@query(
    "page_sections",
    """SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'overview' WHEN p_size BETWEEN 10 AND 24 THEN 'process' WHEN p_size BETWEEN 30 AND 41 THEN 'quality' ELSE 'other' END AS section FROM part""",
)
def page_sections(spark, sf_dir):
    bounds = {(1, 9): "overview", (10, 24): "process", (30, 41): "quality"}
    return views.table(spark, sf_dir, "part").select("p_partkey", tx.page_section(F.col("p_size"), bounds, "other").alias("section"))
