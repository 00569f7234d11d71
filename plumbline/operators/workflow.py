"""Diagnosis workflow as set-based stages over a table of runs.

Every stage takes and returns DataFrames. Per-run lists are bounded by construction (eight
supporting ids, two plan steps); everything else per run is a mergeable aggregate, so a run with
very many evidence rows is no special case.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import queries as qb, retrieval as rt
from plumbline.operators.ordered import SALTS
from plumbline.session import stored

# Purposes, limits, action policy and texts of the workflow.
DIAGNOSTIC = "DIAGNOSTIC_EVIDENCE"
INSPECTION = "INSPECTION_ACTION"
MAX_RETRIEVAL_RETRIES = 2
MAX_INFORMATION_ROUNDS = 2
MAX_REVISION_ROUNDS = 1
SUPPORTING_LIMIT = 8
OBSERVATION_LIMIT = 8
VISIBLE_LIMIT = 4
RESPONSE_SALTS = 16
POPULAR_SHARE = 256  # a query text is popular if more than one in so many rows asks it
MAX_RESPONSE_CHARS = 10_000
ALLOWED_ACTIONS = ("MONITOR", "INSPECT", "SCHEDULE_MAINTENANCE", "EXPERT_REVIEW", "SHUTDOWN_CHECK")
IMPORTANT_ACTIONS = ("SHUTDOWN_CHECK", "SCHEDULE_MAINTENANCE")
PROHIBITED_PHRASES = (
    "automatically shut down",
    "direct plc",
    "bypass interlock",
    "automatically execute maintenance",
)
DECISIONS = ("APPROVED", "REJECTED", "NEEDS_REVISION")
SHUTDOWN_NOTE = "SHUTDOWN_CHECK requests operator/expert review and is not a shutdown command."
REPORT_LIMITATIONS = {
    "confidence": "ML confidence is not a calibrated equipment-failure probability.",
    "control": "Recommendations support human decisions and do not control equipment.",
    "evidence": "The available technical evidence remains incomplete or conflicting.",
    "human": "Human decisions record workflow review and do not establish the diagnosis as fact.",
    "rejected": "The latest recommended action was rejected by the reviewer.",
    "revision": "The reviewer requested revision; no recommendation was approved.",
}

Stage = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    retries: int = MAX_RETRIEVAL_RETRIES
    information_rounds: int = MAX_INFORMATION_ROUNDS
    revision_rounds: int = MAX_REVISION_ROUNDS


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def init_runs(requests: DataFrame, measurements: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """New runs with counters and limits; a request for an unknown or foreign measurement fails."""
    known = measurements.select("measurement_id", F.col("equipment_id").alias("_owner"))
    joined = requests.join(known, "measurement_id", "left")
    error = F.when(F.col("_owner").isNull(), "DATA_ERROR").when(
        F.col("equipment_id").isNotNull() & (F.col("equipment_id") != F.col("_owner")), "TARGET_MISMATCH"
    )
    zero = F.lit(0).cast("bigint")
    return joined.withColumns(
        {
            "equipment_id": F.coalesce("equipment_id", "_owner"),
            "error_code": error,
            "workflow_status": F.when(error.isNotNull(), "FAILED").otherwise("RUNNING"),
            "retries": zero,
            "information_rounds": zero,
            "revisions": zero,
            "max_retries": F.lit(limits.retries).cast("bigint"),
            "max_information_rounds": F.lit(limits.information_rounds).cast("bigint"),
            "max_revision_rounds": F.lit(limits.revision_rounds).cast("bigint"),
        }
    ).drop("_owner")


def capture_errors(runs: DataFrame, condition: Column, code: str) -> DataFrame:
    """Mark the runs a stage cannot process; the other runs go on."""
    broken = condition & (F.col("workflow_status") != "FAILED")
    return runs.withColumns(
        {
            "error_code": F.when(broken, code).otherwise(F.col("error_code")),
            "workflow_status": F.when(broken, "FAILED").otherwise(F.col("workflow_status")),
        }
    )


def route_verdict(status: Column) -> Column:
    return (
        F.when(status == "normal", "normal")
        .when(status == "abnormal", "abnormal")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported analysis status: "), F.coalesce(status, F.lit("null")))))
    )


def plan_queries(runs: DataFrame) -> DataFrame:
    """Two purpose queries per run, plus one for human observations and one for visible findings.

    Optional columns: ``observations`` array<struct<type,value>>, ``visible_terms`` array<string>.
    """
    features = F.col("signal_features")

    def purpose_query(purpose: str, ordinal: int) -> Column:
        text = qb.purpose_text(F.lit(purpose), F.col("analysis_status"), F.col("predicted_class"), F.col("condition"), features)
        return F.struct(F.lit(ordinal).cast("bigint").alias("ordinal"), F.lit(purpose).alias("purpose"), text.alias("query_text"))

    items = [purpose_query(DIAGNOSTIC, 1), purpose_query(INSPECTION, 2)]
    if "observations" in runs.columns:
        seen = F.col("observations")
        newest = F.slice(seen, F.greatest(F.size(seen) - OBSERVATION_LIMIT + 1, F.lit(1)), OBSERVATION_LIMIT)
        text = F.array_join(F.transform(newest, lambda o: F.concat(F.lit("human observation "), o["type"], F.lit(" "), o["value"])), " ")
        items.append(
            F.when(
                F.size(seen) > 0,
                F.struct(F.lit(3).cast("bigint").alias("ordinal"), F.lit(DIAGNOSTIC).alias("purpose"), text.alias("query_text")),
            )
        )
    if "visible_terms" in runs.columns:
        terms = F.col("visible_terms")
        text = F.concat(F.lit("visible exterior observation "), F.array_join(F.slice(terms, 1, VISIBLE_LIMIT), " "))
        items.append(
            F.when(
                F.size(terms) > 0,
                F.struct(F.lit(4).cast("bigint").alias("ordinal"), F.lit(INSPECTION).alias("purpose"), text.alias("query_text")),
            )
        )
    return runs.select("run_id", F.inline_outer(compact(*items)))




def digest_evidence(evidence: DataFrame) -> DataFrame:
    """Coverage facts, the first evidence per purpose and the first eight evidence ids of every run, in one pass."""
    first = F.struct("query_ordinal", (-F.col("score")).alias("_minus"), "chunk_id")
    order = Window.partitionBy("run_id").orderBy("query_ordinal", F.desc("score"), "chunk_id")
    supporting = F.when(F.col("_r") <= SUPPORTING_LIMIT, F.struct("_r", "evidence_id"))

    def first_of(purpose: str) -> Column:
        hit = F.col("purpose") == purpose
        return F.min_by(F.when(hit, F.col("evidence_id")), F.when(hit, first))

    return evidence.withColumn("_r", F.row_number().over(order)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.some(F.col("purpose") == DIAGNOSTIC).alias("has_diagnostic"),
        F.some(F.col("purpose") == INSPECTION).alias("has_inspection"),
        F.some("contradicts").alias("contradicted"),
        first_of(DIAGNOSTIC).alias("first_diagnostic"),
        first_of(INSPECTION).alias("first_inspection"),
        F.transform(F.array_sort(F.collect_list(supporting)), lambda s: s["evidence_id"]).alias("supporting_ids"),
    )


def diagnose(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """One evidence-grounded candidate per run, none without evidence."""
    found = runs.join(digest_evidence(evidence), "run_id", "left")
    identity = F.concat_ws(":", F.col("analysis_id"), F.array_join("supporting_ids", ":"))
    has = F.coalesce("evidence_count", F.lit(0)) > 0
    memory = F.col("memory_count") if "memory_count" in runs.columns else F.lit(0)
    return found.withColumns(
        {
            "evidence_count": F.coalesce("evidence_count", F.lit(0)),
            "candidate_id": F.when(has, F.concat(F.lit("candidate_"), F.substring(F.sha2(identity, 256), 1, 16))),
            "confidence_level": F.when(has, "low"),
            "uncertainty_notes": F.when(has, 2 + (memory > 0).cast("int")).otherwise(0).cast("bigint"),
        }
    )


def verify(diagnosed: DataFrame) -> DataFrame:
    """Evidence status: INSUFFICIENT, then CONFLICTING, then PARTIAL, else SUFFICIENT."""
    missing = compact(
        F.when(~F.col("has_diagnostic"), "diagnostic evidence"), F.when(~F.col("has_inspection"), "inspection evidence")
    )
    status = (
        F.when(F.col("candidate_id").isNull(), "INSUFFICIENT")
        .when(F.coalesce("contradicted", F.lit(False)), "CONFLICTING")
        .when(~(F.col("has_diagnostic") & F.col("has_inspection")), "PARTIAL")
        .otherwise("SUFFICIENT")
    )
    none = F.array(F.lit("diagnostic and inspection technical evidence"))
    return diagnosed.withColumns(
        {
            "evidence_status": status,
            "missing": F.when(status == "INSUFFICIENT", none)
            .when(status == "PARTIAL", missing)
            .otherwise(F.array().cast("array<string>")),
        }
    )


def route_evidence(status: Column, retries: Column, max_retries: Column, rounds: Column, max_rounds: Column) -> Column:
    """Next step after verification, within the retry and information-round limits."""
    asking = F.when(rounds >= max_rounds, "limited_report").otherwise("additional_information")
    return (
        F.when(status == "SUFFICIENT", "sufficient")
        .when((status == "INSUFFICIENT") | (retries >= max_retries), asking)
        .when(status == "PARTIAL", "refine")
        .otherwise("counter_evidence")
    )


def refinement_queries(runs: DataFrame) -> DataFrame:
    """The next query of every run that may still retry."""
    retry = F.col("retries") + 1
    wants_inspection = F.exists("missing", lambda m: m.contains("inspection"))
    partial = F.col("route") == "refine"
    return runs.filter(F.col("route").isin("refine", "counter_evidence")).select(
        "run_id",
        (retry + 2).alias("ordinal"),
        F.when(partial & wants_inspection, INSPECTION).otherwise(DIAGNOSTIC).alias("purpose"),
        F.when(partial, qb.refined_text(F.col("missing"), retry)).otherwise(qb.COUNTER_PHRASE).alias("query_text"),
    )


def with_route(verified: DataFrame) -> DataFrame:
    return verified.withColumn(
        "route",
        route_evidence(
            F.col("evidence_status"), F.col("retries"), F.col("max_retries"), F.col("information_rounds"), F.col("max_information_rounds")
        ),
    )




def with_query_key(asked: DataFrame) -> DataFrame:
    """Run queries, stored with the key of their (purpose, query_text), the bytes that their query_id spells out."""
    text = F.sha2(F.concat_ws(":", "purpose", "query_text"), 256)
    return stored(asked.withColumn("_query", F.unhex(F.substring(text, 1, 20))))


def search_lists(asked: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What each different (purpose, query_text) of keyed run queries finds, one stored row a text: its key, how many ask it, its hits.

    ``search`` maps (query_id, purpose, question) to rows (query_id, chunk_id, ...), as many a query as a candidate list has.
    """
    texts = asked.groupBy("_query").agg(F.first("purpose").alias("purpose"), F.first("query_text").alias("question"), F.count(F.lit(1)).alias("_asked"))
    texts = stored(texts.withColumn("query_id", F.concat(F.lit("query_"), F.lower(F.hex("_query")))))
    found = search(texts.select("query_id", "purpose", "question"))
    found = found.withColumn("evidence_id", tx.short_hash("evidence_", F.col("query_id"), F.col("chunk_id")))
    hits = found.groupBy("query_id").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "query_id"])).alias("hits"))
    return stored(texts.select("query_id", "_query", "_asked").join(hits, "query_id").drop("query_id"))


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows (run_id, _query, ...) with a column of the list of their query; rows without hits go.

    Only a query that more than a share of all rows ask, so a few at most, returns to its runs in salted parts.
    """
    least = lists.agg(F.sum("_asked") / POPULAR_SHARE).first()[0]
    popular = F.col("_query").isin([bytes(r[0]) for r in lists.filter(F.col("_asked") > least).select("_query").collect()] if least else [])
    salts = F.when(popular, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn("_salt", F.when(popular, F.pmod(F.xxhash64("run_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(lists.drop("_asked").withColumn("_salt", F.explode(salts)), ["_query", "_salt"]).drop("_salt")


def search_once(asked: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evidence of a table of run queries (run_id, ordinal, purpose, query_text).

    Runs often ask the same, so each different (purpose, query_text) is searched once.
    """
    asked = with_query_key(asked)
    return evidence_rows(asked, search_lists(asked, search))


def evidence_rows(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """The hits of keyed run queries as rows, made where a query meets its list."""
    rows = asked.drop("query_text").withColumnRenamed("ordinal", "query_ordinal")
    found = with_lists(rows, lists)
    return found.select(*[c for c in rows.columns if c != "_query"], F.inline("hits"))


def search_union(asked: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search_once`` with one row per run and chunk; the first query keeps it, and ``tie`` is the chunk.

    Runs whose queries share a chunk are found by hashes of their lists, so no text and no id of a chunk is shuffled by
    run. Only the rows of these runs are brought together and united; the others are whole as they are.
    """
    asked = with_query_key(asked)
    lists = search_lists(asked, search)
    marks = lists.select("_query", "_asked", F.transform("hits", lambda h: F.xxhash64(h["chunk_id"])).alias("_marks"))
    met = with_lists(asked.select("run_id", "_query"), marks).select("run_id", "_marks").repartition("run_id")
    often = met.select("run_id", F.explode("_marks").alias("_mark")).groupBy("run_id", "_mark").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    sharing = stored(often.select(F.col("run_id").alias("_run")).distinct())
    if sharing.isEmpty():
        return evidence_rows(asked, lists).withColumn("tie", F.col("chunk_id"))
    same = F.col("run_id").eqNullSafe(F.col("_run"))
    plain, shared = (evidence_rows(asked.join(sharing, same, how), lists).withColumn("tie", F.col("chunk_id")) for how in ("left_anti", "left_semi"))
    return plain.unionByName(rt.union_evidence(shared))


def refine(runs: DataFrame, evidence: DataFrame, search: Callable[[DataFrame], DataFrame], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Bounded refinement: at most ``limits.retries`` more searches for the runs still open.

    ``search`` maps queries (run_id, ordinal, purpose, query_text) to evidence rows. A round works on its
    frontier alone: runs that are settled, and their evidence, leave it. Frontiers are stored, and so is
    the evidence given, so no round repeats an earlier one or a search. Returns the routed runs and all evidence.
    """
    frontier, evidence, settled, seen = runs, stored(evidence), [], []
    for left in range(limits.retries, -1, -1):
        state = stored(with_route(verify(diagnose(frontier, evidence))))
        going = F.col("route").isin("refine", "counter_evidence") & F.lit(left > 0)
        settled.append(state.filter(~going))
        asked = refinement_queries(state.filter(going))
        if asked.isEmpty():
            break
        open_ids = asked.select("run_id")
        seen.append(evidence.join(open_ids, "run_id", "left_anti"))
        here = evidence.join(open_ids, "run_id", "left_semi")
        fresh = search(asked).join(here.select("run_id", "chunk_id"), ["run_id", "chunk_id"], "left_anti")
        evidence = stored(here.unionByName(fresh.select(*here.columns)))
        frontier = state.filter(going).select(*runs.columns).withColumn("retries", F.col("retries") + 1)
    return reduce(DataFrame.unionByName, settled), reduce(DataFrame.unionByName, [*seen, evidence])


def inspection_plan(verified: DataFrame) -> DataFrame:
    """One numbered step per available purpose."""

    def step(flag: str, name: str, evidence: str) -> Column:
        return F.when(F.col(flag), F.struct(F.lit(name).alias("topic"), F.col(evidence).alias("evidence_id")))

    steps = compact(
        step("has_diagnostic", "condition", "first_diagnostic"), step("has_inspection", "indicators", "first_inspection")
    )
    numbered = F.transform(
        steps,
        lambda s, i: F.struct(
            F.format_string("INS-%03d", i + 1).alias("step_id"), (i + 1).alias("order"), s["topic"].alias("topic"), s["evidence_id"].alias("evidence_id")
        ),
    )
    empty = F.slice(numbered, 1, 0)
    return verified.withColumn("plan", F.when(F.col("candidate_id").isNotNull(), numbered).otherwise(empty))


def recommend(planned: DataFrame) -> DataFrame:
    """One inspection action per run with a plan, tied to the plan's evidence."""
    ids = F.array_distinct(F.transform("plan", lambda s: s["evidence_id"]))
    action = F.concat(F.lit("action_"), F.substring(F.sha2(F.array_join(ids, ":"), 256), 1, 16))
    some = F.size("plan") > 0
    return planned.withColumns(
        {
            "action_id": F.when(some, action),
            "action_type": F.when(some, "INSPECT"),
            "action_priority": F.when(some, "medium"),
            "action_evidence": F.when(some, ids),
        }
    )


def apply_policy(actions: DataFrame) -> DataFrame:
    """Guardrails on actions: the first violation, or approval need and limitations.

    Columns: action_type, priority, summary, reason, supporting_ids, known_ids, limitations.
    """
    wording = F.lower(F.concat_ws(" ", "summary", "reason"))
    important = F.col("action_type").isin(*IMPORTANT_ACTIONS) | (F.col("priority") == "high")
    violation = (
        F.when(~F.col("action_type").isin(*ALLOWED_ACTIONS), "ACTION_NOT_ALLOWED")
        .when(F.size(F.array_except("supporting_ids", "known_ids")) > 0, "UNKNOWN_EVIDENCE")
        .when(F.exists(F.array(*[F.lit(p) for p in PROHIBITED_PHRASES]), lambda p: wording.contains(p)), "AUTOMATIC_CONTROL")
        .when(important & (F.size("supporting_ids") == 0), "MISSING_EVIDENCE")
    )
    noted = F.when(F.col("action_type") == "SHUTDOWN_CHECK", F.array_append("limitations", F.lit(SHUTDOWN_NOTE))).otherwise(F.col("limitations"))
    return actions.withColumns(
        {
            "violation": violation,
            "requires_human_approval": F.when(violation.isNull(), important),
            "limitations": F.array_distinct(noted),
        }
    )


def human_requests(runs: DataFrame) -> DataFrame:
    """Approval or information request of every run that has to wait."""
    approval = F.col("requires_human_approval")
    asking = F.col("route") == "additional_information"
    kind = F.when(approval, "APPROVAL").when(asking, "ADDITIONAL_INFORMATION")
    suffix = F.when(approval, F.concat_ws(":", "action_id", F.col("revisions").cast("string"))).otherwise(
        (F.col("information_rounds") + 1).cast("string")
    )

    def mentions(word: str) -> Column:
        return F.exists("missing", lambda m: F.lower(m).contains(word))

    fields = F.when(mentions("image"), F.array(F.lit("inspection_image_id"))).otherwise(
        F.array(F.lit("inspection_observation"), F.lit("operating_condition_confirmation"))
    )
    fields = F.when(mentions("maintenance"), F.array_append(fields, F.lit("maintenance_history"))).otherwise(fields)
    return runs.withColumn("request_type", kind).filter(F.col("request_type").isNotNull()).select(
        "run_id",
        "request_type",
        tx.short_hash("request_", F.col("run_id"), F.col("request_type"), suffix).alias("request_id"),
        F.when(asking & ~approval, fields).otherwise(F.array().cast("array<string>")).alias("requested_fields"),
        F.when(F.size("missing") > 0, F.array_join("missing", "; ")).otherwise("Additional evidence context is required.").alias("reason"),
    )


def validate_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Check responses (run_id, request_id, response map, received_order) against waiting requests.

    Adds ``rejection``: the first broken rule, or null. A refused response leaves its request open, so
    the earliest response that breaks no other rule is accepted and later ones are late. That earliest
    order is a mergeable minimum per request; it joins back by salted keys, so a request with very many
    responses is neither sorted nor gathered.
    """
    waiting = requests.select("run_id", F.col("request_id").alias("_pending"), "request_type", "requested_fields", "workflow_status")
    body = F.col("response")
    decision = F.element_at(body, F.lit("decision"))
    lacking = F.filter("requested_fields", lambda f: F.coalesce(F.element_at(body, f), F.lit("")) == "")
    broken = (
        F.when(F.col("workflow_status").isNull(), "RUN_NOT_FOUND")
        .when(F.col("workflow_status") != "WAITING", "NOT_WAITING")
        .when(F.col("_pending").isNull(), "NO_PENDING_REQUEST")
        .when(~F.col("request_id").eqNullSafe(F.col("_pending")), "REQUEST_MISMATCH")
        .when(F.length(F.to_json(body)) > MAX_RESPONSE_CHARS, "TOO_LARGE")
        .when((F.col("request_type") == "APPROVAL") & ~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), "INVALID_DECISION")
        .when((F.col("request_type") != "APPROVAL") & (F.size(lacking) > 0), "MISSING_FIELDS")
    )
    judged = responses.join(waiting, "run_id", "left").withColumn("rejection", broken).drop("_pending")
    judged = judged.withColumn("_salt", F.pmod(F.xxhash64("received_order", F.to_json("response")), F.lit(RESPONSE_SALTS)))
    firsts = judged.filter(F.col("rejection").isNull()).groupBy("run_id").agg(F.min("received_order").alias("_first"))
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RESPONSE_SALTS - 1)).cast("array<bigint>")))
    late = F.col("rejection").isNull() & (F.col("received_order") > F.col("_first"))
    known = judged.join(firsts, ["run_id", "_salt"], "left")
    return known.withColumn("rejection", F.when(late, "ALREADY_RESOLVED").otherwise(F.col("rejection"))).drop("_first", "_salt")


def apply_responses(runs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Resume runs: new observations, a revision, or the report. The analysis stays as it is."""
    rows = accepted.select("run_id", F.col("request_type").alias("_type"), F.element_at("response", F.lit("decision")).alias("_decision"))
    joined = runs.join(rows, "run_id", "left")
    informed = F.col("_type") == "ADDITIONAL_INFORMATION"
    revising = (F.col("_type") == "APPROVAL") & (F.col("_decision") == "NEEDS_REVISION")
    revisions = F.col("revisions") + F.coalesce(revising, F.lit(False)).cast("bigint")
    return joined.withColumns(
        {
            "information_rounds": F.col("information_rounds") + F.coalesce(informed, F.lit(False)).cast("bigint"),
            "revisions": revisions,
            "workflow_status": F.when(F.col("_type").isNotNull(), "RUNNING").otherwise(F.col("workflow_status")),
            "next_step": F.when(informed, "update_context")
            .when(revising & (revisions <= F.col("max_revision_rounds")), "revise")
            .when(F.col("_type").isNotNull(), "report"),
            "last_decision": F.col("_decision"),
        }
    ).drop("_type", "_decision")


def observation_rows(accepted: DataFrame) -> DataFrame:
    """One row per requested field that a response filled in."""
    wanted = F.filter("requested_fields", lambda f: f != "inspection_image_id")
    return accepted.filter(F.col("request_type") == "ADDITIONAL_INFORMATION").select(
        "run_id", "request_id", "response", F.posexplode(wanted).alias("position", "type")
    ).withColumn("value", F.element_at("response", F.col("type"))).drop("response")


def report_limitations(evidence_status: Column, interactions: Column, last_decision: Column) -> Column:
    """Limitation keys of a final report, in report order."""
    return compact(
        F.lit("confidence"),
        F.lit("control"),
        F.when(~evidence_status.eqNullSafe(F.lit("SUFFICIENT")), "evidence"),
        F.when(interactions > 0, "human"),
        F.when((interactions > 0) & (last_decision == "REJECTED"), "rejected"),
        F.when((interactions > 0) & (last_decision == "NEEDS_REVISION"), "revision"),
    )


def citations(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every evidence row of a reported run, as rows rather than one list per run."""
    return evidence.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", "evidence_id", "document_id", "chunk_id")


def reports(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    counts = citations(runs, evidence).groupBy("run_id").agg(F.count(F.lit(1)).alias("citation_count"))
    keys = report_limitations(F.col("evidence_status"), F.col("interactions"), F.col("last_decision"))
    normal = F.col("analysis_status") == "normal"
    return runs.join(counts, "run_id", "left").select(
        "run_id",
        "equipment_id",
        "measurement_id",
        F.when(normal, "normal_report").otherwise("diagnostic_report").alias("report_type"),
        F.when(normal, F.lit(0)).otherwise(F.coalesce("citation_count", F.lit(0))).cast("bigint").alias("citation_count"),
        F.when(normal, F.array(F.lit("normal"))).otherwise(keys).alias("limitations"),
    )


def emit_events(runs: DataFrame, node: str, role: str, message: str, extra: Sequence[str] = (), started: bool = False) -> DataFrame:
    """Ordered events of one stage for every run; ``event_offset`` is the number already emitted."""
    kinds = (["workflow_started"] if started else []) + ["node_started", "node_completed", *extra]
    attempt = F.concat_ws(":", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("retries", "information_rounds", "revisions", "interactions")])
    rows = runs.select(
        "run_id", "event_offset", attempt.alias("_attempt"), F.posexplode(F.array(*[F.lit(k) for k in kinds])).alias("_i", "event_type")
    )
    return rows.select(
        "run_id",
        (F.col("event_offset") + F.col("_i") + 1).alias("sequence"),
        tx.short_hash("event_", F.col("run_id"), F.lit(node), F.col("event_type"), F.col("_attempt")).alias("event_id"),
        "event_type",
        F.lit(node).alias("node"),
        F.lit(role).alias("agent_role"),
        F.when(F.col("event_type") == "node_completed", message).otherwise(F.concat_ws(" ", F.lit(node), "event_type")).alias("message"),
    )


def unknown_references(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """References (run_id, evidence_id) that no evidence row of the run backs."""
    return references.join(evidence.select("run_id", "evidence_id"), ["run_id", "evidence_id"], "left_anti")


def trace_citations(cited: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Per run: citations, those with evidence, and those whose source the manifest lists."""
    listed = sources.select("source_id", F.lit(1).alias("_s")).dropDuplicates(["source_id"])
    found = evidence.join(listed, "source_id", "left").select("run_id", "evidence_id", F.lit(0).alias("_c"), F.lit(1).alias("_e"), "_s")
    none = F.lit(None).cast("int")
    rows = cited.select("run_id", "evidence_id", F.lit(1).alias("_c"), none.alias("_e"), none.alias("_s")).unionByName(found)
    ids = rows.groupBy("run_id", "evidence_id").agg(F.sum("_c").alias("_c"), F.max("_e").alias("_e"), F.max("_s").alias("_s")).filter(F.col("_c") > 0)
    known = F.col("run_id").isNotNull() & F.col("evidence_id").isNotNull() & F.col("_e").isNotNull()
    sourced = known & F.col("_s").isNotNull()
    return ids.groupBy("run_id").agg(
        F.sum("_c").alias("citations"),
        F.sum(F.when(known, F.col("_c")).otherwise(0)).alias("with_evidence"),
        F.sum(F.when(sourced, F.col("_c")).otherwise(0)).alias("with_source"),
        F.every(sourced).alias("traced"),
    )


def hitl_status(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    done = resolved.select("run_id").distinct().withColumn("_done", F.lit(1))
    return runs.join(done, "run_id", "left").withColumn(
        "hitl_status",
        F.when(F.col("pending_request_id").isNotNull(), "PENDING").when(F.col("_done").isNotNull(), "RESOLVED").otherwise("NONE"),
    ).drop("_done")


def filter_runs(runs: DataFrame, workflow_status=None, measurement_id=None, equipment_id=None, ml_prediction=None) -> DataFrame:
    """Search filter: equality on status, substring without case on ids, a JSON field."""
    out = runs
    if workflow_status is not None:
        out = out.filter(F.col("workflow_status") == workflow_status)
    for column, needle in (("measurement_id", measurement_id), ("equipment_id", equipment_id)):
        if needle:
            out = out.filter(F.lower(F.col(column)).contains(needle.lower()))
    if ml_prediction:
        out = out.filter(F.get_json_object("analysis_json", "$.status") == ml_prediction)
    return out


def run_summary(runs: DataFrame) -> DataFrame:
    field_ = lambda name: F.get_json_object("analysis_json", f"$.{name}")
    return runs.select(
        "run_id",
        "equipment_id",
        "measurement_id",
        "workflow_status",
        F.coalesce(field_("status"), field_("predicted_class")).alias("ml_prediction"),
        field_("confidence").cast("double").alias("ml_confidence"),
        F.col("final_report_json").isNotNull().alias("final_report_available"),
    )


def page(df: DataFrame, number: int, size: int, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(page rows, totals) in a stable order; totals carry row and page counts."""
    totals = df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), totals


def page_after(df: DataFrame, size: int, order: Sequence[str], last: Sequence | None = None) -> DataFrame:
    """The next ``size`` rows, newest first, after the row whose ``order`` values are ``last``.

    The boundary is a filter, so a deep page costs what the first one does and tasks keep ``size`` rows.
    """
    if last is not None:
        older, equal = F.lit(False), F.lit(True)
        for column, value in zip(order, last):
            older = older | (equal & (F.col(column) < F.lit(value)))
            equal = equal & (F.col(column) == F.lit(value))
        df = df.filter(older)
    return df.orderBy(*[F.desc(column) for column in order]).limit(size)


def check_targets(requests: DataFrame, measurements: DataFrame) -> DataFrame:
    """Requests whose named equipment does not own the measurement."""
    owner = measurements.select("measurement_id", F.col("equipment_id").alias("owner"))
    return requests.join(owner, "measurement_id").filter(F.col("equipment_id").isNotNull() & (F.col("equipment_id") != F.col("owner")))


def run_view(runs: DataFrame, states: DataFrame, pending: DataFrame) -> DataFrame:
    """Run row with its latest state and its open request."""
    return runs.join(states, "run_id", "left").join(pending, "run_id", "left")


def contract_violations(candidates: DataFrame, time: str | None = None) -> DataFrame:
    """The first rule a record breaks: evidence on both sides, an unknown level, or a time text without a zone."""
    error = F.when(F.arrays_overlap("supporting_ids", "contradicting_ids"), "SUPPORT_AND_CONTRADICT").when(
        ~F.coalesce(F.col("confidence_level").isin("low", "medium", "high"), F.lit(False)), "INVALID_LEVEL"
    )
    if time:
        zoned = F.col(time).rlike(r"(Z|[+-]\d{2}:\d{2})$")
        error = error.when(~F.coalesce(zoned, F.lit(False)), "TIME_WITHOUT_ZONE")
    return candidates.withColumn("contract_error", error)


def serving_context(analysis: DataFrame, measurements: DataFrame) -> DataFrame:
    """Fields retrieval may see: ids and condition from metadata, else from the result; no labels."""
    meta = measurements.select("measurement_id", F.col("bearing_id").alias("_b"), F.col("condition").alias("_c"))
    return analysis.join(meta, "measurement_id", "left").select(
        "analysis_id",
        "measurement_id",
        "status",
        "predicted_class",
        "confidence",
        F.coalesce("_b", "bearing_id").alias("bearing_id"),
        F.coalesce("_c", "condition").alias("condition"),
    )


@dataclass(frozen=True)
class WorkflowStages:
    """Replaceable stages; each takes the runs and the evidence and returns the runs."""

    diagnose: Stage = diagnose
    verify: Callable[[DataFrame], DataFrame] = verify
    plan: Callable[[DataFrame], DataFrame] = inspection_plan
    recommend: Callable[[DataFrame], DataFrame] = recommend
    limits: Limits = field(default_factory=Limits)

    def run(self, runs: DataFrame, evidence: DataFrame) -> DataFrame:
        return self.recommend(self.plan(with_route(self.verify(self.diagnose(runs, evidence)))))


