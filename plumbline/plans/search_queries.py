"""Queries that search the corpus with the planned queries of all runs, and refine them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from plumbline.functions.hashing import word_vector
from plumbline.operators import queries as qb, retrieval as rt, workflow as wf
from plumbline.plans.registry import query, with_views
from plumbline.plans.retrieval_queries import ALLOW_LISTS, LIST_SQL, MAX_TIER, SEARCHABLE, TOP_K, vector_sql
from plumbline.plans.text_queries import CHUNKS_SQL, DOCS_SQL, PAGES_SQL, document_chunks
from plumbline.plans.views import RUNS_SQL
from plumbline.plans.workflow_queries import PLANNED_SQL, observed_runs
from plumbline.session import stored

#: Evidence below this score is none; evidence in this language counts as contradicting. Both are made up for the
#: given tables, which have neither, and were picked so that runs end in several states and rounds.
LEAST_SCORE = 0.275
CONTRADICTING = "es"
ROUNDS = wf.MAX_RETRIEVAL_RETRIES

MISSING = ("diagnostic evidence", "inspection evidence")
#: Every text a run may ask after its planned queries, one row per round.
REFINED_SQL = " UNION ALL ".join(
    f"SELECT '{'INSPECTION_ACTION' if 'inspection' in missing else 'DIAGNOSTIC_EVIDENCE'}' AS purpose, 'bearing technical evidence needed to address {missing} workflow refinement {n}' AS query_text"
    for n in range(1, ROUNDS + 1)
    for missing in (*MISSING, ", ".join(MISSING))
) + f" UNION ALL SELECT 'DIAGNOSTIC_EVIDENCE', '{qb.COUNTER_PHRASE}'"

SEARCH_SQL = (
    f"""planned AS ({PLANNED_SQL}),
texts AS (SELECT DISTINCT purpose, query_text, 'query_' || substr(sha256(purpose || ':' || query_text), 1, 20) AS query_id,
    CASE purpose WHEN 'INSPECTION_ACTION' THEN {LIST_SQL['B']} ELSE {LIST_SQL['A']} END AS sources FROM (SELECT purpose, query_text FROM planned UNION ALL {REFINED_SQL})),
"""
    + vector_sql("qv", "query_id", "query_text", "texts")
    + ",\n"
    + vector_sql("cv", "chunk_id", "content", "chunks")
    + f""",
qd AS (SELECT query_id, list(coalesce(w, 0)::DOUBLE ORDER BY b)::DOUBLE[384] AS v, sqrt(sum(w * w)) AS n FROM (SELECT query_id, unnest(range(384)) AS b FROM texts) LEFT JOIN qv USING (query_id, b) GROUP BY 1),
cd AS (SELECT chunk_id, list(coalesce(w, 0)::DOUBLE ORDER BY b)::DOUBLE[384] AS v, sqrt(sum(w * w)) AS n FROM (SELECT chunk_id, unnest(range(384)) AS b FROM chunks) LEFT JOIN cv USING (chunk_id, b) GROUP BY 1),
scored AS (
  SELECT t.query_id, c.chunk_id, c.document_id, c.source_tier, c.document_type = '{CONTRADICTING}' AS contradicts, round(array_inner_product(qd.v, cd.v) / (qd.n * cd.n), 9) AS score
  FROM texts t JOIN qd USING (query_id) JOIN chunks c ON list_contains(t.sources, c.source_id) AND c.source_tier <= {MAX_TIER} JOIN cd USING (chunk_id)),
hits AS (SELECT * FROM scored WHERE score >= {LEAST_SCORE} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {TOP_K}),
ev0 AS (SELECT run_id, ordinal AS query_ordinal, purpose, chunk_id, contradicts, score, query_id FROM planned JOIN texts USING (purpose, query_text) JOIN hits USING (query_id)
  QUALIFY row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY ordinal, score DESC) = 1)"""
)


def round_sql(number: int) -> str:
    """State of the runs after a round, what the open ones ask, and the evidence that it brings."""
    runs = "SELECT run_id, information_rounds FROM runs WHERE analysis_status = 'abnormal'" if number == 0 else f"SELECT run_id, information_rounds FROM state{number - 1} WHERE route IN ('refine', 'counter_evidence')"
    return f"""state{number} AS (
  SELECT *, CASE WHEN evidence_status = 'SUFFICIENT' THEN 'sufficient' WHEN evidence_status = 'INSUFFICIENT' OR {number} >= {ROUNDS}
      THEN CASE WHEN information_rounds >= 2 THEN 'limited_report' ELSE 'additional_information' END
    WHEN evidence_status = 'PARTIAL' THEN 'refine' ELSE 'counter_evidence' END AS route
  FROM (SELECT run_id, any_value(information_rounds) AS information_rounds, CAST({number} AS BIGINT) AS retries,
      coalesce(bool_or(purpose = 'DIAGNOSTIC_EVIDENCE'), FALSE) AS has_d, coalesce(bool_or(purpose = 'INSPECTION_ACTION'), FALSE) AS has_i,
      CASE WHEN count(chunk_id) = 0 THEN 'INSUFFICIENT' WHEN bool_or(contradicts) THEN 'CONFLICTING' WHEN has_d AND has_i THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS evidence_status
    FROM ({runs}) LEFT JOIN ev{number} USING (run_id) GROUP BY run_id)),
asked{number} AS (
  SELECT run_id, CASE WHEN route = 'refine' AND has_d THEN 'INSPECTION_ACTION' ELSE 'DIAGNOSTIC_EVIDENCE' END AS purpose,
    CASE WHEN route = 'refine' THEN 'bearing technical evidence needed to address ' || CASE WHEN has_d THEN '{MISSING[1]}' ELSE '{MISSING[0]}' END || ' workflow refinement {number + 1}'
      ELSE '{qb.COUNTER_PHRASE}' END AS query_text FROM state{number} WHERE route IN ('refine', 'counter_evidence')),
ev{number + 1} AS (
  SELECT run_id, query_ordinal, purpose, chunk_id, contradicts, score FROM ev{number} WHERE run_id IN (SELECT run_id FROM asked{number})
  UNION ALL SELECT run_id, {number + 3}, purpose, chunk_id, contradicts, score FROM asked{number} JOIN texts USING (purpose, query_text) JOIN hits USING (query_id)
  WHERE NOT EXISTS (SELECT 1 FROM ev{number} e WHERE e.run_id = asked{number}.run_id AND e.chunk_id = hits.chunk_id))"""


S = with_views(RUNS_SQL, DOCS_SQL, PAGES_SQL, CHUNKS_SQL, SEARCH_SQL)
F_SQL = S.rstrip() + ",\n" + ",\n".join(round_sql(n) for n in range(ROUNDS + 1)) + "\n"


def searchable(spark, sf_dir):
    """The chunks that some purpose admits, with their vectors, stored once."""
    chunks = document_chunks(spark, sf_dir, rt.compile_filter(SEARCHABLE))
    vectors = rt.with_norm(chunks.withColumn("vector", word_vector("content")))
    return stored(rt.packed(vectors.select("chunk_id", "document_id", "document_type", "source_id", "source_tier", "vector", "norm")))


def corpus_search(chunks, texts):
    """Evidence of query texts: the best chunks that their purpose admits, from one tiled join."""
    wanted = qb.with_purpose_filter(texts.withColumn("mode", F.lit("DIAGNOSTIC")), ALLOW_LISTS, max_tier=MAX_TIER)
    asked = rt.with_norm(wanted.withColumn("vector", word_vector("question")))
    ranked = rt.vector_topk_once(asked, chunks, TOP_K, LEAST_SCORE)
    facts = chunks.select("chunk_id", "document_id", F.col("source_tier").cast("bigint").alias("source_tier"), (F.col("document_type") == CONTRADICTING).alias("contradicts"))
    return ranked.drop("dot", "rank").join(facts, "chunk_id")


def planned_evidence(spark, sf_dir, chunks):
    """Evidence of all planned queries, one row per run and chunk; the first query keeps it."""
    return wf.search_union(wf.plan_queries(observed_runs(spark, sf_dir)), partial(corpus_search, chunks))


@query(
    "planned_evidence",
    S
    + """SELECT run_id, query_ordinal, purpose, chunk_id, 'evidence_' || substr(sha256(query_id || ':' || chunk_id), 1, 20) AS evidence_id, score, contradicts FROM ev0""",
)
def planned_evidence_query(spark, sf_dir):
    return planned_evidence(spark, sf_dir, searchable(spark, sf_dir)).select("run_id", "query_ordinal", "purpose", "chunk_id", "evidence_id", "score", "contradicts")


@query(
    "refined_runs",
    F_SQL + " UNION ALL ".join(f"SELECT run_id, evidence_status, route, retries FROM state{n} WHERE route NOT IN ('refine', 'counter_evidence')" for n in range(ROUNDS + 1)),
)
def refined_runs(spark, sf_dir):
    """Planned queries are searched; runs with partial or conflicting evidence search again, twice at most.

    All rounds search one stored copy of the vectors.
    """
    base = observed_runs(spark, sf_dir).withColumn("retries", F.lit(0).cast("bigint"))
    chunks = searchable(spark, sf_dir)
    state, _ = wf.refine(base, planned_evidence(spark, sf_dir, chunks).drop("tie"), lambda asked: wf.search_once(asked, partial(corpus_search, chunks)))
    return state.select("run_id", "evidence_status", "route", "retries")
