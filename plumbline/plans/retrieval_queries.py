"""Queries that search all chunks for all questions at once, with retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.hashing import gram_vector, word_vector
from plumbline.operators import queries as qb, retrieval as rt
from plumbline.plans import views
from plumbline.plans.registry import query, with_views
from plumbline.plans.text_queries import CHUNKS_SQL, DOCS_SQL, GRAMS_SQL, PAGES_SQL, document_chunks, turns

TOP_K = 5
MAX_TIER = 2
SOURCES_A = [f"src{i}" for i in range(0, 12)]
SOURCES_B = [f"src{i}" for i in range(8, 20)]
ALLOW_LISTS = {
    ("DIAGNOSTIC_EVIDENCE", "DIAGNOSTIC"): SOURCES_A,
    ("DIAGNOSTIC_EVIDENCE", "EVALUATION"): SOURCES_A,
    ("INSPECTION_ACTION", "DIAGNOSTIC"): SOURCES_B,
    ("INSPECTION_ACTION", "EVALUATION"): SOURCES_B,
    ("DATASET_EVIDENCE", "DIAGNOSTIC"): SOURCES_A,
    ("DATASET_EVIDENCE", "EVALUATION"): SOURCES_A + SOURCES_B[4:],
}
LIST_SQL = {name: "[" + ", ".join(f"'{s}'" for s in sources) + "]" for name, sources in (("A", SOURCES_A), ("B", SOURCES_B))}

CASES_SQL = f"""cases AS (
  SELECT 'case_' || item_id AS query_id, text AS question,
         CASE item_id % 3 WHEN 0 THEN 'DIAGNOSTIC_EVIDENCE' WHEN 1 THEN 'INSPECTION_ACTION' ELSE 'DATASET_EVIDENCE' END AS purpose,
         CASE item_id % 3 WHEN 1 THEN {LIST_SQL['B']} ELSE {LIST_SQL['A']} END AS sources,
         CAST(2 AS BIGINT) AS max_tier, item_id % 5 <> 0 AS answerable,
         CASE WHEN item_id % 7 = 0 THEN [] ELSE ['src' || (item_id % 20), 'src' || ((item_id * 7 + 3) % 20)] END AS expected_sources,
         ['en', 'fr'] AS expected_types
  FROM benchmark)"""

def vector_sql(name: str, key: str, text: str, table: str) -> str:
    return rf"""{name} AS (
  SELECT {key}, g % 384 AS b, count(*) AS w FROM (
    SELECT {key}, unnest(h || list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % 4294967296)) AS g
    FROM (SELECT {key}, list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'),
                                       lambda x: ('0x' || substr(sha256(x), 1, 8))::BIGINT) AS h FROM {table})) GROUP BY 1, 2)"""


TOPK_SQL = vector_sql("qv", "query_id", "question", "cases") + ",\n" + vector_sql("cv", "chunk_id", "content", "chunks") + """,
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1), cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM cv GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(qv.w * cv.w) AS d FROM qv JOIN cv USING (b) GROUP BY 1, 2),
pairs AS (SELECT q.query_id, c.chunk_id, coalesce(d, 0) AS d, c.source_id, c.document_type, c.source_tier, c.document_id
          FROM cases q JOIN chunks c ON list_contains(q.sources, c.source_id) AND c.source_tier <= q.max_tier LEFT JOIN dots USING (query_id, chunk_id)),
scored AS (SELECT query_id, chunk_id, source_id, document_type, source_tier, round(CASE WHEN coalesce(qn.n * cn.n, 0) = 0 THEN 0 ELSE d / (qn.n * cn.n) END, 9) AS score
           FROM pairs LEFT JOIN qn USING (query_id) LEFT JOIN cn USING (chunk_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS BIGINT) AS rank FROM scored)"""

PICKED_SQL = rf"""cand AS (SELECT query_id, rank, chunk_id, document_id, chunk_index, list_distinct(regexp_extract_all(lower(content), '\S+')) AS words
  FROM ranked JOIN (SELECT chunk_id, document_id, chunk_index, content FROM chunks) USING (chunk_id) WHERE rank <= {TOP_K * rt.OVERFETCH}),
fold AS (
  SELECT query_id, 0 AS step, [] :: STRUCT(chunk_id VARCHAR, document_id VARCHAR, chunk_index BIGINT, words VARCHAR[])[] AS kept FROM cases
  UNION ALL
  SELECT f.query_id, f.step + 1, CASE WHEN c.chunk_id IS NULL OR len(f.kept) >= {TOP_K} OR len(list_filter(f.kept, lambda k: k.document_id = c.document_id
      AND abs(k.chunk_index - c.chunk_index) <= {rt.DUPLICATE_DISTANCE}
      AND len(list_intersect(k.words, c.words)) / CAST(greatest(1, least(len(k.words), len(c.words))) AS DOUBLE) >= {rt.DUPLICATE_OVERLAP})) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'chunk_id': c.chunk_id, 'document_id': c.document_id, 'chunk_index': c.chunk_index, 'words': c.words}}) END
  FROM fold f LEFT JOIN cand c ON c.query_id = f.query_id AND c.rank = f.step + 1 WHERE f.step < {TOP_K * rt.OVERFETCH}),
picked AS (SELECT query_id, unnest(list_transform(kept, lambda k: k.chunk_id)) AS chunk_id, unnest(list_transform(kept, lambda k: k.document_id)) AS document_id, CAST(unnest(range(1, len(kept) + 1)) AS BIGINT) AS place
  FROM fold WHERE step = {TOP_K * rt.OVERFETCH}),
chosen AS (SELECT r.* EXCLUDE (rank), p.document_id, p.place AS rank FROM ranked r JOIN picked p USING (query_id, chunk_id))"""

R = with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL, CASES_SQL, TOPK_SQL)
RP = R.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + PICKED_SQL + "\n"


def cases(spark, sf_dir):
    item = F.col("item_id")
    number = item % 3
    rows = views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("case_"), item.cast("string")).alias("query_id"),
        F.col("text").alias("question"),
        F.when(number == 0, "DIAGNOSTIC_EVIDENCE").when(number == 1, "INSPECTION_ACTION").otherwise("DATASET_EVIDENCE").alias("purpose"),
        F.lit("DIAGNOSTIC").alias("mode"),
        (item % 5 != 0).alias("answerable"),
        F.when(item % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("src"), (item % 20).cast("string")), F.concat(F.lit("src"), ((item * 7 + 3) % 20).cast("string"))))
        .alias("expected_sources"),
        F.array(F.lit("en"), F.lit("fr")).alias("expected_types"),
    )
    return qb.with_purpose_filter(rows, ALLOW_LISTS, max_tier=MAX_TIER)


#: What any question may see: documents outside it are neither chunked nor scored.
SEARCHABLE = {"source_id_in": sorted({source for sources in ALLOW_LISTS.values() for source in sources}), "source_tier_lte": MAX_TIER}


def searched(spark, sf_dir, k):
    """Ranked chunks per case, with the chunk's own metadata."""
    asked = rt.with_norm(cases(spark, sf_dir).withColumn("vector", word_vector("question")))
    stored = document_chunks(spark, sf_dir, rt.compile_filter(SEARCHABLE))
    vectors = rt.with_norm(stored.withColumn("vector", word_vector("content")))
    return rt.vector_topk(asked, vectors, k), stored


@query("vector_topk", R + f"SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= {TOP_K * rt.OVERFETCH}")
def vector_topk(spark, sf_dir):
    ranked, _ = searched(spark, sf_dir, TOP_K * rt.OVERFETCH)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def selected(spark, sf_dir):
    ranked, stored = searched(spark, sf_dir, TOP_K * rt.OVERFETCH)
    slim = stored.select("chunk_id", "document_id", "chunk_index", "content")
    listed = ranked.join(slim, "chunk_id").withColumn("words", tx.word_set(F.col("content"))).drop("content")
    kept = rt.suppress_duplicates(listed, TOP_K)
    return kept.join(ranked.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"]), stored


@query(
    "evidence_without_near_copies",
    RP
    + """SELECT query_id, rank, 'evidence_' || substr(sha256(query_id || ':' || chunk_id), 1, 20) AS evidence_id, chunk_id, document_id, source_id,
  greatest(-1, least(1, score)) AS retrieval_score FROM chosen""",
)
def evidence_without_near_copies(spark, sf_dir):
    kept, stored = selected(spark, sf_dir)
    found = rt.to_evidence(kept, stored)
    return found.select("query_id", "rank", "evidence_id", "chunk_id", "document_id", "source_id", "retrieval_score")


@query(
    "evidence_rows",
    RP
    + """SELECT 'evidence_' || substr(sha256(query_id || ':' || chunk_id), 1, 20) AS evidence_id, query_id, chunk_id, source_id, source_tier,
  greatest(-1, least(1, score)) AS retrieval_score FROM chosen""",
)
def evidence_rows(spark, sf_dir):
    found = rt.to_evidence(*selected(spark, sf_dir))
    return found.select("evidence_id", "query_id", "chunk_id", "source_id", "source_tier", "retrieval_score")


@query(
    "retrieval_stats",
    RP
    + f""", top AS (SELECT * FROM chosen),
by_tier AS (SELECT query_id, '{{' || string_agg('"' || source_tier || '":' || n, ',' ORDER BY source_tier) || '}}' AS source_tiers FROM (SELECT query_id, source_tier, count(*) AS n FROM top GROUP BY 1, 2) GROUP BY 1),
by_type AS (SELECT query_id, '{{' || string_agg('"' || document_type || '":' || n, ',' ORDER BY document_type) || '}}' AS document_types FROM (SELECT query_id, document_type, count(*) AS n FROM top GROUP BY 1, 2) GROUP BY 1)
SELECT query_id, CAST(count(*) AS BIGINT) AS returned, any_value(source_tiers) AS source_tiers, any_value(document_types) AS document_types,
  string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM top JOIN by_tier USING (query_id) JOIN by_type USING (query_id) GROUP BY 1""",
)
def retrieval_stats(spark, sf_dir):
    return rt.retrieval_stats(rt.to_evidence(*selected(spark, sf_dir)))


CASE_METRICS_SQL = f"""res AS (SELECT * FROM chosen),
hits AS (SELECT c.query_id AS case_id, c.answerable, c.expected_sources, r.rank, r.source_id,
                CASE WHEN len(c.expected_sources) > 0 THEN list_contains(c.expected_sources, r.source_id) ELSE list_contains(c.expected_types, r.document_type) END AS hit
         FROM cases c LEFT JOIN res r USING (query_id)),
per_case AS (
  SELECT case_id, any_value(answerable) AS answerable, CAST(count(rank) AS BIGINT) AS returned, min(rank) FILTER (hit) AS first_relevant_rank,
    {", ".join(f'''CAST(coalesce(min(rank) FILTER (hit) <= {k}, FALSE) AS DOUBLE) AS hit_at_{k},
    CASE WHEN len(any_value(expected_sources)) > 0 THEN count(DISTINCT source_id) FILTER (hit AND rank <= {k}) / CAST(len(list_distinct(any_value(expected_sources))) AS DOUBLE)
         ELSE CAST(coalesce(min(rank) FILTER (hit) <= {k}, FALSE) AS DOUBLE) END AS recall_at_{k}''' for k in (3, 5))}
  FROM hits GROUP BY 1)"""


def per_case(spark, sf_dir):
    found, stored = selected(spark, sf_dir)
    results = found.join(stored.select("chunk_id", "source_id", "document_type"), "chunk_id")
    labelled = cases(spark, sf_dir).select(F.col("query_id").alias("case_id"), "answerable", "expected_sources", "expected_types")
    return rt.case_metrics(results, labelled)


M = RP.rstrip() + ",\n" + CASE_METRICS_SQL + "\n"


@query(
    "case_metrics",
    M
    + "SELECT case_id, answerable, returned, first_relevant_rank, hit_at_3, round(recall_at_3, 6) AS recall_at_3, hit_at_5, round(recall_at_5, 6) AS recall_at_5 FROM per_case",
)
def case_metrics(spark, sf_dir):
    out = per_case(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in ("recall_at_3", "recall_at_5")})


@query(
    "retrieval_metrics",
    M
    + """SELECT CAST(count(*) AS BIGINT) AS case_count, CAST(count(*) FILTER (answerable) AS BIGINT) AS answerable_case_count,
  CAST(count(*) FILTER (NOT answerable) AS BIGINT) AS unanswerable_case_count, round(avg((returned = 0)::INT), 9) AS empty_result_rate,
  round(avg(coalesce(1.0 / first_relevant_rank, 0)) FILTER (answerable), 9) AS mrr,
  round(avg(hit_at_3) FILTER (answerable), 9) AS hit_at_3, round(avg(recall_at_3) FILTER (answerable), 9) AS recall_at_3,
  round(avg(hit_at_5) FILTER (answerable), 9) AS hit_at_5, round(avg(recall_at_5) FILTER (answerable), 9) AS recall_at_5 FROM per_case""",
)
def retrieval_metrics(spark, sf_dir):
    out = rt.retrieval_metrics(per_case(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if not c.endswith("count")})


@query(
    "failing_cases",
    M
    + """SELECT case_id, CASE WHEN answerable THEN 'missed' ELSE 'unanswerable_nonempty' END AS failure FROM per_case
WHERE (answerable AND hit_at_5 = 0) OR (NOT answerable AND returned > 0)""",
)
def failing_cases(spark, sf_dir):
    return rt.failing_cases(per_case(spark, sf_dir))


@query(
    "filtered_chunks",
    with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL)
    + """SELECT source_id, source_tier, CAST(count(*) AS BIGINT) AS n FROM chunks
WHERE source_id IN ('src3', 'src4', 'src5') AND source_tier <= 2 AND document_type = 'en' GROUP BY 1, 2""",
)
def filtered_chunks(spark, sf_dir):
    wanted = rt.narrow_filter(
        {"knowledge_pack_id": "pack", "component": "bearing", "source_tier_lte": 2, "source_id_in": SOURCES_A},
        {"source_id_in": ["src3", "src4", "src5", "src19"], "document_type": "en", "source_tier_lte": 3},
    )
    wanted["source_id_in"] = [s for s in wanted["source_id_in"]]
    only = {k: v for k, v in wanted.items() if k not in rt.BOUNDARY_FIELDS}
    chunks = document_chunks(spark, sf_dir).filter(rt.compile_filter(only))
    return chunks.groupBy("source_id", "source_tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "narrowed_filters",
    f"""SELECT s_suppkey, len(list_intersect({LIST_SQL['A']}, req)) = 0 AS rejected,
  array_to_string(list_sort(list_intersect({LIST_SQL['A']}, req)), ',') AS sources, CAST(least(2, 1 + s_suppkey % 4) AS BIGINT) AS max_tier
FROM (SELECT s_suppkey, ['src' || (s_suppkey % 20), 'src' || (s_nationkey % 20)] AS req FROM supplier)""",
)
def narrowed_filters(spark, sf_dir):
    key = F.col("s_suppkey")
    requests = views.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.array(*[F.lit(s) for s in SOURCES_A]).alias("allowed"),
        F.array(F.concat(F.lit("src"), (key % 20).cast("string")), F.concat(F.lit("src"), (F.col("s_nationkey") % 20).cast("string"))).alias("requested"),
        F.lit(2).cast("bigint").alias("base_tier"),
        (1 + key % 4).cast("bigint").alias("requested_tier"),
    )
    return rt.narrow_columns(requests).select(
        "s_suppkey", "rejected", F.array_join(F.array_sort("sources"), ",").alias("sources"), "max_tier"
    )


@query(
    "query_ids",
    f"""SELECT item_id, 'query_' || substr(sha256('{{"filters":{{"component":"bearing","knowledge_pack_id":"pack","source_id_in":["src1","src2"],"source_tier_lte":2}},"mode":"DIAGNOSTIC","purpose":"INSPECTION_ACTION","query_text":"'
  || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '","top_k":5}}'), 1, 20) AS query_id FROM benchmark""",
)
def query_ids(spark, sf_dir):
    filters = F.struct(
        F.lit("bearing").alias("component"),
        F.lit("pack").alias("knowledge_pack_id"),
        F.array(F.lit("src1"), F.lit("src2")).alias("source_id_in"),
        F.lit(2).alias("source_tier_lte"),
    )
    return views.table(spark, sf_dir, "benchmark").select(
        "item_id",
        rt.query_identifier(filters, F.lit("DIAGNOSTIC"), F.lit("INSPECTION_ACTION"), tx.squeeze(F.col("text")), F.lit(5)).alias("query_id"),
    )


# -- signed gram vectors, abstention and calibration ---------------------------------------------

SCOPE_TERMS = ("token", "ungen")
CLAIM_TERMS = ("heit und", "ciónes")
THRESHOLD = 0.25

GRAM_TOP_SQL = r"""bq AS (SELECT 'case_' || item_id AS query_id, text AS question, lower(text) AS n, regexp_replace(lower(text), '\s+', '', 'g') AS d FROM benchmark),
bg AS (
  SELECT query_id, 'w:' || unnest(regexp_extract_all(n, '[0-9a-z가-힣_]+')) AS g FROM bq
  UNION ALL SELECT query_id, 'c2:' || d[i:i + 1] FROM (SELECT query_id, d, unnest(range(1, length(d))) AS i FROM bq)
  UNION ALL SELECT query_id, 'c3:' || d[i:i + 2] FROM (SELECT query_id, d, unnest(range(1, length(d) - 1)) AS i FROM bq)
  UNION ALL SELECT query_id, 'c4:' || d[i:i + 3] FROM (SELECT query_id, d, unnest(range(1, length(d) - 2)) AS i FROM bq)),
bv AS (SELECT query_id, ('0x' || substr(sha256(g), 1, 8))::BIGINT % 512 AS bucket,
         sum(CASE WHEN ('0x' || substr(sha256(g), 9, 2))::BIGINT & 1 = 1 THEN 1 ELSE -1 END) AS weight FROM bg GROUP BY 1, 2),
bn AS (SELECT query_id, sqrt(sum(weight * weight)) AS n FROM bv GROUP BY 1), gn AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS n FROM gram_buckets GROUP BY 1),
gd AS (SELECT query_id, chunk_id, sum(bv.weight * g.weight) AS d FROM bv JOIN gram_buckets g USING (bucket) GROUP BY 1, 2),
gs AS (SELECT query_id, chunk_id, round(coalesce(d, 0) / (bn.n * gn.n), 9) AS score FROM bn CROSS JOIN gn LEFT JOIN gd USING (query_id, chunk_id)),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gs)"""

G = with_views(GRAMS_SQL, GRAM_TOP_SQL)


def gram_questions(spark, sf_dir):
    return views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("case_"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("question")
    )


def gram_searched(spark, sf_dir, asked, k):
    vectors = rt.with_norm(turns(spark, sf_dir).withColumn("vector", gram_vector("text"))).withColumns(
        {"source_id": F.lit("turns"), "source_tier": F.lit(1)}
    )
    wanted = rt.with_norm(asked.withColumn("vector", gram_vector("question"))).withColumns(
        {"max_tier": F.lit(4), "sources": F.lit(None).cast("array<string>")}
    )
    return rt.vector_topk(wanted, vectors, k)


@query(
    "gram_topk",
    G + "SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM gr WHERE rank <= 3",
)
def gram_topk(spark, sf_dir):
    ranked = gram_searched(spark, sf_dir, gram_questions(spark, sf_dir), 3)
    return ranked.select("query_id", "chunk_id", "score", "rank")


POLICY_SQL = f"""CASE WHEN {" OR ".join(f"contains(lower(question), '{t}')" for t in SCOPE_TERMS)} THEN 'OUT_OF_SCOPE'
  WHEN {" OR ".join(f"contains(lower(question), '{t}')" for t in CLAIM_TERMS)} THEN 'INSUFFICIENT_EVIDENCE' END"""


@query(
    "answer_statuses",
    G
    + f""", p AS (SELECT query_id, {POLICY_SQL} AS policy FROM bq),
t AS (SELECT query_id, max(score) AS top, count(*) FILTER (score >= {THRESHOLD}) AS acc FROM gr WHERE rank <= 3 GROUP BY 1)
SELECT query_id, coalesce(policy, CASE WHEN acc > 0 THEN 'EVIDENCE_FOUND' ELSE 'INSUFFICIENT_EVIDENCE' END) AS status,
  CAST(CASE WHEN policy IS NULL THEN coalesce(acc, 0) ELSE 0 END AS BIGINT) AS accepted, CASE WHEN policy IS NULL THEN round(coalesce(top, 0), 8) END AS top_score
FROM p LEFT JOIN t USING (query_id)""",
)
def answer_statuses(spark, sf_dir):
    """Only the questions that no policy answers are searched."""
    asked = rt.abstain(gram_questions(spark, sf_dir), SCOPE_TERMS, CLAIM_TERMS)
    ranked = gram_searched(spark, sf_dir, asked.filter(F.col("policy").isNull()), 3)
    return rt.answer_status(asked, ranked, THRESHOLD)


@query(
    "calibrated_threshold",
    """WITH s AS (SELECT quality = 1 AS supported, CASE WHEN quality = 1 THEN 0.4 + (doc_id % 100) / 200.0 ELSE (doc_id % 100) / 300.0 END AS score FROM labels)
SELECT round(min(score) FILTER (supported), 8) AS supported_floor, round(max(score) FILTER (NOT supported), 8) AS unsupported_ceiling,
  round((min(score) FILTER (supported) + max(score) FILTER (NOT supported)) / 2, 8) AS threshold FROM s""",
)
def calibrated_threshold(spark, sf_dir):
    part = F.col("doc_id") % 100
    good = F.col("quality") == 1
    scores = views.table(spark, sf_dir, "labels").select(
        good.alias("supported"), F.when(good, 0.4 + part / 200.0).otherwise(part / 300.0).alias("score")
    )
    out = rt.calibrate(scores)
    return out.withColumns({c: F.round(c, 8) for c in ("supported_floor", "unsupported_ceiling")})


@query(
    "evidence_union",
    with_views(views.EVIDENCE_SQL)
    + """SELECT run_id, chunk_id, purpose, query_ordinal, round(score, 6) AS score, source_tier FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY query_ordinal, score DESC, tie) AS r FROM evidence) WHERE r = 1""",
)
def evidence_union(spark, sf_dir):
    out = rt.union_evidence(views.evidence(spark, sf_dir))
    return out.select("run_id", "chunk_id", "purpose", "query_ordinal", F.round("score", 6).alias("score"), "source_tier")


@query(
    "stored_roles",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'r' || s_nationkey ELSE 'a,r' || s_nationkey END AS roles FROM supplier""",
)
def stored_roles(spark, sf_dir):
    key, nation = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    raw = (
        F.when(key == 0, "not json")
        .when(key == 1, F.concat(F.lit('["r'), nation, F.lit('"]')))
        .otherwise(F.concat(F.lit('["a", "r'), nation, F.lit('"]')))
    )
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(rt.parse_roles(raw), ",").alias("roles"))
