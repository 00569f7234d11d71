"""Queries over documents: blocks, chunks, catalog and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.blocks import clean_text, page_blocks as page_blocks_of
from plumbline.functions.hashing import gram_vector, word_vector
from plumbline.operators import chunks as ch, queries as qb
from plumbline.plans import views
from plumbline.plans.registry import query, with_views

LINES_PER_PAGE = 20


def clean_sql(raw: str) -> str:
    word = r"[\p{L}\p{N}_]"
    steps = [
        (rf"({word})-\n({word})", r"\1\2"),
        (r"[ \t]*\n[ \t]*", r"\n"),
        (r"[ \t]+", " "),
        (r"^\s+|\s+$", ""),
    ]
    out = raw
    for pattern, target in steps:
        replacement = "chr(10)" if target == r"\n" else f"'{target}'"
        out = f"regexp_replace({out}, '{pattern}', {replacement}, 'g')"
    out = f"regexp_replace({out}, '\\n\\n+', chr(1), 'g')"
    return f"replace(replace({out}, chr(10), ' '), chr(1), chr(10) || chr(10))"


DOCS_SQL = """docs AS (SELECT 'doc_' || doc_id AS document_id, source AS source_id, lang AS document_type,
  CAST(1 + doc_id % 4 AS BIGINT) AS source_tier, text AS raw_text FROM documents)"""

PAGES_SQL = f"""doc_lines AS (
  SELECT document_id, source_id, document_type, source_tier, i, ls[i + 1] AS line,
         trim(regexp_replace(ls[i + 1], '\\s+', ' ', 'g')) AS flat
  FROM (SELECT *, string_split(raw_text, chr(10)) AS ls FROM docs), LATERAL (SELECT unnest(range(0, len(ls))) AS i)),
raw_pages AS (
  SELECT document_id, source_id, document_type, source_tier, i // {LINES_PER_PAGE} + 1 AS page, string_agg(line, chr(10) ORDER BY i) AS raw,
         arg_min(flat, i) FILTER (length(flat) BETWEEN 3 AND 120 AND right(flat, 1) NOT IN ('.', ',', ';')) AS section
  FROM doc_lines GROUP BY ALL),
blocks AS (SELECT * EXCLUDE (raw), {clean_sql('raw')} AS text FROM raw_pages WHERE {clean_sql('raw')} <> '')"""

CHUNKS_SQL = r"""chunk_rows AS (
  SELECT document_id, source_id, document_type, source_tier, page, section, s, array_to_string(words[s + 1:s + 800], ' ') AS content,
         CAST(least(800, n - s) AS BIGINT) AS tokens
  FROM (SELECT *, len(words) AS n FROM (SELECT *, regexp_extract_all(text, '\S+') AS words FROM blocks)),
       LATERAL (SELECT unnest(range(0, greatest(n - 101, 0) + 1, 700)) AS s)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, s) - 1 AS BIGINT) AS chunk_index FROM chunk_rows),
chunks AS (SELECT *, document_id || ':p' || lpad(CAST(page AS VARCHAR), 4, '0') || ':s' || substr(sha1(coalesce(section, 'unsectioned')), 1, 8)
  || ':c' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') AS chunk_id FROM numbered)"""

D = with_views(DOCS_SQL)
P = with_views(DOCS_SQL, PAGES_SQL)
C = with_views(DOCS_SQL, PAGES_SQL, CHUNKS_SQL)


def documents(spark, sf_dir):
    doc = F.col("doc_id")
    return views.spread(views.table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("doc_"), doc.cast("string")).alias("document_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("document_type"),
        (1 + doc % 4).cast("bigint").alias("source_tier"),
        F.col("text").alias("raw_text"),
    )


def with_pages(docs):
    """Page texts of every document, twenty lines each, in an array column."""
    last = F.floor((F.size("_lines") - 1) / LINES_PER_PAGE).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice("_lines", p * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n")
    )
    return docs.withColumn("_lines", tx.lines(F.col("raw_text"))).withColumn("_pages", pages).drop("raw_text", "_lines")


def document_chunks(spark, sf_dir, wanted=None):
    """Chunks of the documents that pass ``wanted``, a condition on their metadata below the chunking."""
    docs = documents(spark, sf_dir)
    docs = with_pages(docs if wanted is None else docs.filter(wanted))
    return ch.chunk_documents(docs, page_blocks_of(F.col("_pages"))).drop("_pages")


@query(
    "page_blocks",
    P + "SELECT document_id, CAST(page AS BIGINT) AS page, section, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n FROM blocks",
)
def page_blocks(spark, sf_dir):
    docs = with_pages(documents(spark, sf_dir))
    rows = docs.select("document_id", F.inline_outer(page_blocks_of(F.col("_pages")))).filter("page IS NOT NULL")
    return rows.select(
        "document_id",
        F.col("page").cast("bigint").alias("page"),
        "section",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("n"),
    )


@query(
    "cleaned_documents",
    D + f"SELECT document_id, md5({clean_sql('raw_text')}) AS clean_md5, CAST(length({clean_sql('raw_text')}) AS BIGINT) AS n FROM docs",
)
def cleaned_documents(spark, sf_dir):
    clean = clean_text(F.col("raw_text"))
    return documents(spark, sf_dir).select("document_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("bigint").alias("n"))


@query(
    "merged_line_blocks",
    P
    + """, keyed AS (SELECT document_id, i, i // 20 + 1 AS page, CASE WHEN length(line) < 60 THEN 'short' ELSE 'long' END AS section, line FROM doc_lines),
flagged AS (SELECT *, CASE WHEN lag(page) OVER d IS NOT DISTINCT FROM page AND lag(section) OVER d IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS f
  FROM keyed WINDOW d AS (PARTITION BY document_id ORDER BY i)),
isl AS (SELECT *, sum(f) OVER (PARTITION BY document_id ORDER BY i) AS g FROM flagged)
SELECT document_id, CAST(g AS BIGINT) AS block, CAST(any_value(page) AS BIGINT) AS page, any_value(section) AS section, CAST(count(*) AS BIGINT) AS parts,
  md5(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM isl GROUP BY 1, 2""",
)
def merged_line_blocks(spark, sf_dir):
    blocks = F.transform(
        tx.lines(F.col("raw_text")),
        lambda s, i: F.struct(
            (F.floor(i / LINES_PER_PAGE) + 1).alias("page"),
            F.when(F.length(s) < 60, "short").otherwise("long").alias("section"),
            s.alias("text"),
        ),
    )
    rows = ch.with_merged_blocks(documents(spark, sf_dir).withColumn("_b", blocks), "_b")
    merged = rows.select("document_id", F.posexplode_outer("_b").alias("i", "m"))
    return merged.select(
        "document_id",
        (F.col("i") + 1).cast("bigint").alias("block"),
        F.col("m.page").cast("bigint").alias("page"),
        F.col("m.section").alias("section"),
        F.size(F.split("m.text", "\n\n")).cast("bigint").alias("parts"),
        F.md5("m.text").alias("text_md5"),
    )


@query(
    "document_chunks",
    C + "SELECT chunk_id, document_id, chunk_index, CAST(page AS BIGINT) AS page, tokens, md5(content) AS content_md5 FROM chunks",
)
def document_chunks_query(spark, sf_dir):
    return document_chunks(spark, sf_dir).select(
        "chunk_id", "document_id", "chunk_index", F.col("page").cast("bigint").alias("page"), "tokens", F.md5("content").alias("content_md5")
    )


@query(
    "chunk_stats",
    C
    + """SELECT document_id, CAST(count(*) AS BIGINT) AS chunk_count, min(tokens) AS min_tokens, max(tokens) AS max_tokens,
  round(avg(tokens), 6) AS average_tokens, CAST(count(DISTINCT page) AS BIGINT) AS pages_with_chunks FROM chunks GROUP BY 1""",
)
def chunk_stats(spark, sf_dir):
    return ch.chunk_stats(document_chunks(spark, sf_dir)).withColumn("average_tokens", F.round("average_tokens", 6))


@query(
    "sample_chunks",
    C
    + """SELECT document_id, arg_max(chunk_id, r) AS chunk_id, arg_max(tokens, r) AS tokens
FROM (SELECT *, (page >= 5)::INT * 1000000000000 + tokens * 1000000 - chunk_index AS r FROM chunks) GROUP BY 1""",
)
def sample_chunks(spark, sf_dir):
    return ch.sample_chunks(document_chunks(spark, sf_dir))


ROLES_SQL = "CASE source_tier WHEN 1 THEN ['diagnosis', 'inspection'] WHEN 2 THEN ['diagnosis'] WHEN 3 THEN ['context'] ELSE [] END"


def with_roles(chunks):
    tier = F.col("source_tier")
    none = F.array().cast("array<string>")
    return chunks.withColumn(
        "rag_roles",
        F.when(tier == 1, F.array(F.lit("diagnosis"), F.lit("inspection")))
        .when(tier == 2, F.array(F.lit("diagnosis")))
        .when(tier == 3, F.array(F.lit("context")))
        .otherwise(none),
    )


@query(
    "ingestion_report",
    C
    + f"""SELECT 'document_type' AS facet, document_type AS value, CAST(count(*) AS BIGINT) AS n FROM chunks GROUP BY 2
UNION ALL SELECT 'source_tier', CAST(source_tier AS VARCHAR), count(*) FROM chunks GROUP BY 2
UNION ALL SELECT 'rag_role', r, count(*) FROM (SELECT unnest({ROLES_SQL}) AS r FROM chunks) GROUP BY 2
UNION ALL SELECT 'source_status', CASE WHEN s_acctbal < 0 THEN 'MISSING' ELSE 'READY' END, count(*) FROM supplier GROUP BY 2""",
)
def ingestion_report(spark, sf_dir):
    statuses = views.table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_acctbal") < 0, "MISSING").otherwise("READY").alias("status")
    )
    return ch.ingestion_facets(with_roles(document_chunks(spark, sf_dir)), statuses)


@query(
    "knowledge_summary",
    C + "SELECT CAST(count(DISTINCT document_id) AS BIGINT) AS document_count, CAST(count(*) AS BIGINT) AS chunk_count, 'hashed-words' AS embedding_method FROM chunks",
)
def knowledge_summary(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).withColumn("embedding_model", F.lit("hashed-words"))
    return ch.knowledge_summary(chunks, "default-model")


@query(
    "document_catalog",
    C
    + """, listed AS (SELECT 'doc_' || doc_id AS document_id, 'Labelled ' || doc_id AS title, 'publisher ' || quality AS publisher, 'open' AS license FROM labels)
SELECT document_id, coalesce(any_value(title), document_id) AS title, coalesce(any_value(publisher), any_value(source_id)) AS publisher,
  any_value(document_type) AS document_type, coalesce(any_value(license), '') AS license, CAST(count(*) AS BIGINT) AS chunk_count,
  CAST(count(DISTINCT page) AS BIGINT) AS indexed_pages
FROM chunks LEFT JOIN (SELECT document_id, any_value(title) AS title, any_value(publisher) AS publisher, any_value(license) AS license FROM listed GROUP BY 1) USING (document_id) GROUP BY 1""",
)
def document_catalog(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).withColumns({"title": F.col("document_id"), "publisher": F.col("source_id")})
    doc = F.col("doc_id").cast("string")
    listed = views.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), doc).alias("document_id"),
        F.concat(F.lit("Labelled "), doc).alias("title"),
        F.concat(F.lit("publisher "), F.col("quality").cast("string")).alias("publisher"),
        F.lit(None).cast("string").alias("document_type"),
        F.lit("open").alias("license"),
    )
    return ch.catalog(chunks, listed)


@query(
    "catalog_first_page",
    C
    + """SELECT document_id, source_id AS publisher, CAST(count(*) AS BIGINT) AS chunk_count FROM chunks GROUP BY 1, 2
ORDER BY lower(source_id), lower(document_id), document_id LIMIT 50""",
)
def catalog_first_page(spark, sf_dir):
    """A top-of-list report: the first fifty catalog entries."""
    chunks = document_chunks(spark, sf_dir).withColumns({"title": F.col("document_id"), "publisher": F.col("source_id")})
    none = chunks.select("document_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "publisher", "document_type", "license")])
    listing = ch.catalog_order(ch.catalog(chunks, none.filter(F.col("title").isNotNull())))
    return listing.select("document_id", "publisher", "chunk_count").limit(50)


@query(
    "word_vectors",
    C
    + r""", w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}') AS t FROM chunks),
hs AS (SELECT chunk_id, list_transform(t, lambda x: ('0x' || substr(sha256(x), 1, 8))::BIGINT) AS h FROM w),
grams AS (SELECT chunk_id, unnest(h || list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % 4294967296)) AS g FROM hs)
SELECT chunk_id, g % 384 AS bucket, CAST(count(*) AS BIGINT) AS weight FROM grams GROUP BY 1, 2""",
)
def word_vectors(spark, sf_dir):
    rows = document_chunks(spark, sf_dir).select("chunk_id", F.posexplode_outer(word_vector("content")).alias("bucket", "weight"))
    return rows.filter(F.col("weight") != 0).select(
        "chunk_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("weight").cast("bigint").alias("weight")
    )


GRAMS_SQL = r"""turns AS (SELECT 'turn_' || conv_id || '_' || turn AS chunk_id, lower(text) AS n, regexp_replace(lower(text), '\s+', '', 'g') AS d FROM conversations),
all_grams AS (
  SELECT chunk_id, 'w:' || unnest(regexp_extract_all(n, '[0-9a-z가-힣_]+')) AS g FROM turns
  UNION ALL SELECT chunk_id, 'c2:' || d[i:i + 1] FROM (SELECT chunk_id, d, unnest(range(1, length(d))) AS i FROM turns)
  UNION ALL SELECT chunk_id, 'c3:' || d[i:i + 2] FROM (SELECT chunk_id, d, unnest(range(1, length(d) - 1)) AS i FROM turns)
  UNION ALL SELECT chunk_id, 'c4:' || d[i:i + 3] FROM (SELECT chunk_id, d, unnest(range(1, length(d) - 2)) AS i FROM turns)),
gram_buckets AS (
  SELECT chunk_id, ('0x' || substr(sha256(g), 1, 8))::BIGINT % 512 AS bucket,
         sum(CASE WHEN ('0x' || substr(sha256(g), 9, 2))::BIGINT & 1 = 1 THEN 1 ELSE -1 END) AS weight
  FROM all_grams GROUP BY 1, 2)"""


def turns(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text"
    )


@query("gram_vectors", with_views(GRAMS_SQL) + "SELECT chunk_id, bucket, CAST(weight AS BIGINT) AS weight FROM gram_buckets WHERE weight <> 0")
def gram_vectors(spark, sf_dir):
    rows = turns(spark, sf_dir).select("chunk_id", F.posexplode_outer(gram_vector("text")).alias("bucket", "weight"))
    return rows.filter(F.col("weight") != 0).select(
        "chunk_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("weight").cast("bigint").alias("weight")
    )


@query(
    "packed_sentences",
    D
    + r""", parts AS (SELECT document_id, list_filter(list_transform(string_split(regexp_replace(raw_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM docs),
packed AS (SELECT document_id, list_reduce(ss, lambda acc, s: CASE
    WHEN length(string_split(acc, chr(2))[-1]) + length(s) + 1 > 600 THEN acc || chr(2) || s ELSE acc || ' ' || s END) AS p FROM parts WHERE len(ss) > 0)
SELECT document_id, CAST(i AS BIGINT) AS piece, md5(string_split(p, chr(2))[i]) AS piece_md5
FROM packed, LATERAL (SELECT unnest(range(1, len(string_split(p, chr(2))) + 1)) AS i)""",
)
def packed_sentences(spark, sf_dir):
    rows = documents(spark, sf_dir).select("document_id", F.posexplode_outer(tx.pack_sentences(F.col("raw_text"))).alias("i", "p"))
    return rows.filter("i IS NOT NULL").select("document_id", (F.col("i") + 1).cast("bigint").alias("piece"), F.md5("p").alias("piece_md5"))


@query(
    "excerpts",
    D
    + """SELECT document_id, md5(CASE WHEN length(raw_text) <= 650 THEN raw_text ELSE rtrim(substr(raw_text, 1, 650)) || '...' END) AS excerpt_md5,
  regexp_replace(regexp_replace(lower(document_type || ' / ' || source_id), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM docs""",
)
def excerpts(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "document_id",
        F.md5(tx.excerpt(F.col("raw_text"))).alias("excerpt_md5"),
        tx.slug(F.concat_ws(" / ", "document_type", "source_id")).alias("slug"),
    )


@query(
    "verified_excerpts",
    C
    + r"""SELECT chunk_id, contains(regexp_replace(b.text, '\s+', ' ', 'g'), rtrim(substr(c.content, 1, 650))) AS found
FROM chunks c JOIN blocks b ON b.document_id = c.document_id AND b.page = c.page""",
)
def verified_excerpts(spark, sf_dir):
    """Each excerpt must occur in the page it cites."""
    pages = with_pages(documents(spark, sf_dir)).select("document_id", F.inline_outer(page_blocks_of(F.col("_pages"))))
    shown = F.regexp_replace(tx.excerpt(F.col("content")), r"\.\.\.$", "")
    cited = document_chunks(spark, sf_dir).select("chunk_id", "document_id", "page", shown.alias("shown"))
    return cited.join(pages.drop("section"), ["document_id", "page"]).select(
        "chunk_id", F.contains(tx.squeeze(F.col("text")), F.col("shown")).alias("found")
    )


@query(
    "translated_questions",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'bearing outer race damage vibration characteristics'
  WHEN 'LARGE' THEN 'outer race damage ' || p_name WHEN 'SMALL' THEN 'bearing ' || p_name || ' 소음' ELSE p_name END AS search_query,
  CASE p_type WHEN 'ECONOMY' THEN 'RULE_DICTIONARY' WHEN 'LARGE' THEN 'RULE_DICTIONARY' WHEN 'SMALL' THEN 'SAFE_FALLBACK' ELSE 'DIRECT' END AS method,
  CASE p_type WHEN 'ECONOMY' THEN 'ko' WHEN 'LARGE' THEN 'mixed' WHEN 'SMALL' THEN 'mixed' ELSE 'en' END AS language,
  p_type IN ('ECONOMY', 'LARGE', 'SMALL') AS translated, p_type <> 'SMALL' AS complete,
  CASE p_type WHEN 'SMALL' THEN '소음' ELSE '' END AS unmapped FROM part""",
)
def translated_questions(spark, sf_dir):
    kind, name = F.col("p_type"), F.col("p_name")
    asked = views.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == "ECONOMY", "베어링  외륜 손상의 주요 진동 특징은?")
        .when(kind == "LARGE", F.concat(F.lit("외륜 손상 "), name, F.lit("?")))
        .when(kind == "SMALL", F.concat(F.lit("베어링 "), name, F.lit(" 소음")))
        .otherwise(name)
        .alias("question"),
    )
    return qb.translate(asked).drop("question")


@query(
    "purpose_texts",
    with_views(views.RUNS_SQL)
    + f"""SELECT run_id, purpose, CASE purpose WHEN 'DATASET_EVIDENCE' THEN '{qb.DATASET_PHRASE} analysis status ' || analysis_status
    WHEN 'DIAGNOSTIC_EVIDENCE' THEN '{qb.DIAGNOSTIC_PHRASE} analysis status ' || analysis_status || ' predicted class ' || predicted_class
      || ' signal feature peak ' || format('{{:.6g}}', rms * 1000 + 0.25) || ' signal feature rms ' || format('{{:.6g}}', rms)
    ELSE '{qb.INSPECTION_PHRASE} analysis status ' || analysis_status || ' predicted class ' || predicted_class END
  || ' operating condition ' || condition AS query_text
FROM runs, (VALUES ('DATASET_EVIDENCE'), ('DIAGNOSTIC_EVIDENCE'), ('INSPECTION_ACTION')) p(purpose)""",
)
def purpose_texts(spark, sf_dir):
    rows = views.runs(spark, sf_dir).withColumn(
        "purpose", F.explode(F.array(*[F.lit(p) for p in ("DATASET_EVIDENCE", "DIAGNOSTIC_EVIDENCE", "INSPECTION_ACTION")]))
    )
    features = F.create_map(F.lit("rms"), F.col("rms"), F.lit("peak"), F.col("rms") * 1000 + 0.25)
    text = qb.purpose_text(F.col("purpose"), F.col("analysis_status"), F.col("predicted_class"), F.col("condition"), features)
    return rows.select("run_id", "purpose", text.alias("query_text"))
