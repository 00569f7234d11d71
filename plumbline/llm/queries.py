"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, filter_audit, html_wrappers, license_scan, line_dedup, packing, quality, ranked_search, sentencepiece_lattice, token_counts, topk, toxicity
from plumbline.llm.common import table
from plumbline.llm.simhash import near_copies


def vocabulary_paths() -> dict[str, str]:
    """Places of the byte-level vocabulary and its word pattern; the files stay where they are installed."""
    import public_tokenizers

    return {
        "rank_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "pattern": public_tokenizers.PATTERN,
    }


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_top_k(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of units and ids, crc32 of the ids as text, and crc32 of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), path, merges=True)
    decoded = sentencepiece_lattice.decode_rows(encoded, path)
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", "n_units", F.size("ids").cast("long").alias("n_ids"), F.crc32(ids_text).alias("ids_crc32"), F.crc32("text").alias("decoded_crc32"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.page_texts(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "p_text", "p_meta", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), **vocabulary_paths())


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarised(license_scan.scanned(table(spark, sf_dir, "documents")))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_license_scans": op12_license_scans,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": topk.SQL,
    "op8_line_dedup": line_dedup.SQL.format(ratio=line_dedup.RATIO, min_pages=line_dedup.MIN_PAGES),
    "op11_filter_interaction_audit": filter_audit.SQL,
    "op12_license_scans": license_scan.sql(),
    "op13_ranked_lexical_search": ranked_search.SQL,
}
