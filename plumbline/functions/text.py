"""Text cleaning, tokens and deterministic ids as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPH = "\u0001"


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def short_hash(prefix: str, *parts: Column, length: int = 20, separator: str = ":") -> Column:
    """``prefix`` plus the first hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, length))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def chunk_id(document_id: Column, page: Column, section: Column, index: Column) -> Column:
    section_hash = F.substring(F.sha1(F.coalesce(section, F.lit("unsectioned")).cast("binary")), 1, 8)
    return F.concat(
        document_id,
        F.lit(":p"),
        F.lpad(F.coalesce(page, F.lit(0)).cast("string"), 4, "0"),
        F.lit(":s"),
        section_hash,
        F.lit(":c"),
        F.when(index < 10_000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")),
    )


def chunk_index(identifier: Column) -> Column:
    found = F.regexp_extract(identifier, r":c(\d+)$", 1)
    return F.when(found != "", found.cast("bigint"))


def excerpt(text: Column, limit: int = 650) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit("...")))


def ordered_distinct(*lists: Column) -> Column:
    """Values of several lists in order of first appearance; null lists and null values count for nothing."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(values, none) for values in lists])))


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))


def overlap_coefficient(left: Column, right: Column) -> Column:
    """Shared share of the smaller of two token sets."""
    smaller = F.greatest(F.lit(1), F.least(F.size(left), F.size(right)))
    return F.size(F.array_intersect(left, right)) / smaller


def sentences(text: Column) -> Column:
    """Split after sentence marks."""
    marked = F.regexp_replace(text, r"(?U)([.!?])\s+", "$1" + PARAGRAPH)
    trimmed = F.transform(F.split(marked, PARAGRAPH), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != "")


def pack_sentences(text: Column, limit: int = 600) -> Column:
    """Greedy packing of sentences into pieces of at most ``limit`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) + 1 > limit)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
        )

    def close(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(sentences(text), start, step, close)


def page_section(page: Column, bounds: dict[tuple[int, int], str], default: str) -> Column:
    """Section title of a page from inclusive page ranges."""
    out = None
    for (first, last), title in bounds.items():
        hit = page.between(first, last)
        out = F.when(hit, title) if out is None else out.when(hit, title)
    return F.lit(default) if out is None else out.otherwise(default)


@F.pandas_udf(T.StringType())
def feature_text(features: pd.Series) -> pd.Series:
    """``signal feature <name> <value>`` for every entry of a map, by name, with six significant digits."""

    def line(entries) -> str:
        return " ".join(f"signal feature {name} {value:.6g}" for name, value in sorted(dict(entries).items()))

    return features.map(line, na_action="ignore")
