"""Filter interaction audit: what each of five filters removes under every order of them.

Contract: a document (null text: empty) fails a filter when: A, it has under 200 words (maximal runs
without ASCII white space, case-sensitive); B, under half of its words are distinct; C, over 2 % of its
code points are A-Z; D, it holds one of ``# $ % & * |``; E, a smaller doc_id of the whole table has the
same text, whatever filter meets either of them. The result has one row per part (each source; null is
the part of the empty string), per order of the filters and per step of it, zeros included. All counts
are of rows, so repeated rows count each; rows that repeat one doc_id and text are no copies of each
other. A row without doc_id is no copy and no original, and has no label. Of contradicting label rows of
a document the larger counts. Extra columns are ignored; an empty table has no parts and gives no rows.

Method: a document is the mask of the filters that it fails. Texts travel as digests; the first document
of a text is a minimum per digest, which returns to its one document by (digest, doc_id), so a text with
very many copies is spread over its copies' ids. Masks are counted per part before anything else: at most
32 cells a part remain. Each cell folds its mask over the array of all orders, one constant that
every task has, with ``transform`` and ``aggregate``: 600 structs weighted by the cell's counts. The cells
of a part are merged by sums of equal places.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Fixed: the separators of words and the signs of filter D.
SEPARATORS = r"[\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"
BITS = {name: 1 << place for place, name in enumerate(FILTERS)}
ORDERS = ["".join(order) for order in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit_if(failed: Column, name: str) -> Column:
    return F.when(failed, BITS[name]).otherwise(0)


def text_mask(text: Column, words: Column) -> Column:
    """Mask of the filters that look at one text alone."""
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return (
        bit_if(n < LEAST_WORDS, "A")
        + bit_if(100 * F.size(F.array_distinct(words)) < 50 * n, "B")
        + bit_if(100 * capitals.cast("long") > 2 * F.char_length(text), "C")
        + bit_if(text.rlike(SIGNS), "D")
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    worded = texts.withColumn("words", F.filter(F.split("text", SEPARATORS), lambda word: word != ""))
    facts = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    facts = stored(facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    firsts = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = stored(facts.alias("f").join(firsts.alias("o"), F.expr("f.digest = o.digest AND f.doc_id = o.first_id"), "left").select("f.*", "first_id"))
    known = known.join(stored(marks), F.col("doc_id") == F.col("label_id"), "left")
    copied = F.col("first_id").isNull() & F.col("doc_id").isNotNull()
    masked = known.withColumn("mask", F.col("mask") + bit_if(copied, "E"))
    weighted = [F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(name)), F.lit(0)).alias(name) for name in ("good", "toxic"))]
    return masked.groupBy("part", "mask").agg(*weighted)


def orders_array() -> Column:
    """All orders as one constant: an array of arrays of filter bits."""
    return F.expr("array(" + ", ".join(f"array({', '.join(str(BITS[name]) for name in order)})" for order in ORDERS) + ")")


def folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs in order of (filter order, step): a cell's share of every count."""
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        here, before = fails & ~state["gone"], state["gone"]
        gone = before | fails
        counts = F.struct(
            F.when(gone, zero).otherwise(n).alias("kept"),
            F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & before, n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, good).otherwise(zero).alias("good_lost"),
            F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct(gone.alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    steps = "array<struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(steps).alias("steps"))
    return F.flatten(F.transform(orders_array(), lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def merged(weighted: Column) -> Column:
    """Sums of equal places over the arrays of a part's cells."""

    def plus(a: Column, b: Column) -> Column:
        return F.struct(*((a[name] + b[name]).alias(name) for name in COUNTS))

    return F.aggregate(F.slice(weighted, 2, 32), weighted[0], lambda total, one: F.zip_with(total, one, plus))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns part, filter_order, step, the counts and shapley."""
    weighted = cells(docs, labels).select("part", folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("counts"))
    gathered = weighted.groupBy("part").agg(F.collect_list("counts").alias("cells"))
    sums = gathered.select("part", F.explode_outer(F.array(merged(F.col("cells")))).alias("sums"))  # a row's sums are computed once
    placed, zero = F.flatten(orders_array()), F.lit(0).cast("long")

    def over_orders(name: str) -> Column:
        removed = F.zip_with(placed, F.col("sums.removed"), lambda bit, n: F.when(bit == BITS[name], n).otherwise(zero))
        return F.aggregate(removed, zero, lambda total, n: total + n)

    shares = F.create_map(*(part for name in FILTERS for part in (F.lit(name), over_orders(name))))
    totals = sums.select("part", shares.alias("shares"), F.posexplode("sums").alias("place", "at"))
    order = F.element_at(F.expr("array(" + ", ".join(f"'{order}'" for order in ORDERS) + ")"), (F.floor(F.col("place") / 5) + 1).cast("int"))
    rows = totals.select("part", order.alias("filter_order"), (F.col("place") % 5 + 1).cast("int").alias("step"), *(F.col(f"at.{name}").alias(name) for name in COUNTS), "shares")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return rows.select("part", "filter_order", "step", *COUNTS, F.element_at("shares", letter).alias("shapley"))


#: The same in SQL over the tables ``documents`` and ``labels``.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
marks AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS failed
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id),
cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, places, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, places[step] AS filter, n, good, toxic, failed[places[step]] AS fails_here,
    len(list_filter(places[1:step - 1], lambda p: failed[p])) > 0 AS before, len(list_filter(failed, lambda f: f)) = 1 AS alone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT before AND NOT fails_here THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails_here AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails_here AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails_here AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails_here AND NOT before THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails_here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
