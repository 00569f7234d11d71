"""Ranked lexical search by dense blocked products of weights and impacts.

Contract: a text's terms are its maximal runs of digits, letters and characters beyond ASCII, A-Z
lower-cased. N is the number of documents with a term, L the number of all their terms, n that of one
document, df the number of documents that hold a term, tf its number in one document. A term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))) in doubles; a document's length factor is
m = 25 + (75 n N) div L, and a term's impact in it is (10^9 tf) div (1000 tf + 8 m). A document's score for
an item sums w times impact over the item's terms, repeats included. Each item gets the k documents of
highest score above zero, equal scores in order of doc_id. Null and empty texts have no terms: such
documents count nowhere, such items have no rows. Every document row stands for itself, so a repeated row
is ranked as often as it occurs; a document without doc_id counts like others and comes after equal scores.
Items are the different (item_id, text); a null item_id is an id like others, and texts that share an item_id
are ranked apart. Extra columns are ignored; an empty table on either side gives no rows.

Method: items are cut into blocks whose terms have a bounded size (mostly one block). A pass over the
documents keeps, of every whole text, its number of terms and the counts of the block's terms; these postings
are stored, and N, L and df are aggregated from them. In a second pass each task cuts its documents into
tiles. A tile of items has a compact vocabulary of its own; its dense matrix of weights times the dense
matrix of impacts of a document tile is one BLAS product in float64. An impact is at most 10^6, so the
columns are cut where the weights could reach 2^53 / 10^6 and every partial sum is an exact integer; partial
sums are added as 64-bit integers. A tile keeps all scores that reach its k-th one, orders ties by doc_id and
then keeps k. Documents are not shuffled; tasks hand on k rows an item, which a limited ranking merges.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, stored

TOP = 10
#: Bytes of item terms that go to all tasks at once.
BLOCK_BYTES = 8 << 20
ITEM_TILE = 256
DOCUMENT_TILE = 2048
VOCABULARY_TILE = 2048
TEXT_PART = 1 << 20
SCALE = 10**9
MOST_IMPACT = 10**6
#: Sum of weights up to which every partial sum of a product stays below 2^53.
MOST_WEIGHT = 2**53 // MOST_IMPACT - 1
#: Bytes of UTF-8 that belong to terms; A-Z become a-z, all others a space.
FOLDED = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes | None) -> Counter:
    """How often each term stands in a text; long texts are split in parts, cut between terms."""
    line, at, found = (text or b"").translate(FOLDED), 0, Counter()
    while at < len(line):
        cut = line.find(b" ", at + TEXT_PART)
        cut = len(line) if cut < 0 else cut
        found.update(line[at:cut].split())
        at = cut
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """Columns (item_id, terms, counts, bytes), one row for each different (item_id, text) that has terms."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms_of(text.as_py()).items()) for text in batch.column(1)]
            terms = pa.array([[term for term, _ in row] for row in found], pa.list_(pa.binary()))
            counts = pa.array([[count for _, count in row] for row in found], pa.list_(pa.int64()))
            size = pa.array([sum(len(term) + 16 for term, _ in row) for row in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, counts, size], names=["item_id", "terms", "counts", "bytes"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = texts.where("text IS NOT NULL").distinct()
    return rows.mapInArrow(apply, "item_id long, terms array<binary>, counts array<long>, bytes long").where("bytes > 0")


def postings(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Columns (doc_id, n, term, tf): of each document with terms, their number and the vocabulary's terms in it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = vocabulary.value
        for batch in batches:
            sizes, term, tf = [], [], []
            for text in batch.column(1):
                counts = terms_of(text.as_py())
                sizes.append(counts.total())
                held = [(index[word], count) for word, count in counts.items() if word in index]
                term.append([place for place, _ in held])
                tf.append([count for _, count in held])
            columns = [pa.array(sizes, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "term", "tf"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = texts.where("octet_length(text) > 0")
    return rows.mapInArrow(apply, "doc_id long, n long, term array<int>, tf array<long>").where("n > 0")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemTile:
    """Some items over their own compact vocabulary: sparse weights, and where the products are cut."""

    def __init__(self, first: int, rows: list[tuple[list[int], list[int]]]):
        self.first, self.size = first, len(rows)
        item = np.repeat(np.arange(len(rows)), [len(terms) for terms, _ in rows])
        self.terms, column = np.unique(np.array([t for terms, _ in rows for t in terms], np.int64), return_inverse=True)
        value = np.array([w for _, weights in rows for w in weights], np.int64)
        most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(most, column, value)
        parts = np.maximum(-(-most // MOST_WEIGHT), 1)  # a weight beyond the bound is cut in parts with columns of their own
        start = np.cumsum(parts) - parts
        part = [np.arange(parts[c]) for c in column]
        self.item = np.repeat(item, parts[column])
        self.column = np.concatenate([start[c] + p for c, p in zip(column, part)]) if len(column) else column
        self.value = np.concatenate([v // parts[c] + (p < v % parts[c]) for v, c, p in zip(value, column, part)]) if len(column) else value
        self.terms = np.repeat(self.terms, parts)
        most = np.repeat(-(-most // parts), parts)
        self.cuts, total = [0], 0
        for place, more in enumerate(most.tolist()):
            if total + more > MOST_WEIGHT or place - self.cuts[-1] == VOCABULARY_TILE:
                self.cuts.append(place)
                total = 0
            total += more
        self.cuts.append(len(self.terms))

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> np.ndarray:
        """Exact scores of the tile's items (rows) in the documents of a tile (columns)."""
        total = np.zeros((self.size, n_docs), np.int64)
        for a, b in zip(self.cuts, self.cuts[1:]):
            if a == b:
                continue
            inside = (self.column >= a) & (self.column < b)
            weights = np.zeros((self.size, b - a))
            weights[self.item[inside], self.column[inside] - a] = self.value[inside]
            place = np.full(n_terms, -1)
            place[self.terms[a:b]] = np.arange(b - a)
            at = place[term]
            known = at >= 0
            impacts = np.zeros((b - a, n_docs))
            impacts[at[known], doc[known]] = impact[known]
            for repeated in np.flatnonzero(self.terms[a : b - 1] == self.terms[a + 1 : b])[::-1]:  # parts of one weight
                impacts[repeated] = impacts[repeated + 1]
            total += (weights @ impacts).astype(np.int64)
        return total


Best = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def best_of(parts: list[Best], k: int) -> Best:
    """The k best (item, score, doc_id, known id) of every item, ties in order of doc_id."""
    item, score, doc_id, known = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort([doc_id, ~known, -score, item])
    item = item[order]
    start = np.searchsorted(item, item, side="left")
    order = order[np.arange(len(item)) - start < k]
    return tuple(np.concatenate([p[i] for p in parts])[order] for i in range(4))


def tile_best(tile: ItemTile, scores: np.ndarray, doc_id: np.ndarray, known: np.ndarray, k: int) -> Best:
    """The tile's k best documents an item: all that reach the k-th score are kept until ties are ordered."""
    floor = np.ones(len(scores), np.int64)
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    item, doc = np.nonzero(scores >= floor[:, None])
    return best_of([(item + tile.first, scores[item, doc], doc_id[doc], known[doc])], k)


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, in unbounded integers until it is divided."""
    sizes, which = np.unique(n, return_inverse=True)
    return np.array([100 - 75 + 75 * size * n_docs // n_terms for size in sizes.tolist()], np.int64)[which]


def ranked(found: DataFrame, tiles: Broadcast, n_docs: int, n_terms: int, n_known: int, k: int) -> DataFrame:
    """Columns (item, doc_id, score): each task's k best documents of every item."""

    def tile_scores(batch: pa.RecordBatch) -> Iterator[Best]:
        lists = batch.column(2), batch.column(3)
        bounds = lists[0].offsets.to_numpy()
        term, tf = (part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for part in lists)
        bounds = bounds - bounds[0]
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        doc_id = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        m = length_factors(batch.column(1).to_numpy(), n_docs, n_terms)
        impact = SCALE * tf // (1000 * tf + 8 * np.repeat(m, np.diff(bounds)))
        for a in range(0, batch.num_rows, DOCUMENT_TILE):
            b = min(a + DOCUMENT_TILE, batch.num_rows)
            inside = slice(bounds[a], bounds[b])
            doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            for tile in tiles.value:
                yield tile_best(tile, tile.scores(b - a, doc, term[inside], impact[inside], n_known), doc_id[a:b], known[a:b], k)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Best] = []
        for batch in batches:
            held = [best_of([*held, *tile_scores(batch)], k)] if batch.num_rows else held
        for item, score, doc_id, known in held:
            ids = pa.array(doc_id, pa.int64(), mask=~known)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(apply, "item long, doc_id long, score long")


def block_top_k(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """The k best documents of a bounded block of tokenised items."""
    spark = docs.sparkSession
    vocabulary = {term: place for place, term in enumerate(sorted({bytes(t) for row in rows for t in row["terms"]}))}
    found = stored(postings(docs, spark.sparkContext.broadcast(vocabulary)))
    totals = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["docs"]:
        return None
    frequency = {row["place"]: row["df"] for row in found.select(F.explode("term").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = {place: weight(totals["docs"], df) for place, df in frequency.items()}
    items = []
    for row in rows:
        each = [(vocabulary[bytes(t)], count) for t, count in zip(row["terms"], row["counts"])]
        each = [(place, count) for place, count in each if weights.get(place)]
        items.append(([place for place, _ in each], [weights[place] * count for place, count in each]))
    tiles = [ItemTile(at, items[at : at + ITEM_TILE]) for at in range(0, len(items), ITEM_TILE)]
    best = ranked(found, spark.sparkContext.broadcast(tiles), totals["docs"], totals["terms"], len(vocabulary), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(place, row["item_id"]) for place, row in enumerate(rows)], "item long, item_id long")
    return placed.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Columns (item_id, rank, doc_id, score): each item's k best documents."""
    bounded_batches(docs)
    asked = stored(item_terms(items))
    size = asked.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    parts = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).orderBy("item_id", "terms").collect()
        part = block_top_k(docs, rows, k) if rows else None
        parts += [part] if part is not None else []
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in parts:
        out = out.union(part)
    return out


#: The same in SQL over the tables ``documents`` and ``benchmark``.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
counts AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, big_n),
impacts AS (SELECT doc, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)) AS impact FROM counts, totals),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(times * w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
