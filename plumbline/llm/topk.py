"""Exact top-k search by no-random-access aggregation over sorted lists.

Contract: a vector's components become floor(64 * x), computed in double. Queries are the rows whose
vec_id is divisible by 20; candidates are all rows but those with the query's own vec_id. The score is
the integer inner product. Each query gets its k highest scores (all, if fewer), ties to the smaller
vec_id. Vectors that are null or hold null or non-finite components, and rows without vec_id, take no
part. A vec_id that repeats stands once, with its smallest vector. Vectors of different lengths are
compared over the components both have; an empty table gives no rows; extra columns are ignored.

Method: rows are cut into blocks by a hash of vec_id; each block of queries meets each block of
vectors once. Within a block every component is a sorted list, read from the top by queries with a
positive weight and from the bottom by those with a negative one. The lists are read in rounds of
equal depth for all queries of a block together. After a round, an entry not yet read counts as the
list's current value in a vector's upper bound and as the list's far end in its lower bound; both
bounds of all vectors are one matrix product each. The leaders' final scores give a floor; reading
stops when no vector outside them, seen or unseen, has an upper bound that reaches the floor, or when
the few that do are cheaper to resolve than to read on. These get their final scores. Blocks hand on k rows per query, and a
ranking per query, limited before its shuffle, merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blocks_of, stored

SCALE = 64
TOP = 20
VECTOR_ROWS = 4096
QUERY_ROWS = 2048
QUERIES_AT_ONCE = 256
#: Depths, as shares of the lists, at which bounds are drawn.
DEPTHS = (0.05, 0.15, 0.35, 1.0)
RESOLVE_SHARE = 0.05


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """Columns (vec_id, v): rows that take part, with integer components."""
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors, zero-padded to one width; the smallest vector of each id."""
    ids = group.column("vec_id").to_numpy()
    lists = group.column("v").combine_chunks()
    width = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    grid = np.zeros((len(ids), int(width.max(initial=0))), np.int64)
    grid[np.arange(grid.shape[1]) < width[:, None]] = flat
    order = np.lexsort([*grid.T[::-1], width, ids])
    order = order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(ids) else order
    return ids[order], grid[order]


def exact_kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest number type in which every inner product of the two blocks is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(queries.shape[1], 1)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


def leaders(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, in any order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, vector row, score) arrays that hold each query's k best vectors of this block."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    kind = exact_kind(queries, vectors)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    lists = np.sort(vectors, axis=0)
    n, found = len(vectors), []
    own = np.searchsorted(ids, query_ids)
    own[(own == n) | (ids[np.minimum(own, n - 1)] != query_ids)] = -1
    zero = np.zeros((), kind)
    pending = np.arange(len(queries))
    for depth in DEPTHS:
        if not len(pending):
            break
        read = min(n, max(k, int(np.ceil(depth * n))))
        low_end, high_end = lists[n - read], lists[read - 1]
        downward = np.where(vectors >= low_end, vectors, low_end)
        upward = np.where(vectors <= high_end, vectors, high_end)
        sure_down = np.where(vectors >= low_end, vectors, lists[0])
        sure_up = np.where(vectors <= high_end, vectors, lists[-1])
        still = []
        for at in range(0, len(pending), QUERIES_AT_ONCE):
            rows = pending[at : at + QUERIES_AT_ONCE]
            q = queries[rows]
            weights = np.hstack([np.maximum(q, zero), np.minimum(q, zero)])
            upper = weights @ np.hstack([downward, upward]).T
            lower = weights @ np.hstack([sure_down, sure_up]).T if read < n else upper
            mine = np.flatnonzero(own[rows] >= 0)
            lowest = np.array(-(2**62) if kind is object else -np.inf, kind)
            lower[mine, own[rows][mine]] = lowest
            front = leaders(lower.astype(np.float64), k)
            final = np.einsum("qd,qkd->qk", q, vectors[front]) if kind is not object else (q[:, None, :] * vectors[front]).sum(axis=2)
            final[own[rows][:, None] == front] = lowest
            floor = final.min(axis=1) if front.shape[1] == min(k, n) else np.full(len(rows), lowest)
            reach = upper >= floor[:, None]
            reach[mine, own[rows][mine]] = False
            open_count = reach.sum(axis=1)
            done = (open_count <= max(2 * k, RESOLVE_SHARE * n)) | (read == n)
            still.append(rows[~done])
            a, b = np.nonzero(reach & done[:, None])
            scores = upper[a, b] if read == n else (q[a] * vectors[b]).sum(axis=1)
            found.append(best_of(rows[a], b, scores, k))
        pending = np.concatenate(still)
    return found


def best_of(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller column."""
    score = score.astype(np.int64) if score.dtype != object else np.array([max(min(int(s), 2**63 - 1), -(2**63)) for s in score], np.int64)
    order = np.lexsort([column, -score, row])
    row, column, score = row[order], column[order], score[order]
    start = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
    keep = place < k
    return row[keep], column[keep], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Columns (query_id, rank, vec_id, score) for integer vectors (vec_id, v) on both sides."""
    n_vectors, n_queries = blocks_of(vectors, VECTOR_ROWS), blocks_of(queries, QUERY_ROWS)

    def blocked(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        each = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = blocked(queries, "q", n_queries, "b", n_vectors).groupBy("q", "b")
    right = blocked(vectors, "b", n_vectors, "q", n_queries).groupBy("q", "b")

    def search(asked: pa.Table, stock: pa.Table) -> pa.Table:
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        if not asked.num_rows or not stock.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in names.items()})
        (query_ids, q), (ids, v) = matrix(asked), matrix(stock)
        parts = search_block(query_ids, q, ids, v, k)
        row, column, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table({"query_id": query_ids[row], "vec_id": ids[column], "score": score})

    best = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_top_k(vectors: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` searched in all rows."""
    usable = stored(integer_vectors(vectors))
    return top_k(usable, usable.where(F.col("vec_id") % every == 0), k)


#: The same in SQL over the table ``embeddings``.
SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
