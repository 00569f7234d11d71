"""Embedding near copies by iterative quantisation and multi-index Hamming tables.

Contract: vectors link at a cosine of at least ``threshold`` (0.9), taken in double precision between
the original vectors; vectors that are null, zero, or hold null or non-finite components link with
nothing. One row per vec_id: n_links counts the other vectors linked directly, component_id is the
smallest vec_id reachable over links, itself included, and kept marks vec_id = component_id. A vec_id
that repeats stands once, with its smallest vector; rows without vec_id are left out. No pair below the threshold is ever
linked; pairs at or above it are found with a recall that a test measures against brute force.

Method: a rotation is learned on at most SAMPLE vectors (principal axes, then alternating between
signs and the rotation nearest to them; several rotations where the vectors have fewer dimensions than
the code has bits), which gives balanced binary codes. The vectors are not centred: under a strong common
mean, pairs at the threshold would differ in too many bits of centred codes to be found. A code's segments each have
a table; a vector is filed under its segment and under the segment's Hamming ball of radius one. Under a
key only rows with some partner within HAMMING bits go on; they fetch their original vectors and are
reranked in blocks of the key's rows. A block hands on a count per vector and a spanning star of its
links, never the pairs, so a group of n copies costs n rows and not n squared. A key with many rows is
dealt out over a grid of blocks. A pair that meets under several keys counts where its first segment
within reach is.

Near-identical vectors make equal codes, so a pair at cosine 0.9 of 64-bit codes differs in 9 bits on
average and shares a segment within one bit with a probability of about 0.94, at 0.97 of over 0.999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, merge_labels, run_bounds, stored, whole_runs

THRESHOLD = 0.9
SAMPLE = 20_000
ROUNDS = 50
BITS = 64
#: Segments as (first bit, bits); radius one in any of them.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Largest difference of two codes that is reranked; at cosine 0.9 fewer than 1 pair in 1000 exceeds it.
HAMMING = 19
GRID_ROWS = 1024


def one_per_id(vectors: DataFrame) -> DataFrame:
    """Columns (vec_id, embedding, usable): the smallest vector of each id."""
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sound = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("usable", F.coalesce(sound, F.lit(False)))


def grid_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, cut or zero-padded to ``width``, at length one."""
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    scale = np.abs(out).max(axis=1, keepdims=True)
    out = out / np.where(scale > 0, scale, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Directions whose signs are the code: principal axes under the rotations that fit their signs best. Fewer
    axes than bits are turned by several rotations, each from another start, so that every bit varies."""
    _, _, axes = np.linalg.svd(sample.T @ sample)
    width = min(bits, sample.shape[1])
    projected = sample @ axes[:width].T
    out = []
    for number in range(-(-bits // width)):
        turn, _ = np.linalg.qr(np.random.default_rng(seed + number).normal(size=(width, width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        out.append(axes[:width].T @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def codes_of(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Binary codes as unsigned 64-bit numbers."""
    signs = np.zeros((len(unit), 64), np.uint8)
    signs[:, : directions.shape[1]] = unit[:, : len(directions)] @ directions > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def segment(codes: np.ndarray, number: int) -> np.ndarray:
    first, bits = SEGMENTS[number]
    return (codes >> np.uint64(first)) & np.uint64((1 << bits) - 1)


def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vec_id, code) for each segment and its ball of radius one.

    Only flips of zero bits are filed: of two segments one bit apart, the one without the bit reaches
    the other, so each pair meets once in a table.
    """
    for batch in batches:
        ids, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for number, (_, bits) in enumerate(SEGMENTS):
            own = segment(codes, number)
            mark = np.uint64(number << 16)
            flips = np.uint64(1) << np.arange(bits, dtype=np.uint64)
            row, bit = np.nonzero((own[:, None] & flips) == 0)
            keys = np.concatenate([own, own[row] | flips[bit]]) | mark
            owner = np.concatenate([np.arange(len(ids)), row])
            columns = [pa.array(keys.astype(np.int64)), pa.array(ids[owner]), pa.array(codes[owner].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vec_id", "code"])


def owners_of(left: np.ndarray, right: np.ndarray, number: int, key: int) -> np.ndarray:
    """Whether the pairs of codes count under this key: they meet here by the table's rule, differ by at
    most HAMMING bits and are out of reach in all earlier segments."""
    pairs = left[:, None] ^ right[None, :]
    good = np.bitwise_count(pairs) <= HAMMING
    stored_left = segment(left, number) == np.uint64(key)
    stored_right = segment(right, number) == np.uint64(key)
    good &= stored_left[:, None] | stored_right[None, :]
    for earlier in range(number):
        good &= np.bitwise_count(segment(pairs, earlier)) > 1
    return good


def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, vec_id, code) that have a partner under their key.

    A key's rows are cut into stripes of GRID_ROWS; a block (i, j) compares stripe i with stripe j, and
    a row goes to the blocks where it has a partner. ``side`` is 0 in stripe i and 1 in stripe j.
    """
    names = ["key", "i", "j", "side", "vec_id", "code"]
    for rows in whole_runs(batches, "key"):
        keys, ids = rows.column("key").to_numpy(), rows.column("vec_id").to_numpy()
        codes = rows.column("code").to_numpy().view(np.uint64)
        bounds = run_bounds(keys)
        out: list[list[np.ndarray]] = [[] for _ in names]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            number, key = int(keys[a]) >> 16, int(keys[a]) & 0xFFFF
            stripes = range(a, b, GRID_ROWS)
            for i, x in enumerate(stripes):
                for j, y in enumerate(stripes[i:], i):
                    left, right = np.arange(x, min(x + GRID_ROWS, b)), np.arange(y, min(y + GRID_ROWS, b))
                    good = owners_of(codes[left], codes[right], number, key)
                    if i == j:
                        good = np.triu(good, 1)
                    if not good.any():
                        continue
                    for side, picked in enumerate((left[good.any(axis=1)], right[good.any(axis=0)])):
                        for column, value in zip(out, (keys[a], i, j, side, ids[picked], codes[picked].view(np.int64))):
                            column.append(np.broadcast_to(value, len(picked)))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)


def reranked(threshold: float):
    """Rows (vec_id, links, root): verified links of each vector in each block, and its star there."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "block", 20_000):
            blocks, ids = rows.column("block").to_numpy(), rows.column("vec_id").to_numpy()
            codes, side = rows.column("code").to_numpy().view(np.uint64), rows.column("side").to_numpy()
            keys = rows.column("key").to_numpy()
            same = rows.column("i").to_numpy() == rows.column("j").to_numpy()
            unit = grid_of(rows.column("embedding").combine_chunks(), 0)
            bounds = run_bounds(blocks)
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(bounds[:-1], bounds[1:]):
                left, right = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
                good = owners_of(codes[left], codes[right], int(keys[a]) >> 16, int(keys[a]) & 0xFFFF)
                good &= ids[left][:, None] < ids[right][None, :] if same[a] else ids[left][:, None] != ids[right][None, :]
                good &= unit[left] @ unit[right].T >= threshold
                p, q = np.nonzero(good)
                if not len(p):
                    continue
                nodes, place = np.unique(np.concatenate([ids[left][p], ids[right][q]]), return_inverse=True)
                label = merge_labels(len(nodes), place[: len(p)], place[len(p) :])
                for column, value in zip(out, (nodes, np.bincount(place, minlength=len(nodes)), nodes[label])):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["vec_id", "links", "root"])

    return apply


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Columns (vec_id, n_links, component_id, kept), one row per vec_id."""
    rows = stored(one_per_id(vectors))
    usable = rows.where("usable").select("vec_id", "embedding")
    learn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    if len(learn) == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    directions = rotation(grid_of(learn, 0))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of(grid_of(batch.column(1), len(directions)), directions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["vec_id", "code"])

    keyed = usable.mapInArrow(coded, "vec_id long, code long").mapInArrow(filed, "key long, vec_id long, code long")
    members = keyed.repartition("key").sortWithinPartitions("key", "vec_id")
    partners = stored(members.mapInArrow(with_partner, "key long, i long, j long, side long, vec_id long, code long"))
    blocks = partners.join(usable.hint("merge"), "vec_id").withColumn("block", F.xxhash64("key", "i", "j"))
    ordered = blocks.repartition("block").sortWithinPartitions("block", "key", "i", "j")
    found = stored(ordered.select("block", "key", "i", "j", "side", "vec_id", "code", "embedding").mapInArrow(reranked(threshold), "vec_id long, links long, root long"))
    counts = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("links").alias("n"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").join(counts, F.col("vec_id") == F.col("id"), "left").join(roots, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
