"""SimHash near copies by multi-index hashing.

Contract: ASCII letters are lower-cased, words are runs of characters other than ASCII white space,
shingles are three words joined by one space (a shorter text is one shingle; no word at all gives
fingerprint zero, which links like any other). A fingerprint bit is set when more than half of the
shingles' XXH64 values (seed 42) have it. Texts link at three or fewer differing bits.

Method: the fingerprint has two segments of 32 bits. Two fingerprints within three bits differ by at
most one bit in one of the segments, so every fingerprint is filed under its segment and under the
segment's Hamming ball of radius one (only flips of zero bits: the other side of a pair has the one
bit set). Rows that meet under a key are compared over all 64 bits, and each task hands on only a
spanning star of what it linked, never the pairs.

Null text counts as empty; repeated rows give repeated result rows; a null doc_id takes no part in
the smallest id but keeps its row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, components, map_batches, merge_labels, run_bounds, stored, whole_runs

SEED = 42
SHINGLE = 3
BITS_APART = 3
SEGMENT = 32
SHINGLES_AT_ONCE = 1 << 16
DENSE_RUN = 64


def fingerprint(text: bytes) -> int:
    """Fingerprint of one UTF-8 text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (doc_id, text_key, fp): a hash that tells a row's text, and the fingerprint's bits as a long."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t or b"") for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], names=["doc_id", "text_key", "fp"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).cast("binary").alias("text"))
    return map_batches(texts, hashed, "doc_id long, text_key long, fp long")


def filed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each table key of each fingerprint: its two segments and their balls of radius one."""
    fp = batch.column(0).to_numpy().view(np.uint64)
    flips = np.uint64(1) << np.arange(SEGMENT, dtype=np.uint64)
    keys, owners = [], []
    for number in range(64 // SEGMENT):
        segment = (fp >> np.uint64(number * SEGMENT)) & np.uint64((1 << SEGMENT) - 1)
        mark = np.uint64(number << SEGMENT)
        keys.append(segment | mark)
        owners.append(fp)
        row, bit = np.nonzero((segment[:, None] & flips) == 0)
        keys.append((segment[row] | flips[bit]) | mark)
        owners.append(fp[row])
    columns = [np.concatenate(keys).view(np.int64), np.concatenate(owners).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp"])


def close_pairs(fp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within each run that are at most BITS_APART apart.

    Short runs are compared together, one distance in the row at a time. In a long run two close
    fingerprints share one of four 16-bit parts, so the run is cut by these first.
    """
    left, right = [], []
    size = np.diff(bounds)
    starts = bounds[:-1]
    short = size <= DENSE_RUN
    at, end = np.repeat(starts[short], size[short]), np.repeat(bounds[1:][short], size[short])
    if len(at):
        row = np.concatenate([np.arange(a, b) for a, b in zip(starts[short & (size > 1)], bounds[1:][short & (size > 1)])] or [np.zeros(0, np.int64)])
        end = np.repeat(bounds[1:][short & (size > 1)], size[short & (size > 1)])
        step = 1
        while len(row):
            keep = row + step < end
            row, end = row[keep], end[keep]
            hit = np.bitwise_count(fp[row] ^ fp[row + step]) <= BITS_APART
            left.append(row[hit])
            right.append(row[hit] + step)
            step += 1
    for a, b in zip(starts[~short], bounds[1:][~short]):
        index = np.arange(a, b)
        for part in range(4):
            value = (fp[a:b] >> np.uint64(16 * part)) & np.uint64(0xFFFF)
            order = index[np.argsort(value, kind="stable")]
            cuts = run_bounds(np.sort(value, kind="stable"))
            for c, d in zip(cuts[:-1], cuts[1:]):
                for i in range(c, d - 1):
                    rest = order[i + 1 : d]
                    hit = rest[np.bitwise_count(fp[order[i]] ^ fp[rest]) <= BITS_APART]
                    left.append(np.full(len(hit), order[i]))
                    right.append(hit)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) that span all links among the fingerprints that meet under some key."""
    for rows in whole_runs(batches, "key"):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        left, right = close_pairs(fp, run_bounds(rows.column("key").to_numpy()))
        if not len(left):
            continue
        nodes, place = np.unique(np.concatenate([fp[left], fp[right]]), return_inverse=True)
        label = merge_labels(len(nodes), place[: len(left)], place[len(left) :])
        star = np.flatnonzero(label != np.arange(len(nodes)))
        columns = [nodes[star].view(np.int64), nodes[label[star]].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all close pairs."""
    keyed = map_batches(distinct_fps.select("fp"), filed, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (doc_id, fingerprint, component_id, text_key), one row per input row."""
    marked = stored(fingerprints(bounded_batches(docs), id_column, text_column))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = stored(components(links(distinct)))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(named.join(firsts, "root").select(F.col("fp").alias("class_fp"), "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", digits, "component_id", "text_key")
