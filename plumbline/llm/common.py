"""Helpers the operators share: tables, stored intermediate results, sorted runs and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that a Python worker gets at once; a longer row comes alone.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows, handed to Python in batches bounded by bytes, as texts may be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stored(df: DataFrame) -> DataFrame:
    """Write a result once to the shared folder and read it back: it cuts lineage, is computed once
    and leaves a fresh exchange before later joins, which adaptive execution can split."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_of(df: DataFrame, rows: int) -> int:
    """Number of blocks of about ``rows`` rows each, at least one."""
    return max(1, -(-df.count() // rows))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to every Arrow batch; rows stay in their partition."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(apply, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``key`` into tables of about ``rows`` rows that never split a key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.Table.from_batches(held)
        keys = joined.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield joined.slice(0, cut)
            held = joined.slice(cut).to_batches()
            size = joined.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def merge_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer
        open_links = label[left] != label[right]
        left, right = left[open_links], right[open_links]
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of long columns (a, b): one row (node, root) per node that has a link.

    Alternating large and small stars: every round each node hands its larger neighbours, then its
    smaller ones, to the smallest node it sees. Minima are aggregated before the shuffle, so a node
    with very many links is never gathered; the joins have a fresh exchange on both sides.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stored(large)
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), "low")
        small = large.join(low, F.col("a") == F.col("n")).select("a", "b", "low")
        small = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        links = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        state = links.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("nodes")).first()
        chained = links.select(F.col("a").alias("n")).join(links.select(F.col("b").alias("n")).distinct(), "n", "left_semi").limit(1).count()
        if state["n"] == state["nodes"] and not chained:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
