"""Toxicity by averaged subword embeddings under a linear softmax.

Contract: every document gets a score between 0 and 1 and predicted = 1 at 0.5 or more. Labels are
learned only outside fold 0 (crc32 of the id, modulo five) and only from texts: neither labels, lang,
source nor doc_id enter a score. Null and empty texts score like a text without words. Repeated rows
are scored alike; without labelled rows of both classes every document gets the same prior score.

Method: a word is the bag of its character 3- to 5-grams, taken with its boundaries, hashed into
buckets that hold an embedding each. Embeddings of all subwords of a window of WINDOW words are
averaged (a short window is filled up with zeros to LEAST subwords, so that three words cannot shout),
and a linear softmax reads the mean; a document scores as its most toxic window, so a long text does
not water down a few insults. Embeddings and softmax are trained jointly in numpy, so a spelling never
seen shares the vectors of its n-grams: first on all windows, then on each document's top window.

Training takes at most SAMPLE toxic and 2 * SAMPLE clean labelled rows, with all windows of their whole texts;
that bound on rows bounds the one task that trains. Scoring reads every window of every text in one pass: with both layers linear, a bucket's share of the logits is one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches
from plumbline.llm.labels import fold, learning_sample

BUCKET_BITS = 18
ORDERS = (3, 4, 5)
DIMENSIONS = 8
WINDOW = 8
LEAST = 150
SAMPLE = 1000
SCORE = "__toxicity_score"
EPOCHS = 120
MEAN_EPOCHS = 8
RATE = 1000.0
MOMENTUM = 0.9
DECAY = 1e-7
CHARS_AT_ONCE = 1 << 19
SUBWORDS_AT_ONCE = 1 << 20
STEP = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point, whether it belongs to words."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of a text, repeats included, and the number of its word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_characters()[codes]
    keep = inside | np.concatenate([[False], inside[:-1]])
    line = np.concatenate([[SPACE], np.where(inside, codes, SPACE)[keep], [SPACE]]).astype(np.uint64)
    spaces = np.concatenate([[0], np.cumsum(line == SPACE)])
    rolled, buckets, words = line, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for order in range(2, min(max(ORDERS), len(line)) + 1):
        rolled = rolled[:-1] * STEP + line[order - 1 :]
        if order in ORDERS:
            whole = np.flatnonzero(spaces[order - 1 : order - 1 + len(rolled)] == spaces[1 : 1 + len(rolled)])
            mixed = ((rolled[whole] ^ np.uint64(order)) * SPREAD) >> np.uint64(64 - BUCKET_BITS)
            buckets.append(mixed.astype(np.int64))
            words.append(spaces[whole + 1] - 1)
    words = np.concatenate(words)
    return np.concatenate(buckets), np.maximum(words - words.min(initial=0), 0)


def text_parts(text: str) -> Iterator[str]:
    """The text in parts of bounded length, cut at white space; a longer word is cut where it must."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        cut = max(text.rfind(" ", at, at + CHARS_AT_ONCE), text.rfind("\n", at, at + CHARS_AT_ONCE))
        cut = cut if cut > at else at + CHARS_AT_ONCE
        yield text[at:cut]
        at = cut
    yield text[at:]


def sample_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all windows of a text, window by window, and how many each window has."""
    buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for part in text_parts(text):
        found, words = subwords(part)
        order = np.argsort(words, kind="stable")
        count = np.bincount(words // WINDOW)
        buckets.append(found[order].astype(np.int32))
        sizes.append(count[count > 0].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(sizes)


def learned(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The model of a bounded sample, trained in one task; only the bucket logits reach the driver."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sample_windows(t.as_py() or "") for t in batch.column(0)]
            columns = [batch.column(1), *(pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "buckets", "sizes"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, bias = train([row for batch in batches for row in batch.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([scores.tobytes()], pa.binary()), pa.array([bias])], names=["scores", "bias"])

    bags = sample.select("text", "y").mapInArrow(windows, "y int, buckets binary, sizes binary")
    rows = bags.repartition(1).mapInArrow(model, "scores binary, bias double").collect()
    return (np.frombuffer(rows[0]["scores"], np.float32), rows[0]["bias"]) if rows else train([])


def train(rows: list, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket logits (toxic minus clean) and bias, from gradient descent on embeddings and softmax."""
    rows = sorted((row for row in rows if row["sizes"]), key=lambda row: (row["y"], row["buckets"]))
    y = np.array([row["y"] for row in rows], np.int64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share)))
    sizes = [np.frombuffer(row["sizes"], np.int32) for row in rows]
    windows = np.array([len(n) for n in sizes])
    size = np.concatenate(sizes).astype(np.int64)
    bag = np.concatenate([np.frombuffer(row["buckets"], np.int32) for row in rows])
    del rows
    start, first = np.cumsum(size) - size, np.cumsum(windows) - windows
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(bag) + SUBWORDS_AT_ONCE, SUBWORDS_AT_ONCE)))
    parts = [(a, b, int(start[a]), int(start[b]) if b < len(start) else len(bag)) for a, b in zip(cuts[:-1], cuts[1:])]
    filled = np.maximum(size, LEAST)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1e-3, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 1, (DIMENSIONS, 2)) / np.sqrt(DIMENSIONS)
    bias, speed, turn = np.zeros(2), np.zeros_like(embedding), np.zeros_like(softmax)
    for epoch in range(EPOCHS):
        reads = softmax[:, 1] - softmax[:, 0]
        per_bucket = (embedding @ reads).astype(np.float32)
        logit = np.concatenate([np.add.reduceat(per_bucket[bag[x:y]], start[a:b] - x) for a, b, x, y in parts]) / filled
        best = np.maximum.reduceat(logit, first)
        on_top = np.flatnonzero(logit == np.repeat(best, windows))
        top = on_top[np.searchsorted(on_top, first)]
        if epoch < MEAN_EPOCHS:
            z = np.add.reduceat(logit, first) / windows + bias[1] - bias[0]
            rest = (1 / (1 + np.exp(-z)) - y) * weight
            each = np.repeat(rest / windows, windows) / filled
            back = sum(np.bincount(bag[x:y], np.repeat(each[a:b], size[a:b]), 1 << BUCKET_BITS) for a, b, x, y in parts)
        else:
            rest = (1 / (1 + np.exp(-(best + bias[1] - bias[0]))) - y) * weight
            used = np.concatenate([bag[start[t] : start[t] + size[t]] for t in top])
            back = np.bincount(used, np.repeat(rest / filled[top], size[top]), 1 << BUCKET_BITS)
        pull = embedding.T @ back.astype(np.float32)
        speed *= MOMENTUM
        speed -= np.outer((RATE * back).astype(np.float32), reads.astype(np.float32))
        speed -= np.float32(RATE * DECAY) * embedding
        turn = MOMENTUM * turn - 0.01 * np.stack([-pull, pull], axis=1)
        embedding += speed
        softmax = softmax + turn
        bias = bias - 0.5 * np.array([-1, 1]) * rest.sum()
    return (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def window_logit(text: str, bucket_logits: np.ndarray) -> float:
    """Largest mean bucket logit over the windows of a text; zero without words."""
    best = []
    for part in text_parts(text):
        found, words = subwords(part)
        if len(found):
            window = words // WINDOW
            size = np.bincount(window)
            best.append((np.bincount(window, bucket_logits[found]) / np.maximum(size, LEAST))[size > 0].max())
    return float(max(best, default=0.0))


def marked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` and the score under a reserved name."""
    bounded_batches(docs)
    found = learned(learning_sample(docs, labels, "toxic", (2 * sample, sample), ["text"]))
    model = docs.sparkSession.sparkContext.broadcast(found)
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_logits, bias = model.value
        for batch in batches:
            logits = np.array([window_logit(text.as_py() or "", bucket_logits) + bias for text in batch.column(at)])
            scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, SCORE])

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(apply, T.StructType([*rows.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, held_out, score, predicted and the remaining columns of ``docs``."""
    out = marked(docs, labels, sample)
    others = [c for c in docs.columns if c not in ("doc_id", "score", "predicted", "held_out")]
    return out.select("doc_id", (fold() == 0).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"), *others)
