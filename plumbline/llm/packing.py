"""Best-fit packing of token sequences.

Contract: a document's ids are those of the byte-level vocabulary, with an end id appended; null text
counts as empty. Only documents longer than the capacity are cut, into pieces of the capacity, of
which the first may be shorter. Every piece gets a sequence and a place in it; places follow each
other without a gap from 0.

Method: best-fit decreasing. Pieces of one length are interchangeable, so the packing is decided on
the histogram of lengths: at most ``capacity`` numbers, whatever the corpus holds. Lengths go in
decreasing order; a segment tree over remaining capacities finds the tightest open sequence in
logarithmic time, and a run of sequences with the same rest is filled in one step, which is what
placing its documents one by one would give. The plan's slots, a few for each length, are then handed
out by rank: Spark numbers the pieces of a length, each length cut into salted cells so that a
length held by a third of all pieces is never sorted in one task.

Ids come from the rank form of the vocabulary, which gives the same ids several times faster than its
JSON form; a test holds the two against each other. Repeated rows are packed as often as they occur;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import blocks_of, bounded_batches, stored

CAPACITY = 2048
END_ID = 0
CELL_ROWS = 100_000
#: Fixed values of the vocabulary: the string it keeps for the end of a text, and that string's id.
SPECIAL = {"<|endoftext|>": 50256}
#: Longer runs of one kind of character go through the JSON form, whose scanner has no stack limit.
LONG_TEXT_RUN = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _encoder(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=1)
def _json_encoder(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def has_long_run(text: str) -> bool:
    """Whether some stretch of LONG_TEXT_RUN characters holds no change between white space and the rest."""
    if len(text) < LONG_TEXT_RUN:
        return False
    space = np.fromiter(map(str.isspace, text), bool, len(text))
    bounds = np.flatnonzero(np.diff(space, prepend=~space[:1], append=~space[-1:]))
    return bool(np.diff(bounds).max() >= LONG_TEXT_RUN)


def token_ids(text: str, rank_path: str, json_path: str, pattern: str) -> np.ndarray:
    """Ids of one text with the end id."""
    if has_long_run(text):
        ids = np.array(_json_encoder(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = np.asarray(_encoder(rank_path, pattern).encode_to_numpy(text, allowed_special="all"), np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all but the first have the full capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, rank_path: str, json_path: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, the ids."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "", rank_path, json_path, pattern)
                for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc_id, number, start, length, zlib.crc32(part.tobytes()), part if keep_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=names)

    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(apply, PIECES + (", ids array<long>" if keep_ids else ""))


class OpenRests:
    """Segment tree over remaining capacities: which have open sequences, and the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, rest: int) -> None:
        node = self.leaves + rest
        self.some[node] = bool(self.runs[rest])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, rest: int, first: int, count: int) -> None:
        if rest and count:
            self.runs[rest].append((first, count))
            self._mark(rest)

    def take(self, rest: int) -> tuple[int, int]:
        run = self.runs[rest].pop()
        self._mark(rest)
        return run

    def tightest(self, length: int) -> int | None:
        """Smallest rest of at least ``length`` with an open sequence."""
        node = self.leaves + length
        while not self.some[node]:
            while node & 1:
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Slots of each length, rows (first rank, pieces per sequence, first sequence, offset) by rank."""
    rests, sequences = OpenRests(capacity), 0
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            rest = rests.tightest(length)
            if rest is None:
                rest = capacity
                first, count = sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = rests.take(rest)
            each = rest // length
            full = min(count, left // each)
            if full:
                slots[length].append((rank, each, first, capacity - rest))
                rests.add(rest - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                slots[length].append((rank, left, first + full, capacity - rest))
                rests.add(rest - left * length, first + full, 1)
                full, left = full + 1, 0
            rests.add(rest, first + full, count - full)
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``pieces`` should be stored, it is read twice."""
    counts = pieces.groupBy("length").count().collect()  # at most one row per length up to the capacity
    plan = packing_plan({row["length"]: row["count"] for row in counts}, capacity)
    cells = blocks_of(pieces, CELL_ROWS)
    keyed = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    totals = keyed.groupBy("length", "cell").count()
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("row", F.row_number().over(order)).join(bases, ["length", "cell"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("row") - 1).alias("rank"))
    names = [*pieces.columns, "sequence_id", "offset"]
    spot = names.index("length")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(spot).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    slots = plan[int(length[part[0]])]
                    first, each, start, at = slots[np.searchsorted(slots[:, 0], rank[part], side="right") - 1].T
                    sequence[part] = start + (rank[part] - first) // each
                    offset[part] = at + (rank[part] - first) % each * length[part]
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, rank_path: str, json_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(token_pieces(docs, rank_path, json_path, pattern, capacity)), capacity)
