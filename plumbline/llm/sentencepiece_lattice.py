"""SentencePiece encoding and decoding over a relational lattice.

Contract: spaces become the word mark, one more mark is put in front, and the text is cut into units
that end before a mark or around a line feed. There are two folds. With ``merges``, for BPE models, whose
scores are ranks of merges, the ids are those of the library on the whole text: neighbours merge in the
order of the scores, the leftmost first on ties; empty text has no ids; units are cut further only
between characters that no piece has side by side, so no cut can change an id. Without it a unit has at
most UNIT_CHARS characters after its marks and is encoded by the path of pieces with the largest sum of
scores, on ties by the longest last piece, then the larger ids; on a BPE model such ids are not the
model's. A character without a piece stands as its byte pieces. Per document: ids. Decoding gives the
text back exactly, but that a word mark in the text reads as a space, as the format has it. Null text
counts as empty; repeated rows stay; an empty table gives no rows.

Method: each different unit is encoded once. Units are exploded into substrings no longer than the
longest piece, an equi-join to the piece table (broadcast; its size is the vocabulary's and is checked)
leaves the lattice's edges, edges are grouped by unit, and Spark's ``aggregate`` folds them: for sums over
the end positions, for merges over the edges in the order of their scores, where an edge whose two ends
still stand removes the ends between them. That equals merging neighbours one by one as long as the
parts of a piece always come before the piece, which is checked for every piece of the model. A unit of
more than MERGE_CHARS characters that cannot be cut, such as one letter repeated, is folded over a heap in
an Arrow task.

Units that are frequent in a sample of about SAMPLE_DOCS documents, at most FREQUENT of them, are encoded
first and go to every task. This decides only which way a unit's ids travel, never what they are. All
other units go through a shuffle: the documents of one stretch of a scan make a chunk, which sends its
different other units, in sorted order, to the lattice with their places; the ids come back packed by chunk
and meet the documents, which travel as numbers of units only. So neither units nor texts are shuffled once
per occurrence. A scan gives the same chunks again while its partitions are the same, so ``docs`` must be a
stored table; a chunk's number holds a checksum of its texts, and a difference stops the job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, stored

#: Fixed value of the format: the mark of a word's beginning.
MARK = "▁"
UNIT_CHARS = 200
UNIT_MARKS = 16
CHUNK_CHARS = 4_000_000
#: Characters that are cut at once, but for a longer text.
PART_CHARS = 1_000_000
SAMPLE_DOCS = 20_000
#: Most units that are sent to every task, and their most characters: a few ten megabytes at the very most.
FREQUENT = 200_000
FREQUENT_CHARS = 40
ROWS_AT_ONCE = 50_000
PACK_IDS = 2_000_000
HELD_UNITS = 20_000
#: A unit has some fifteen edges, so its partitions are made finer than those of other shuffles.
EDGE_PARTS = 4
DOCS_AT_ONCE = 2_000
MOST_PIECES = 500_000
UNKNOWN_BELOW = 10.0
HEAD = 3
#: Longest unit whose ends are the bits of a long; the merge fold in Spark takes units up to it.
MERGE_CHARS = 60
UNITS = re.compile(f"{MARK}{{1,{UNIT_MARKS}}}[^{MARK}\n]{{0,{UNIT_CHARS}}}|\n|[^{MARK}\n]{{1,{UNIT_CHARS}}}")


def units_of(text: str) -> list[str]:
    return UNITS.findall(MARK + text.replace(" ", MARK))


@lru_cache(maxsize=1)
def model(path: str) -> tuple[list[tuple[int, str, float]], tuple[int, ...], tuple[str | bytes, ...]]:
    """Ordinary pieces (id, piece, score), ids of the 256 byte pieces, and what each id decodes to."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, decoded = [], [0] * 256, []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            decoded.append("")
        else:
            pieces.append((i, piece, processor.get_score(i)))
            decoded.append(piece)
    return pieces, tuple(byte_ids), tuple(decoded)


@lru_cache(maxsize=1)
def neighbours(path: str) -> frozenset[str]:
    """Pairs of characters that some piece has side by side."""
    found = frozenset(a + b for _, piece, _ in model(path)[0] for a, b in zip(piece, piece[1:]))
    if any("\n" in pair or (pair[1] == MARK and pair[0] != MARK) for pair in found):
        raise ValueError("the vocabulary has pieces that reach over a word's beginning or a line feed")
    return found


def unjoined(unit: str, path: str) -> list[str]:
    """A unit cut between characters that no piece has side by side."""
    pairs = neighbours(path)
    ends = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs]
    return [unit[a:b] for a, b in zip([0, *ends], [*ends, len(unit)])]


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of texts (the first one's start before them) and the bytes of their array."""
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    return np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset), np.frombuffer(data, np.uint8)


#: Texts as words (any may come twice), the number of the word at each place, and the places of each text.
Coded = tuple[pa.LargeStringArray, np.ndarray, np.ndarray]


def listed_units(texts: pa.LargeStringArray) -> Coded:
    units = [units_of(text) for text in texts.to_pylist()]
    coded = pa.array([u for own in units for u in own], pa.large_string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.fromiter(map(len, units), np.int64, len(units))


def uncut_units(texts: pa.LargeStringArray, path: str) -> Coded:
    """Units between which no merge is possible: marks with what follows them up to the next mark or line feed,
    line feeds, and what follows those. They are stretches of the texts' bytes; only units of more than
    MERGE_CHARS characters are looked at one by one."""
    filled = pc.replace_substring(texts, " ", MARK)
    mark = pa.scalar(MARK, pa.large_string())
    filled = pc.if_else(pc.equal(pc.binary_length(filled), 0), filled, pc.binary_join_element_wise(mark, filled, pa.scalar("", pa.large_string())))
    ends, data = bytes_of(filled)
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    size = len(data)
    if not size:
        return filled.slice(0, 0), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    marks, (a, b, c) = np.zeros(size, bool), MARK.encode()
    marks[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    feeds, begins = data == 10, marks.copy()
    begins[3:] &= ~marks[:-3]
    begins |= feeds
    begins[1:] |= feeds[:-1]
    begins[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, ends)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size)), pa.py_buffer(data))
    coded = units.dictionary_encode()
    words, numbers = coded.dictionary, coded.indices.to_numpy()
    short = pc.utf8_length(words).to_numpy() <= MERGE_CHARS
    if short.all():
        return words, numbers, np.diff(bounds)
    # the parts of long words are words behind the short ones
    total, kept, more = len(words), int(short.sum()), []
    parts, first, sizes = [np.cumsum(short) - 1], np.arange(total), np.ones(total, np.int64)
    for at, word in zip(np.flatnonzero(~short).tolist(), words.filter(pa.array(~short)).to_pylist()):
        own = unjoined(word, path)
        parts.append(kept + len(more) + np.arange(len(own)))
        more += own
        first[at], sizes[at], total = total, len(own), total + len(own)
    size = sizes[numbers]
    ends = np.cumsum(size)
    numbers = np.concatenate(parts)[np.repeat(first[numbers] - (ends - size), size) + np.arange(ends[-1])]
    words = pa.concat_arrays([words.filter(pa.array(short)), pa.array(more, pa.large_string())])
    return words, numbers, np.diff(np.append(0, ends)[bounds])


def merged_path(length: int, number_at: Callable[[int, int], int | None], scores: list[float]) -> list[tuple[int, int]]:
    """Pieces (start, end) left when neighbours merge by score; ``number_at`` gives the id + 1 of an edge."""
    end, before = list(range(1, length + 1)), list(range(-1, length - 1))
    heap = [(-scores[n - 1], i, i + 1, i + 2) for i in range(length - 1) if (n := number_at(i, i + 2))]
    heapify(heap)
    while heap:
        _, left, right, stop = heappop(heap)
        if end[left] != right or end[right] != stop:
            continue
        end[left], end[right] = stop, 0
        if stop < length:
            before[stop] = left
            if n := number_at(left, end[stop]):
                heappush(heap, (-scores[n - 1], left, stop, end[stop]))
        if left and (n := number_at(before[left], stop)):
            heappush(heap, (-scores[n - 1], before[left], left, stop))
    path, at = [], 0
    while at < length:
        path.append((at, end[at]))
        at = end[at]
    return path


@lru_cache(maxsize=1)
def merge_order(path: str) -> tuple[list[tuple[int, str, int]], int]:
    """Pieces as (id, piece, place of its score among all scores), and the number of places.

    The fold in the order of scores needs every piece to come from two parts that come before it: a part
    scores better, or equal if it is the left one, whose edge sorts before that of the piece. Only runs of one
    character that share the worst score may differ, as nothing but such runs is left when they merge; for
    them the fold is compared with the merging of neighbours on runs of every length up to three pieces.
    """
    pieces, _, decoded = model(path)
    known, scores = {piece: i + 1 for i, piece, _ in pieces}, [0.0] * len(decoded)
    for i, _, score in pieces:
        scores[i] = score
    worst, runs = min(scores), set()
    for _, piece, score in pieces:
        size = len(piece)
        if size > 1:
            parts = merged_path(size, lambda i, j, piece=piece: known.get(piece[i:j]) if j - i < len(piece) else None, scores)
            late = any(j - i > 1 and (scores[known[piece[i:j]] - 1], -i) < (score, 0) for i, j in parts)
            if late and score == worst and len(set(piece)) == 1:
                runs.add(piece[0])
            elif late or len(parts) != 2:
                raise ValueError(f"the piece {piece!r} is not merged from two earlier parts")
    longest = max(len(piece) for _, piece, _ in pieces)
    for run in (c * n for c in runs for n in range(1, 3 * longest + 1)):
        edges = sorted((-scores[n - 1], i, j) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if (n := known.get(run[i:j])))
        ends = list(range(len(run) + 1))
        for _, i, j in edges:
            if i in ends and j in ends:
                ends = [x for x in ends if x <= i or x >= j]
        if list(zip(ends, ends[1:])) != merged_path(len(run), lambda i, j, run=run: known.get(run[i:j]), scores):
            raise ValueError(f"the fold does not give the merges of {run!r}")
    place = {score: n for n, score in enumerate(sorted({score for _, _, score in pieces}, reverse=True))}
    return [(i, piece, place[score]) for i, piece, score in pieces], len(place)


def long_fold(model_path: str) -> Callable[[str], list[int]]:
    """Ids of a unit, folded over a heap."""
    pieces, byte_ids, decoded = model(model_path)
    known, scores = {piece: i + 1 for i, piece, _ in pieces}, [0.0] * len(decoded)
    for i, _, score in pieces:
        scores[i] = score

    def fold(unit: str) -> list[int]:
        ids: list[int] = []
        for i, j in merged_path(len(unit), lambda i, j: known.get(unit[i:j]), scores):
            n = known.get(unit[i:j])
            ids += [n - 1] if n else [byte_ids[x] for x in unit[i:j].encode()]
        return ids

    return fold


def decode_units(ids: list[int], decoded: tuple[str | bytes, ...]) -> str:
    """Pieces put together again, marks included."""
    out = b"".join(p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass") for p in (decoded[i] for i in ids))
    return out.decode("utf-8", "surrogatepass")


def decode(ids: list[int], decoded: tuple[str | bytes, ...]) -> str:
    """The text of a sequence of ids."""
    return decode_units(ids, decoded).replace(MARK, " ")[1:]


class Chunk:
    """Consecutive documents: their words that are not frequent, and with ``keep`` the documents by the numbers of words."""

    def __init__(self, number: int, keep: bool, cut: Callable[[pa.LargeStringArray], Coded], frequent: pa.LargeStringArray) -> None:
        self.number, self.keep, self.cut, self.size, self.crc = number, keep, cut, 0, 0
        self.frequent = frequent
        self.others: list[pa.LargeStringArray] = []
        self.doc_ids: list = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: list, texts: pa.LargeStringArray, size: int) -> None:
        words, places, counts = self.cut(texts)
        numbers = pc.fill_null(pc.index_in(words, value_set=self.frequent), -1).to_numpy()
        self.others.append(words.filter(pa.array(numbers < 0)))
        if self.keep:
            self.doc_ids += doc_ids
            self.docs.append((numbers, places, counts))
        ends, data = bytes_of(texts)
        self.size += size
        self.crc = zlib.crc32(data[ends[0] : ends[-1]], self.crc)

    def units(self) -> tuple[pa.Array, np.ndarray]:
        """Different units that are not frequent, in sorted order, and the places of ``others`` among them."""
        coded = pa.concat_arrays(self.others).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        return coded.dictionary.take(order).cast(pa.string()), place[coded.indices.to_numpy()]

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Units of all documents, and their counts: numbers of frequent units, or after them places in the sorted order."""
        _, place = self.units()
        out, at = [], 0
        for numbers, places, _ in self.docs:
            rest = np.flatnonzero(numbers < 0)
            numbers = numbers.copy()
            numbers[rest] = len(self.frequent) + place[at : at + len(rest)]
            at += len(rest)
            out.append(numbers[places])
        return np.concatenate(out), np.concatenate([counts for _, _, counts in self.docs])

    def key(self, partition: int) -> int:
        return partition << 44 | self.number << 32 | self.crc


def whole_texts(column: pa.Array) -> pa.LargeStringArray:
    """Texts of a batch; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_string())


def chunked(batches: Iterator[pa.RecordBatch], keep: bool, cut: Callable[[pa.LargeStringArray], Coded], frequent: pa.LargeStringArray) -> Iterator[tuple[int, Chunk]]:
    """Chunks of about CHUNK_CHARS characters with their keys, from rows (doc_id, text)."""
    partition, chunk = TaskContext.get().partitionId(), Chunk(0, keep, cut, frequent)
    for batch in batches:
        doc_ids, texts, at = batch.column(0).to_pylist(), whole_texts(batch.column(1)), 0
        sizes = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy() + 1))
        while at < len(texts):
            # up to the document that fills the part or the chunk
            stop = min(len(texts), int(np.searchsorted(sizes, sizes[at] + min(PART_CHARS, CHUNK_CHARS - chunk.size))))
            chunk.add(doc_ids[at:stop], texts.slice(at, stop - at), int(sizes[stop] - sizes[at]))
            at = stop
            if chunk.size >= CHUNK_CHARS:
                yield chunk.key(partition), chunk
                chunk = Chunk(chunk.number + 1, keep, cut, frequent)
                pa.default_memory_pool().release_unused()
    if chunk.size:
        yield chunk.key(partition), chunk


def unit_rows(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.LargeStringArray], Coded], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, place, unit): the chunk's units that are not frequent, in sorted order."""
    for key, chunk in chunked(batches, False, cut, frequent.value):
        units, _ = chunk.units()
        for at in range(0, len(units), ROWS_AT_ONCE):
            part = units.slice(at, ROWS_AT_ONCE)
            columns = [pa.array(np.full(len(part), key)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), part]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "unit"])


def unit_counts(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.LargeStringArray], Coded]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, n) of units with at most FREQUENT_CHARS characters, counted by part of a batch."""
    for batch in batches:
        texts, at = whole_texts(batch.column(0)), 0
        sizes = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy() + 1))
        while at < len(texts):
            stop = min(len(texts), int(np.searchsorted(sizes, sizes[at] + PART_CHARS)))
            words, places, _ = cut(texts.slice(at, stop - at))
            rows = pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(places, minlength=len(words)))], names=["unit", "n"])
            yield rows.filter(pc.less_equal(pc.utf8_length(rows.column(0)), FREQUENT_CHARS))
            at = stop
        pa.default_memory_pool().release_unused()


def packed(rows: pa.RecordBatch) -> bytes:
    """Rows as a compressed stream of columns."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def place_rows(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.LargeStringArray], Coded], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, packed): documents as numbers of frequent units, or after them places in the sorted order."""
    for key, chunk in chunked(batches, True, cut, frequent.value):
        numbers, counts = chunk.numbered()
        ends = np.append(0, np.cumsum(counts))
        for at in range(0, len(counts), DOCS_AT_ONCE):
            own = counts[at : at + DOCS_AT_ONCE]
            planes = planes_of(numbers[ends[at] : ends[at + len(own)]])
            rows = [pa.array(chunk.doc_ids[at : at + DOCS_AT_ONCE], pa.int64()), pa.array(own, pa.int32()), pa.array([planes] + [None] * (len(own) - 1), pa.binary())]
            out = packed(pa.record_batch(rows, names=["doc_id", "n", "planes"]))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([out], pa.binary())], names=["chunk", "packed"])


def planes_of(values: np.ndarray) -> bytes:
    """Integers of 32 bits with bytes of equal weight side by side, which packs better."""
    return np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def pack_found(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, n, m, packed) from rows (chunk, place, ids, long): n places of a chunk as differences, the
    sizes of their ids and the m ids. ``long`` is a unit that is still to be folded; equal ones follow each other."""

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        chunks, place = rows.column("chunk").to_numpy(), rows.column("place").to_numpy()
        order = np.lexsort([place, chunks])
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        chunks, place, offsets, flat = chunks[order], place[order], ids.offsets.to_numpy(), ids.flatten().to_numpy()
        offsets = offsets - offsets[0]
        bounds = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1))
        parts = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = np.concatenate([np.diff(place[a:b], prepend=0), np.diff(offsets[a : b + 1]), flat[offsets[a] : offsets[b]]])
            parts.append(pa.compress(planes_of(own), codec="zstd", asbytes=True))
        count, sizes = np.diff(bounds).astype(np.int32), np.diff(offsets[bounds]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(chunks[bounds[:-1]]), pa.array(count), pa.array(sizes), pa.array(parts, pa.binary())], names=["chunk", "n", "m", "packed"])

    fold, last, last_ids = long_fold(model_path), None, None
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, long = batch.column(2), batch.column(3)
        if long.null_count < len(long):
            found = ids.to_pylist()
            for at, unit in enumerate(long.to_pylist()):
                if unit is not None:
                    if unit != last:
                        last, last_ids = unit, fold(unit)
                    found[at] = last_ids
            ids = pa.array(found, pa.list_(pa.int32()))
        held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["chunk", "place", "ids"]))
        if sum(len(b.column(2).values) for b in held) >= PACK_IDS:
            yield flushed(held)
            held = []
    if held:
        yield flushed(held)


def piece_table(spark: SparkSession, model_path: str) -> DataFrame:
    """Columns (piece, id, score)."""
    pieces, _, _ = model(model_path)
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"the vocabulary has {len(pieces)} pieces, more than the {MOST_PIECES} that are broadcast")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(pieces, schema)


def byte_pieces(character: Column, byte_ids: tuple[int, ...]) -> Column:
    """Ids of the byte pieces of a character."""
    numbers, utf8 = F.array(*map(F.lit, byte_ids)), F.hex(F.encode(character, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), (F.length(utf8) / 2).cast("int")), lambda i: F.element_at(numbers, F.conv(F.substring(utf8, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1))


def merged_units(units: DataFrame, model_path: str) -> DataFrame:
    """Columns (unit, first, ids) for different units, folded in the order of merges; a long unit has null ids."""
    order, places = merge_order(model_path)
    _, byte_ids, _ = model(model_path)
    if len(order) > MOST_PIECES:
        raise ValueError(f"the vocabulary has {len(order)} pieces, more than the {MOST_PIECES} that are broadcast")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("place", T.IntegerType())])
    table = F.broadcast(units.sparkSession.createDataFrame(order, schema))
    short = F.length("unit") <= MERGE_CHARS
    # a substring of three or more characters is cut only in the lengths of the pieces with its first three
    lengths: dict[str, set[int]] = {}
    for _, piece, _ in order:
        if len(piece) >= HEAD:
            lengths.setdefault(piece[:HEAD], set()).add(len(piece))
    heads = units.sparkSession.createDataFrame([(h, sorted(n)) for h, n in lengths.items()], "head string, sizes array<int>")
    # a long unit has the one empty span
    starts = units.select("unit", "first", F.explode_outer(F.when(short, F.sequence(F.lit(1), F.length("unit"))).otherwise(F.array(F.lit(0)))).alias("start"))
    headed = starts.withColumn("key", F.substring("unit", F.col("start"), F.lit(HEAD))).join(F.broadcast(heads), F.col("key") == F.col("head"), "left")
    room = F.length("unit") - F.col("start") + 1
    few = F.sequence(F.lit(1), F.least(room, F.lit(HEAD - 1)))
    every = F.when(F.col("start") == 0, F.array(F.lit(0))).when(F.col("sizes").isNull(), few).otherwise(F.concat(few, "sizes"))
    spans = headed.select("unit", "first", "start", F.explode_outer(every).alias("size")).where(F.col("size") <= F.greatest(F.lit(0), room))
    cut = spans.withColumn("sub", F.substring("unit", F.col("start"), F.col("size")))
    edges = cut.join(table, F.col("sub") == F.col("piece"), "left").where("id IS NOT NULL OR size <= 1")
    # an edge is (place of the score, start, end, id + 1) in one long; id + 1 is 0 for a byte edge
    start = (F.col("start") - 1).cast("long")
    order_of = F.when(F.col("size") > 1, F.col("place")).otherwise(places).cast("long")
    number = order_of * (1 << 40) + start * (1 << 32) + (start + F.col("size")) * (1 << 24) + F.coalesce(F.col("id") + 1, F.lit(0))
    # a unit's edges are few, so a task may hold those of many units before it turns to sorting
    units.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(HELD_UNITS))
    lattice = edges.groupBy("unit").agg(F.first("first").alias("first"), F.collect_list(number).alias("edges"))

    def start_of(e):
        return F.shiftright(e, 32).bitwiseAND(F.lit(255)).cast("int")

    def end_of(e):
        return F.shiftright(e, 24).bitwiseAND(F.lit(255)).cast("int")

    def bit(place):
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    def both(e):
        return bit(start_of(e)).bitwiseOR(bit(end_of(e)))

    def span(e):
        return bit(end_of(e) + 1) - bit(start_of(e))

    def stands(ends, e):
        first, last = F.call_function("shiftright", ends, start_of(e)), F.call_function("shiftright", ends, end_of(e))
        return first.bitwiseAND(last).bitwiseAND(F.lit(1)) == 1

    def step(ends, e):
        return F.when(stands(ends, e), ends.bitwiseAND(F.bitwise_not(span(e).bitwiseXOR(both(e))))).otherwise(ends)

    # the ends are bits; edges of one character, which sort last, change none
    merging = F.filter(F.sort_array("edges"), lambda e: e < places * (1 << 40))

    def path(ends):
        """By start: the edges between neighbouring ends. As the last step of the fold it is bound to its result;
        a column of its own would be folded anew for every edge."""
        kept = F.filter("edges", lambda e: stands(ends, e) & (ends.bitwiseAND(span(e)) == both(e)))
        return F.sort_array(F.transform(kept, lambda e: e.bitwiseAND(F.lit((1 << 40) - 1))))

    def ids_of(e):
        piece = e.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
        return F.when(piece > 0, F.array(piece - 1)).otherwise(byte_pieces(F.substring(F.col("unit"), start_of(e) + 1, F.lit(1)), byte_ids))

    folded = F.aggregate(merging, bit(F.length("unit") + 1) - 1, step, path)
    return lattice.select("unit", "first", F.when(short, F.flatten(F.transform(folded, ids_of))).alias("ids"))


def encoded_units(units: DataFrame, model_path: str, merges: bool) -> DataFrame:
    """Columns (unit, first, ids) for different units; ``first`` is passed through."""
    if merges:
        return merged_units(units, model_path)
    pieces, byte_ids, _ = model(model_path)
    longest = max(len(piece) for _, piece, _ in pieces)
    unknown = min((score for _, _, score in pieces if score > -1e8), default=0.0) - UNKNOWN_BELOW
    starts = units.select("unit", "first", F.explode_outer(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    spans = starts.select("unit", "first", "start", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("start") + 1))).alias("size"))
    cut = spans.withColumn("sub", F.substring("unit", F.col("start"), F.col("size")))
    edges = cut.join(F.broadcast(piece_table(units.sparkSession, model_path)), F.col("sub") == F.col("piece"), "left").where("id IS NOT NULL OR size <= 1")
    # an edge is (end, start, id + 1), packed into one long, and its score; id + 1 is 0 for a byte edge
    number = (F.col("start") + F.col("size")).cast("long") * (1 << 40) + F.col("start").cast("long") * (1 << 24) + F.coalesce(F.col("id") + 1, F.lit(0))
    edge = F.struct(number.alias("e"), F.coalesce("score", F.lit(unknown)).alias("score"))
    lattice = edges.groupBy("unit").agg(F.collect_list(edge).alias("edges"), F.first("first").alias("first"))
    nothing = F.expr("named_struct('score', 0D, 'back', 0L, 'path', cast(array() as array<long>))")

    def step(best, position):
        coming = F.filter("edges", lambda e: F.shiftright(e["e"], 40) == position)

        def extended(e):
            start = F.shiftright(e["e"], 24).bitwiseAND(F.lit((1 << 16) - 1))
            before = F.element_at(best, start.cast("int"))
            return F.struct((before["score"] + e["score"]).alias("score"), (-start).alias("back"), F.concat(before["path"], F.array(e["e"])).alias("path"))

        return F.concat(best, F.array(F.array_max(F.transform(coming, extended))))

    ends = F.sequence(F.lit(2), F.length("unit") + 1)
    best = lattice.select("unit", "first", F.element_at(F.aggregate(ends, F.array(nothing), step), -1)["path"].alias("path"))

    def ids_of(e):
        piece = e.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
        character = F.substring(F.col("unit"), F.shiftright(e, 24).bitwiseAND(F.lit((1 << 16) - 1)).cast("int"), F.lit(1))
        return F.when(piece > 0, F.array(piece - 1)).otherwise(byte_pieces(character, byte_ids))

    return best.select("unit", "first", F.flatten(F.transform("path", ids_of)).alias("ids"))


def frequent_units(rows: DataFrame, cut: Callable[[pa.LargeStringArray], Coded], model_path: str, merges: bool) -> tuple[Broadcast, Broadcast]:
    """At most FREQUENT units that are frequent in a sample, by number, and apart from them their ids as
    offsets and one array, so that no task holds what it does not use. The bound holds by the numbers of
    units per size of their count, which are summed up before any unit is read."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    counts = rows.sample(share, seed=11).select("text").mapInArrow(partial(unit_counts, cut=cut), "unit string, n long").where("unit IS NOT NULL").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("size", F.floor(4 * F.log2("n")).cast("int")))
    total, least = 0, None
    for row in counts.groupBy("size").count().orderBy(F.desc("size")).collect():
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["size"]
    chosen = counts.where(F.col("size") >= F.lit(least)) if least is not None else counts.limit(0)
    chosen = chosen.select("unit", F.col("n").alias("first"))
    # an exchange deals the units out anew, as their lattice is many times larger than the counts
    units = chosen.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    ids = encoded_units(units, model_path, merges).toArrow().sort_by([("first", "descending"), ("unit", "ascending")]).combine_chunks()
    found = ids.column("ids").combine_chunks() if ids.num_rows else pa.array([], pa.list_(pa.int32()))
    offsets = found.offsets.to_numpy() - found.offsets[0].as_py() if len(found) else np.zeros(1, np.int32)
    context = rows.sparkSession.sparkContext
    numbers = context.broadcast(ids.column("unit").combine_chunks().cast(pa.large_string()))
    return numbers, context.broadcast((offsets, found.flatten().to_numpy().astype(np.int32)))


def encode(docs: DataFrame, model_path: str, merges: bool = False) -> DataFrame:
    """Columns (doc_id, n_units, ids) for each row of a stored table with doc_id and text."""
    cut = partial(uncut_units, path=model_path) if merges else listed_units
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent, frequent_ids = frequent_units(rows, cut, model_path, merges)
    parts = EDGE_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = rows.mapInArrow(partial(unit_rows, cut=cut, frequent=frequent), "chunk long, place int, unit string").where("unit IS NOT NULL").repartition(parts, "unit")
    # the first chunk of a unit rides along, so that both uses of the units read one exchange; filters that
    # the optimizer infers for one use only (from a join or an inner explode) would make them two
    ids = encoded_units(units.groupBy("unit").agg(F.min(F.struct("chunk", "place")).alias("first")), model_path, merges)
    met = units.join(ids.hint("merge"), "unit").where(F.col("first") <= F.struct("chunk", "place"))
    long = F.when(F.length("unit") > MERGE_CHARS, F.col("unit")) if merges else F.lit(None).cast("string")
    found = met.select("chunk", "place", "ids", long.alias("long")).mapInArrow(partial(pack_found, model_path=model_path), "chunk long, n int, m int, packed binary")
    places = rows.mapInArrow(partial(place_rows, cut=cut, frequent=frequent), "chunk long, packed binary")

    def put_back(known: pa.Table, docs: pa.Table) -> Iterator[pa.RecordBatch]:
        common_offsets, common_flat = frequent_ids.value
        place, own, values = [], [], []
        for n, m, part in zip(known.column("n").to_pylist(), known.column("m").to_pylist(), known.column("packed")):
            numbers = from_planes(pa.decompress(part.as_buffer(), decompressed_size=4 * (2 * n + m), codec="zstd", asbytes=True))
            place.append(np.cumsum(numbers[:n]))
            own.append(numbers[n : 2 * n])
            values.append(numbers[2 * n :])
        nothing = [np.zeros(0, np.int32)]
        sizes, found_ids = np.concatenate(own or nothing), np.concatenate(values or nothing)
        order = np.argsort(np.concatenate(place or nothing))
        starts, ends = (np.cumsum(sizes) - sizes)[order], np.cumsum(sizes[order])
        take = np.repeat(starts - (ends - sizes[order]), sizes[order]) + np.arange(len(found_ids))
        offsets = np.concatenate([common_offsets, common_offsets[-1] + ends])
        flat = np.concatenate([common_flat, found_ids[take]])
        size = np.diff(offsets)
        for part in docs.column("packed"):
            table = pa.ipc.open_stream(part.as_buffer()).read_all()
            counts = table.column("n").to_numpy()
            numbers = from_planes(table.column("planes")[0].as_py())
            if len(numbers) and int(numbers.max()) >= len(size):
                raise ValueError("a chunk's texts changed between two scans")
            out = []
            for at in np.split(numbers, np.cumsum(counts)[:-1]):
                ends = np.cumsum(size[at])
                out.append(flat[np.repeat(offsets[at] - (ends - size[at]), size[at]) + np.arange(ends[-1] if len(at) else 0)])
            columns = [table.column("doc_id").combine_chunks(), pa.array(counts.astype(np.int64)), lists(out)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_units", "ids"])

    def put_back_whole(known: pa.Table, docs: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("ids", pa.list_(pa.int32()))])
        return pa.Table.from_batches(list(put_back(known, docs)), schema)

    return found.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(put_back_whole, "doc_id long, n_units long, ids array<int>")


def decode_rows(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``encoded`` with the text its ids stand for."""
    names = encoded.columns
    at = names.index("ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, decoded = model(model_path)
        table = pa.array([p if isinstance(p, bytes) else p.encode() for p in decoded], pa.large_binary())
        for batch in batches:
            ids = batch.column(at)
            bounds, none = ids.offsets.to_numpy(), pa.array(np.asarray(ids.is_null()))
            # the pieces lie behind each other, so a text is a stretch of their bytes
            pieces = table.take(ids.values.slice(bounds[0], bounds[-1] - bounds[0]))
            _, offsets, data = pieces.buffers()
            ends = np.frombuffer(offsets, np.int64, len(pieces) + 1, 8 * pieces.offset)[bounds - bounds[0]]
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data])
            texts = pc.utf8_slice_codeunits(pc.replace_substring(whole.cast(pa.large_string()), MARK, " "), 1)
            texts = pc.if_else(none, pa.scalar(None, pa.large_string()), texts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(apply, f"{fields}, text string")
