"""Quality classifier by co-training a text view and a metadata view.

Contract: every document gets p_text and p_meta (the calibrated views), their combination score, all
between 0 and 1 (higher: quality 1 likelier), held_out (fold 0 of crc32 of the id modulo five) and
predicted = 1 at 0.5 or more. Labels are learned only outside fold 0. Null and empty texts are scored
as texts without words, null metadata as values of their own. Repeated rows and ties are scored alike, also
under one or no doc_id; without labelled rows of both classes every document gets the same prior score; an
empty table gives no rows. Extra columns pass through, but those named like columns of the result give way
to them (``marked`` keeps them).

Method: the text view sees shares of character classes, repetition and hashed trigrams of character
classes; the metadata view sees source, lang, n_chars and the layout in lines. Both are logistic
regressions in numpy. They start from the labelled rows of folds 2 to 4; in every round each view scores all
unlabelled documents and names those it is surest about, in the classes' shares, and these go with its labels
into the other view's training rows. Fold 1 then calibrates each view and weighs the two.

Learning takes at most SAMPLE labelled rows of each class as feature vectors of fixed length. The vectors of
all unlabelled documents are stored once, equal ones once; a round reads them where they are, and a ranking
that is limited in every task hands on at most PER_ROUND of them to the trainer for each view. Scoring reads
every whole text in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, stored
from plumbline.llm.labels import fold, label_of, learning_sample

SAMPLE = 2000
ROUNDS = 5
SURE = 0.95
PER_ROUND = 200
CLASSES = 8
HASHED = 64
PENALTY = 1e-3
CHARS_AT_ONCE = 1 << 20
TEXT_SIZE = CLASSES**3 + CLASSES + 5
META_SIZE = 2 * HASHED + 8
VIEWS = (slice(0, TEXT_SIZE), slice(TEXT_SIZE, TEXT_SIZE + META_SIZE))
P_TEXT, P_META, SCORE = "__quality_p_text", "__quality_p_meta", "__quality_score"
#: Fixed character classes: lower, upper, digit, space, line feed, full stop or comma, ASCII sign, the rest.
LOWER, UPPER, DIGIT, BLANK, FEED, STOP, SIGN, REST = range(CLASSES)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point."""

    def kind(c: str) -> int:
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        if c.isdigit():
            return DIGIT
        if c == "\n":
            return FEED
        if c.isspace():
            return BLANK
        return STOP if c in ".," else SIGN if c < "\x80" else REST

    return np.fromiter((kind(chr(i)) for i in range(0x110000)), np.int16, 0x110000)


def text_features(text: str) -> np.ndarray:
    """Text view: trigram and single shares of character classes, word length and repetition."""
    trigrams, singles = np.zeros(CLASSES**3), np.zeros(CLASSES)
    for at in range(0, len(text), CHARS_AT_ONCE):
        part = text[max(at - 2, 0) : at + CHARS_AT_ONCE]
        kinds = character_classes()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        trigrams += np.bincount((kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:], minlength=CLASSES**3)
        singles += np.bincount(kinds[min(at, 2) :], minlength=CLASSES)
    words = text.split()
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    n = max(len(words), 1)
    shape = [distinct / n, distinct / n**0.8, repeats / n, (singles.sum() - singles[BLANK] - singles[FEED]) / n / 10, float(not words)]
    return np.concatenate([np.sqrt(trigrams / max(trigrams.sum(), 1)), singles / max(singles.sum(), 1), shape])


def meta_features(source: str | None, lang: str | None, n_chars: int | None, text: str) -> np.ndarray:
    """Metadata view: hashed source and lang, size, and layout in lines."""
    hot = np.zeros(2 * HASHED)
    hot[zlib.crc32(repr(source).encode()) % HASHED] = 1
    hot[HASHED + zlib.crc32(repr(lang).encode()) % HASHED] = 1
    feeds = text.count("\n")
    size = np.log1p(max(n_chars or 0, 0))
    first = len(text) if feeds == 0 else text.index("\n")
    layout = [size / 10, (size / 10) ** 2, np.log1p(feeds) / 5, np.log1p(len(text) / (feeds + 1)) / 10, np.log1p(first) / 10]
    return np.concatenate([hot, layout, [float(n_chars is None), float(feeds == 0), float(not text)]])


def features_of(rows: DataFrame, extra: list[str], kind: type = np.float32) -> DataFrame:
    """Feature vectors of both views, packed as numbers of a kind, beside the named columns."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [vectors_of(*(batch.column(i)[row].as_py() for i in range(4))) for row in range(batch.num_rows)]
            packed = pa.array([np.concatenate(v).astype(kind).tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[4:]], names=["x", *extra])

    columns = rows.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[4:])
    return columns.mapInArrow(apply, "x binary" + (f", {fields}" if fields else ""))


def vectors_of(text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    return text_features(text), meta_features(source, lang, n_chars, text)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty * len(x))
    ridge[-1] = 1e-6
    for _ in range(12):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


Named = tuple[int, int, np.ndarray, np.ndarray]
Namer = Callable[[list[np.ndarray], list[np.ndarray], tuple[int, int]], list[Named]]


def surest(x: np.ndarray, ids: np.ndarray, weights: list[np.ndarray], taken: list[np.ndarray], counts: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per view and label its surest rows (view, label, certainty, rows), at most ``counts`` of a label, without
    those that the other view has been given; equal certainty goes by id."""
    for view, part in enumerate(VIEWS):
        p = sigmoid(logit(weights[view], x[:, part]))
        for label in (0, 1):
            sure = p if label else 1 - p
            rows = np.flatnonzero((sure >= SURE) & ~np.isin(ids, taken[1 - view]))
            rows = rows[np.lexsort([ids[rows], -sure[rows]])][: counts[label]]
            yield view, label, sure[rows], rows


def co_train(x: np.ndarray, y: np.ndarray, folds: np.ndarray, name: Namer) -> dict[str, np.ndarray]:
    """Weights of both views, their calibrations and their combination. ``name`` gives (view, label, ids, rows)
    of the unlabelled rows that the views are surest about."""
    learn, hold = folds != 1, folds == 1
    if len(np.unique(y[hold])) < 2 or len(np.unique(y[learn])) < 2:
        learn = hold = np.ones(len(y), bool)
    rows = [(x[learn], y[learn].astype(float)) for _ in VIEWS]
    share = y[learn].mean()
    counts = (round(PER_ROUND * (1 - share)), round(PER_ROUND * share))
    taken = [np.zeros(0, np.int64) for _ in VIEWS]
    for _ in range(ROUNDS):
        weights = [fit(rx[:, v], ry) for v, (rx, ry) in zip(VIEWS, rows)]
        for view, label, ids, named in name(weights, taken, counts):
            other = 1 - view
            taken[other] = np.concatenate([taken[other], ids])
            rows[other] = (np.vstack([rows[other][0], named]), np.append(rows[other][1], np.full(len(named), float(label))))
    weights = [fit(rx[:, v], ry) for v, (rx, ry) in zip(VIEWS, rows)]
    scales = [fit(logit(w, x[hold][:, v])[:, None], y[hold]) for w, v in zip(weights, VIEWS)]
    both = np.stack([logit(s, logit(w, x[hold][:, v])[:, None]) for s, w, v in zip(scales, weights, VIEWS)], axis=1)
    return {"text": weights[0], "meta": weights[1], "text_scale": scales[0], "meta_scale": scales[1], "both": fit(both, y[hold])}


def matrix_of(packed: list[bytes], kind: type = np.float32) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in packed]).astype(np.float64) if packed else np.zeros((0, TEXT_SIZE + META_SIZE))


def namer(pool: DataFrame) -> Namer:
    """Names the surest of all rows (x, id) of a stored pool, with x in half precision."""

    def name(weights: list[np.ndarray], taken: list[np.ndarray], counts: tuple[int, int]) -> list[Named]:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids = matrix_of(batch.column(0).to_pylist(), np.float16), batch.column(1).to_numpy()
                for view, label, sure, rows in surest(x, ids, weights, taken, counts):
                    if len(rows):
                        part = batch.take(pa.array(rows))
                        columns = [pa.array(np.full(len(rows), v, np.int32)) for v in (view, label)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(sure), part.column(1), part.column(0)], names=["view", "label", "sure", "id", "x"])

        found = pool.select("x", "id").mapInArrow(apply, "view int, label int, sure double, id long, x binary")
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "id"))
        best = found.withColumn("place", place).where((F.col("place") <= max(counts)) & (F.col("place") <= F.when(F.col("label") == 1, counts[1]).otherwise(counts[0])))
        rows = best.orderBy("view", "label", "place").collect()
        groups = [[r for r in rows if (r["view"], r["label"]) == slot] for slot in ((0, 0), (0, 1), (1, 0), (1, 1))]
        return [(g[0]["view"], g[0]["label"], np.array([r["id"] for r in g], np.int64), matrix_of([r["x"] for r in g], np.float16)) for g in groups if g]

    return name


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on the bounded labelled sample and all unlabelled rows; without both classes the model is a prior share."""
    columns = ["text", "source", "lang", "n_chars"]
    known = features_of(learning_sample(docs, labels, "quality", (sample, sample), columns), ["y", "fold"]).collect()
    y = np.array([row["y"] for row in known], np.int64)
    if len(np.unique(y)) < 2:
        return {"prior": (y.sum() + 1) / (len(y) + 2)}
    labelled = label_of(labels, "quality").select("__label_id")
    vectors = features_of(docs.select(*columns, "doc_id"), ["doc_id"], np.float16).withColumn("id", F.xxhash64("x"))
    # vectors meet the labels and not texts, by a merge join at every size
    open_rows = vectors.join(labelled.hint("merge"), F.col("doc_id") == F.col("__label_id"), "left_anti")
    pool = stored(open_rows.select("x", "id").dropDuplicates(["id"]))
    return co_train(matrix_of([row["x"] for row in known]), y, np.array([row["fold"] for row in known]), namer(pool))


def marked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` and the three scores under reserved names."""
    bounded_batches(docs)
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, sample))
    added = [P_TEXT, P_META, SCORE]
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = np.full((3, batch.num_rows), m.get("prior", 0.0))
            if "prior" not in m:
                inputs = [batch.column(at), *batch.columns[-3:]]
                for row in range(batch.num_rows):
                    text, source, lang, n_chars = (column[row].as_py() for column in inputs)
                    views = vectors_of(text, source, lang, n_chars)
                    by_text = logit(m["text_scale"], np.array([logit(m["text"], views[0])]))
                    by_meta = logit(m["meta_scale"], np.array([logit(m["meta"], views[1])]))
                    out[:, row] = sigmoid(np.array([by_text, by_meta, logit(m["both"], np.array([by_text, by_meta]))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(v) for v in out)], names=[*batch.schema.names[:-3], *added])

    texts = docs.withColumn("text", F.col("text").cast("string"))
    metadata = [F.col(name).cast(kind).alias(f"__quality_{name}") for name, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    fields = [*texts.schema.fields, *(T.StructField(name, T.DoubleType()) for name in added)]
    return texts.select("*", *metadata).mapInArrow(apply, T.StructType(fields))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns doc_id, held_out, p_text, p_meta, score, predicted and the remaining columns of ``docs``."""
    out = marked(docs, labels, sample)
    others = [c for c in docs.columns if c not in ("doc_id", "held_out", "p_text", "p_meta", "score", "predicted")]
    scores = [F.col(P_TEXT).alias("p_text"), F.col(P_META).alias("p_meta"), F.col(SCORE).alias("score")]
    return out.select("doc_id", (fold() == 0).alias("held_out"), *scores, (F.col(SCORE) >= 0.5).cast("int").alias("predicted"), *others)
