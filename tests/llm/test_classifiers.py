"""Held-out accuracy of the classifiers, and their odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from plumbline.llm import quality, toxicity
from plumbline.llm.labels import learning_sample

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
SYLLABLES = "ka lo mi ren tu vas po zed ni gra".split()
INSULTS = "zorkel zorkin zorkaft bruxot bruxel bruxan".split()


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words))


def spread(rng, text, insults):
    words = text.split()
    for _ in range(max(1, len(words) // 40)):
        words.insert(rng.randrange(len(words) + 1), rng.choice(insults))
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(0)
    rows = []
    for i in range(600):
        text, toxic = prose(rng, rng.choice([12, 60, 300])), i % 4 == 0
        rows.append((i, spread(rng, text, INSULTS) if toxic else text, int(toxic)))
    return rows


def test_toxicity_held_out_and_unseen_spellings(spark, make_docs, toxic_rows):
    rng = random.Random(1)
    unseen = [(1000 + i, spread(rng, prose(rng, 60), ["zorkling", "bruxers", "ZORKEL!"])) for i in range(20)]
    odd = [(2000, None), (2001, ""), (2002, "..."), (None, "no id"), (2003, "word " * 150_000), (2004, "y" * 600_000)]
    docs = make_docs([(i, t) for i, t, _ in toxic_rows] + unseen + odd)
    labels = spark.createDataFrame([(i, None, y, "clash") for i, _, y in toxic_rows] + [(None, 1, 1, ""), (5, None, None, "")], LABELS)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == 626
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert i is None or r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i]["predicted"], y) for i, _, y in toxic_rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([got[i]["predicted"] for i, _ in unseen]) > 0.7
    assert np.mean([p for p, y in held if y == 0]) < 0.05
    assert got[2000]["score"] == got[2001]["score"] == got[2002]["score"]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_without_labels_everything_has_the_prior(spark, make_docs, name):
    scored = toxicity.scored if name == "toxic" else quality.scored
    for rows in ([], [(0, 1, 1, "")]):
        out = scored(make_docs(["a", None, "b"]), spark.createDataFrame(rows, LABELS)).collect()
        assert len(out) == 3 and len({r["score"] for r in out}) == 1
    assert scored(make_docs([]), spark.createDataFrame([], LABELS)).collect() == []


def test_windows_hold_every_word():
    rng = random.Random(2)
    text = prose(rng, 100)
    buckets, words = toxicity.subwords(text)
    assert words.max() == 99 and set(words.tolist()) == set(range(100))
    bag, size = toxicity.sample_windows(text)
    assert len(size) == 13 and size.sum() == len(bag) == len(buckets)
    assert toxicity.subwords("")[0].size == 0 and toxicity.subwords(" ., ")[0].size == 0


def junk(rng, words, kind):
    parts = prose(rng, words).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in parts)
    if kind == 1:
        return " | ".join(parts)
    return " ".join(w for w in parts[: words // 8 + 1] for _ in range(8))


def test_quality_held_out(spark, make_docs):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        bad = i % 5 == 0
        text = junk(rng, rng.choice([20, 80, 200]), i % 3) if bad else ". ".join(prose(rng, 9).capitalize() for _ in range(rng.choice([3, 10, 25]))) + "."
        rows.append((i, text, f"src{rng.randrange(5)}", int(not bad)))
    odd = [(2000, None), (2001, ""), (None, "no id")]
    docs = make_docs([r[:3] for r in rows] + odd)
    labels = spark.createDataFrame([(i, y, None, "clash") for i, _, _, y in rows if i % 3], LABELS)
    out = quality.scored(docs, labels)
    assert "component_id" in out.columns
    got = {r["doc_id"]: r for r in out.select("doc_id", "held_out", "score", "p_text", "p_meta", "predicted").collect()}
    assert len(got) == 703
    held = [(got[i]["predicted"], y) for i, _, _, y in rows if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= got[i][c] <= 1 for i in got for c in ("score", "p_text", "p_meta"))


def test_pseudo_labels_cross_the_views():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, quality.TEXT_SIZE + quality.META_SIZE)) * 0.1
    x[:, 0] += 2 * y
    x[:, quality.TEXT_SIZE] += 2 * y
    pool = rng.normal(size=(300, x.shape[1])) * 0.1
    side = rng.integers(0, 2, 300)
    pool[:, 0] += 2 * side
    pool[:, quality.TEXT_SIZE] += 2 * side
    given = []

    def name(weights, taken, counts):
        found = [(view, label, rows, pool[rows]) for view, label, _, rows in quality.surest(pool, np.arange(300), weights, taken, counts)]
        given.extend((1 - view, i) for view, _, ids, _ in found for i in ids.tolist())
        return found

    found = quality.co_train(x, y, np.arange(60) % 4 + 1, name)
    assert len(given) == len(set(given)) > 100
    assert np.mean((quality.logit(found["text"], pool[:, : quality.TEXT_SIZE]) > 0) == side) > 0.95
    assert np.mean((quality.logit(found["meta"], pool[:, quality.TEXT_SIZE :]) > 0) == side) > 0.95


def test_a_rare_source_enters_the_exchange(spark):
    """The surest rows of all stored rows are named, wherever they are."""
    rng = np.random.default_rng(5)
    pool = rng.normal(size=(500, quality.TEXT_SIZE + quality.META_SIZE)) * 0.01
    pool[123, 0] = pool[321, quality.TEXT_SIZE] = 30
    rows = [(p.astype(np.float16).tobytes(), i) for i, p in enumerate(pool)]
    stored = spark.createDataFrame(rows, "x binary, id long").repartition(7)
    weights = [np.zeros(quality.TEXT_SIZE + 1), np.zeros(quality.META_SIZE + 1)]
    weights[0][0] = weights[1][0] = 1.0
    none = [np.zeros(0, np.int64)] * 2
    got = [(view, label, ids.tolist()) for view, label, ids, _ in quality.namer(stored)(weights, none, (5, 5))]
    assert got == [(0, 1, [123]), (1, 1, [321])]
    assert quality.namer(stored)(weights, [np.array([321]), np.array([123])], (5, 5)) == []


def test_a_repeated_id_gives_one_learning_row(spark, make_docs):
    docs = make_docs([(7, f"text {i % 9}") for i in range(3000)] + [(8, None), (8, None), (9, "x"), (None, "y")])
    marks = spark.createDataFrame([(i, 1, i % 2, "") for i in (7, 8, 9)] + [(7, 0, 0, "")], LABELS)
    rows = learning_sample(docs, marks, "toxic", (100, 100), ["text"]).collect()
    assert sorted((r["doc_id"], r["y"]) for r in rows) == sorted((i, i % 2) for i in (7, 8, 9) if zlib.crc32(str(i).encode()) % 5)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_clashing_columns_survive_beside_the_scores(spark, make_docs, toxic_rows, module):
    docs = make_docs([(i, t) for i, t, _ in toxic_rows[:200]]).withColumnsRenamed({"score": "predicted", "length": "label_id", "component_id": "score"})
    marks = spark.createDataFrame([(i, 1 - y, y, "clash") for i, _, y in toxic_rows], LABELS)
    out = module.marked(docs, marks)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {(r["predicted"], r["score"]) for r in out.collect()} == {("clash", "clash")}
    result = module.scored(docs, marks)
    assert result.columns.count("score") == result.columns.count("predicted") == 1 and "label_id" in result.columns
    assert all(0 <= r["score"] <= 1 for r in result.collect())
