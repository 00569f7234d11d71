"""Ranked lexical search against plain integer arithmetic per document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from plumbline.llm import ranked_search

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, counts in held:
            m = 100 - 75 + 75 * counts.total() * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * counts[w] // (1000 * counts[w] + 8 * m)) for w in terms(text) if df[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame([(*item, "clash", "clash") for item in items], ITEMS)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def case():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Été", "É", "x_y", "A1", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(90)]
    texts += [texts[0]] * 40 + [None, "", " \n", "_ _", "w1 " * 5000, "w2" * 40_000]
    docs = [(i * 13 % 499, t) for i, t in enumerate(texts)] + [(5, "w1 w2"), (5, "w1 w2"), (5, "other w3"), (None, texts[0]), (None, "w9")]
    items = [(i, rng.choice(texts[:90])) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w1 w1 W1 w2"), (53, "w1 w1 W1 w2"), (53, "w9"), (None, "w4 w5")]
    return docs, items


def test_against_plain_scores(spark, make_docs):
    docs, items = case()
    got = ranked_search.top_documents(make_docs(docs), asked(spark, items), 10)
    assert rows(got) == plain(docs, items, 10)


def test_blocks_and_tiles_change_nothing(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(ranked_search, "ITEM_TILE", 3)
    docs, items = case()
    got = ranked_search.top_documents(make_docs(docs), asked(spark, items), 4)
    assert rows(got) == plain(docs, items, 4)


def test_empty_sides(spark, make_docs):
    assert rows(ranked_search.top_documents(make_docs([]), asked(spark, [(1, "a")]))) == []
    assert rows(ranked_search.top_documents(make_docs(["a"]), asked(spark, []))) == []
    assert rows(ranked_search.top_documents(make_docs([None, ""]), asked(spark, [(1, "a"), (2, None)]))) == []


@pytest.mark.parametrize("tile", [2, 2048])
def test_products_stay_exact_beyond_double_precision(monkeypatch, tile):
    monkeypatch.setattr(ranked_search, "VOCABULARY_TILE", tile)
    rng = np.random.default_rng(2)
    items = [(list(range(7)), rng.integers(1, 4 * ranked_search.MOST_WEIGHT, 7).tolist()) for _ in range(5)] + [([], []), ([3], [1])]
    one = ranked_search.ItemTile(0, items)
    doc, term = np.repeat(np.arange(6), 7), np.tile(np.arange(7), 6)
    impact = rng.integers(1, ranked_search.MOST_IMPACT + 1, 42)
    got = one.scores(6, doc, term, impact, 9)
    want = [[sum(w * int(impact[d * 7 + t]) for t, w in zip(*item)) for d in range(6)] for item in items]
    assert got.tolist() == want


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "TEXT_PART", 10)
    text = "Ab cde, fgh'ijk é1 " * 50 + "x" * 100
    assert ranked_search.terms_of(text.encode()) == Counter(t.encode() for t in terms(text))
