"""Exact top-k and embedding near copies against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from plumbline.llm import embedding_dedup, topk
from plumbline.llm.common import components, merge_labels

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("rank", T.StringType()),
    ]
)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "clash") for i, v in rows], VECTORS)


def plain_top_k(rows, k):
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.choice([-0.5, -0.25, 0.0, 0.25], 6)) for i in range(150)]
    rows += [(160, None), (180, [float("nan")] * 6), (200, [None] * 6), (None, [0.1] * 6), (220, [float("inf")] * 6), (240, []), (241, [1.0, 2.0])]
    rows += [rows[0], rows[0]]
    got = topk.embedding_top_k(vectors_of(spark, rows), k=5)
    want = plain_top_k(rows[:-2], 5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


@pytest.mark.parametrize("kind", ["cluster", "flat", "large"])
def test_block_search_is_exact(kind):
    rng = np.random.default_rng(1)
    v = rng.integers(-30, 30, (900, 16))
    if kind == "cluster":
        v[:300] = v[0] + rng.integers(-2, 3, (300, 16))
    if kind == "large":
        v = v * 10**9
    ids = np.arange(900) * 3
    parts = topk.search_block(ids[:60], v[:60], ids, v, 7)
    got = sorted(zip(*(np.concatenate([p[i] for p in parts]).tolist() for i in range(3))))
    want = []
    for q in range(60):
        scores = [(-int(sum(int(x) * int(y) for x, y in zip(v[q], v[j]))), j) for j in range(900) if j != q]
        want += [(q, j, max(min(-s, 2**63 - 1), -(2**63))) for s, j in sorted(scores)[:7]]
    assert got == sorted(want)


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8)) for i in range(200)]
    got = topk.embedding_top_k(vectors_of(spark, rows), k=9)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top_k(rows, 9)


def test_empty_vectors(spark):
    assert topk.embedding_top_k(vectors_of(spark, [])).collect() == []
    assert embedding_dedup.near_vectors(vectors_of(spark, [])).collect() == []


def near_rows(seed, groups, spread, dims=64):
    """Groups of vectors whose cosines lie around 0.9 and above, and single ones."""
    rng = np.random.default_rng(seed)
    out = []
    for size in groups:
        base = rng.normal(size=dims)
        for _ in range(size):
            noise = rng.normal(size=dims)
            out.append(base + spread * noise)
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[j]) for i, j in zip(range(len(out)), order)]


@pytest.mark.parametrize("spread,least,dims", [(0.05, 1.0, 64), (0.2, 0.99, 64), (0.3, 0.9, 64), (0.2, 0.97, 16), (0.3, 0.9, 32)])
def test_near_vectors_recall(spark, spread, least, dims):
    rows = near_rows(4, [1] * 300 + [2] * 60 + [5] * 20 + [150], spread, dims)
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in rows])
    label = ids[merge_labels(len(ids), *np.nonzero(near))]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(vectors_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert least * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= n for i, n in zip(ids.tolist(), near.sum(axis=1).tolist()))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    if found == near.sum():
        assert [got[i]["component_id"] for i in ids.tolist()] == label.tolist()


@pytest.mark.parametrize("dims", [8, 16, 32, 64, 100])
def test_every_segment_of_a_code_varies(dims):
    unit = np.random.default_rng(6).normal(size=(5000, dims))
    codes = embedding_dedup.codes_of(unit, embedding_dedup.rotation(unit))
    for number in range(len(embedding_dedup.SEGMENTS)):
        assert np.unique(embedding_dedup.segment(codes, number), return_counts=True)[1].max() < 0.05 * len(unit)


def test_near_vectors_odd_rows(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (9, [1e-30, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (3, None), (4, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(vectors_of(spark, rows)).collect())
    assert got == [(1, 0, 1, True), (2, 2, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 2, False), (6, 0, 6, True), (7, 0, 7, True), (9, 2, 2, False)]


def test_dense_keys_are_cut_into_stripes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "GRID_ROWS", 16)
    rows = near_rows(5, [70, 3, 1], 0.05)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(vectors_of(spark, rows)).collect()}
    assert sorted(got.values()) == [0] + [2] * 3 + [69] * 70


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(300, 301), (301, 300), (5, 5)]
    got = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {(i, 100) for i in range(100, 161)} | {(7, 7)} | {(i, 7) for i in range(8, 60)} | {(300, 300), (301, 300)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
