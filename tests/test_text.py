import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.blocks import chunk_blocks, clean_text, heading, page_blocks, tidy
from plumbline.functions.hashing import Memo, gram_vector, word_vector
from plumbline.functions.html import outline_blocks
from plumbline.operators import chunks as ch
from plumbline.operators import queries as qb
from plumbline.operators import retrieval as rt
from plumbline.plans import views


def test_clean_text(spark):
    dirty = "Rolling bear-\ning damage   analysis\n\nISO 15243"
    assert tidy(dirty) == "Rolling bearing damage analysis\n\nISO 15243"
    assert spark.createDataFrame([(dirty,)], "t string").select(clean_text("t")).first()[0] == tidy(dirty)
    assert tidy(" a­ b \n \t\n\n c\r\nd ") == "a b\n\nc d"


def test_heading_and_page_blocks(spark):
    assert heading("ab\nEnds here.\n  Real   title \nx") == "Real title"
    rows = spark.createDataFrame([(["Title one\ntext", "  ", "more"],)], "p array<string>").select(page_blocks("p")).first()[0]
    assert [(r.page, r.section) for r in rows] == [(1, "Title one"), (3, "more")]


def test_chunk_windows(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([("d", text)], "document_id string, t string")
    blocks = F.array(F.struct(F.lit(1).alias("page"), F.lit("s").alias("section"), F.col("t").alias("text")))
    rows = ch.chunk_documents(docs, blocks, max_tokens=10, overlap=2).orderBy("chunk_index").collect()
    assert [r.tokens for r in rows] == [10, 10, 9]
    assert rows[1].content.split()[0] == "t8"
    section = hashlib.sha1(b"s").hexdigest()[:8]
    assert rows[2].chunk_id == f"d:p0001:s{section}:c0002"
    with pytest.raises(ValueError):
        chunk_blocks(5, 5)


def test_neighbouring_blocks_merge(spark):
    rows = [(None, "A", "x"), (None, "A", "y"), (None, "B", "z"), (None, "A", "w")]
    df = spark.createDataFrame([("d", rows)], "document_id string, b array<struct<page:int,section:string,text:string>>")
    got = ch.with_merged_blocks(df, "b").select(F.inline("b")).collect()
    assert [(r.section, r.text) for r in got] == [("A", "x\n\ny"), ("B", "z"), ("A", "w")]
    assert ch.chunk_documents(df, F.col("b")).count() == 3


def test_html_blocks():
    page = """<html><body><nav><p>menu</p></nav><main><h1>Top &amp; first</h1><p>One <b>two</b></p><script>var t="</p>";</script>
      <ul><li><p>inner</p></li></ul><table><tr><td>a</td><td>b</td></tr></table><form><p>no</p></form></main><p>outside</p></body></html>"""
    assert outline_blocks(page) == [
        {"section": "Top & first", "text": "One two", "element": "p"},
        {"section": "Top & first", "text": "inner", "element": "li"},
        {"section": "Top & first", "text": "a b", "element": "table"},
    ]
    assert outline_blocks("<body>just <i>text</i></body>") == [{"section": None, "text": "just text", "element": "body"}]
    assert [b["text"] for b in outline_blocks("<body><p>a<p>b</body>")] == ["a b", "b"]


def test_html_elements_do_not_keep_their_ancestors():
    """Memory of a page follows its length, also where thousands of tags stay open."""
    page = "<body><p>top</p>" + "<b>t" * 4000 + "<li><p>in</p></li>" + "</i>" * 4000 + "</body>"
    tracemalloc.start()
    try:
        found = outline_blocks(page)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(b["element"], b["text"]) for b in found] == [("p", "top"), ("li", "in")] and peak < 16 << 20


def test_packing(spark):
    df = spark.createDataFrame([("One two. Three! Four five six?  Seven.",)], "t string")
    assert df.select(tx.pack_sentences(F.col("t"), 16)).first()[0] == ["One two. Three!", "Four five six?", "Seven."]


def test_page_section(spark):
    df = spark.createDataFrame([(5,), (10,), (30,)], "p int")
    got = df.select(tx.page_section(F.col("p"), {(5, 5): "a", (9, 13): "b"}, "rest")).collect()
    assert [r[0] for r in got] == ["a", "b", "rest"]


def test_feature_text(spark):
    df = spark.createDataFrame([({"rms": 130.2335, "peak": 1234567.0, "kurtosis": 0.0},)], "m map<string,double>")
    assert df.select(tx.feature_text("m")).first()[0] == "signal feature kurtosis 0 signal feature peak 1.23457e+06 signal feature rms 130.233"


def test_vectors(spark):
    df = spark.createDataFrame([("Bearing ① bearing a",)], "t string")
    words = df.select(word_vector("t")).first()[0]
    assert len(words) == 384 and sum(words) == 3  # two words and one pair; one-letter words do not count
    grams = df.select(gram_vector("t")).first()[0]
    same = spark.createDataFrame([("bearing 1 bearing a",)], "t string").select(gram_vector("t")).first()[0]
    assert len(grams) == 512 and grams == same  # compatibility forms are folded


def test_filters():
    for bad in ({"unknown": 1}, {"source_tier_lte": 5}, {"source_id": ["a"]}, {"source_id_in": []}, {"title_in": ["a"]}):
        with pytest.raises(ValueError):
            rt.compile_filter(bad)
    base = {"knowledge_pack_id": "p", "component": "bearing", "source_tier_lte": 2, "source_id_in": ["a", "b"]}
    assert rt.narrow_filter(base, {"source_tier_lte": 3, "source_id_in": ["b", "z"]})["source_id_in"] == ["b"]
    for bad in ({"component": "x"}, {"source_id": "z"}, {"source_id_in": ["z"]}, {"source_tier_lte": "1"}, {"source_id_in": "a"}):
        with pytest.raises(ValueError):
            rt.narrow_filter(base, bad)


def test_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("source", "source_id")
    plan = df.filter(rt.compile_filter({"source_id_in": ["src1"]}))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(source" in plan or "EqualTo(source,src1)" in plan


def greedy(rows, k):
    kept = []
    for row in sorted(rows):
        words = set(row[4])
        near = any(
            o[2] == row[2] and abs(o[3] - row[3]) <= 1 and len(words & set(o[4])) / max(1, min(len(words), len(set(o[4])))) >= 0.75 for o in kept
        )
        if not near and len(kept) < k:
            kept.append(row)
    return [r[1] for r in kept]


def test_suppression_against_brute_force(spark):
    rows = []
    for i in range(20):
        words = [f"w{(i // 3) * 10 + j}" for j in range(6)] + [f"x{i % 5}"]
        rows.append((i + 1, f"d{i % 2}:c{i // 2:04d}", f"d{i % 2}", i // 2, words))
    df = spark.createDataFrame([("q", *r) for r in rows], "query_id string, rank bigint, chunk_id string, document_id string, chunk_index bigint, words array<string>")
    got = [r.chunk_id for r in rt.suppress_duplicates(df, 5).orderBy("rank").collect()]
    assert got == greedy(rows, 5) and len(got) == 5


def test_topk_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 4)
    queries = spark.createDataFrame([(f"q{i}", [1, i % 3], 4, None) for i in range(9)], "query_id string, vector array<int>, max_tier int, sources array<string>")
    chunks = spark.createDataFrame([(f"c{i:02d}", "s", 1 + i % 4, [1, 1]) for i in range(12)], "chunk_id string, source_id string, source_tier int, vector array<int>")
    got = rt.vector_topk(rt.with_norm(queries), rt.with_norm(chunks), 3).collect()
    best = {}
    for r in got:
        best.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    assert len(best) == 9
    assert all(sorted(v) == [(1, "c00"), (2, "c01"), (3, "c02")] for v in best.values())


def test_translation(spark):
    asked = ["베어링 외륜 손상의 주요 진동 특징은?", "윤활 부족 소음", "bearing noise", "  ", "고장 원인"]
    df = spark.createDataFrame([(a,) for a in asked], "question string")
    got = {r.question: r for r in qb.translate(df).collect()}
    assert got[asked[0]].search_query == "bearing outer race damage vibration characteristics"
    assert (got[asked[1]].method, got[asked[1]].unmapped, got[asked[1]].complete) == ("SAFE_FALLBACK", "소음", False)
    assert got[asked[2]].method == "DIRECT" and got[asked[3]].method == "EMPTY"
    assert got[asked[4]].search_query == "fault causes" and got[asked[4]].translated


def test_calibration_needs_a_gap(spark):
    good = spark.createDataFrame([(True, 0.2), (False, 0.1)], "supported boolean, score double")
    assert rt.calibrate(good).first().threshold == pytest.approx(0.15)
    with pytest.raises(Exception, match="separable"):
        rt.calibrate(spark.createDataFrame([(True, 0.1), (False, 0.2)], "supported boolean, score double")).collect()


def test_topk_scores_exactly_only_what_may_enter(spark, monkeypatch):
    """Lists equal brute force over several tiles and filters, and few pairs are scored in double precision."""
    monkeypatch.setattr(rt, "QUERY_BLOCK", 64)
    rng = np.random.default_rng(3)
    stock = rng.poisson(0.6, (3000, 32)).astype(np.int32)
    stock[::50] = stock[7]  # ties
    stock[5], asked = 0, rng.poisson(0.6, (150, 32)).astype(np.int32)
    asked[4] = 0
    sources = [None if i % 3 == 0 else ["s1", "s2"] if i % 3 == 1 else ["none"] for i in range(len(asked))]
    queries = spark.createDataFrame([(f"q{i}", v.tolist(), 1 + i % 3, sources[i]) for i, v in enumerate(asked)], "query_id string, vector array<int>, max_tier int, sources array<string>")
    chunks = spark.createDataFrame([(f"c{i:04d}", f"s{i % 4}", 1 + i % 4, v.tolist()) for i, v in enumerate(stock)], "chunk_id string, source_id string, source_tier int, vector array<int>")
    got = {}
    for r in rt.vector_topk(rt.with_norm(queries), rt.with_norm(chunks), 5, chunk_tiles=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
    for i, v in enumerate(asked):
        scale = np.sqrt((v.astype(float) ** 2).sum()) * np.sqrt((stock.astype(float) ** 2).sum(axis=1))
        score = np.round(np.divide(stock @ v, scale, out=np.zeros(len(stock)), where=scale > 0), 9)
        open_to = [c for c in range(len(stock)) if c % 4 <= i % 3 and (sources[i] is None or f"s{c % 4}" in sources[i])]
        want = sorted((-score[c], f"c{c:04d}") for c in open_to)[:5]
        assert [got.get(f"q{i}", {})[n] for n in sorted(got.get(f"q{i}", {}))] == [(c, -s) for s, c in want]

    scored = []
    monkeypatch.setattr(rt.np, "einsum", lambda form, a, b, plain=np.einsum: scored.append(len(a)) or plain(form, a, b))
    frame = lambda vectors, **more: pd.DataFrame({"vector": list(vectors), "norm": np.sqrt((vectors.astype(float) ** 2).sum(axis=1)), "id": [str(i) for i in range(len(vectors))], "tier": 1, **more})
    tile = rt._Asked(frame(asked, sources=None), 5)
    tile.meet(frame(stock, source_id="s"))
    assert sum(scored) < len(asked) * len(stock) // 10


def test_equal_scores_do_not_pile_up():
    """A batch of copies ties with every question's list; the pairs are ranked as they come, not all at once."""
    frame = lambda n, **more: pd.DataFrame({"vector": [np.eye(1, 8, dtype=np.int32)[0]] * n, "norm": 1.0, "id": [f"{i:05d}" for i in range(n)], "tier": 1, **more})
    tile, stock = rt._Asked(frame(800, sources=None), 5), frame(2000, source_id="s")
    tracemalloc.start()
    try:
        tile.meet(stock)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20
    assert tile.rows().groupby("query_id")["chunk_id"].agg(list).tolist() == [[f"{i:05d}" for i in range(5)]] * 800


def test_python_gets_batches_bounded_by_bytes(spark, tmp_path):
    """A table's long texts reach a Python worker a few megabytes at a time, however many rows a task has."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10_000).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    size = F.pandas_udf(lambda texts: pd.Series([int(texts.str.len().sum())] * len(texts)), "long")
    sizes = views.table(spark, str(tmp_path), "documents").select(size("text").alias("n")).agg(F.max("n").alias("n"), F.count("n").alias("rows")).first()
    assert sizes.rows == 600 and sizes.n < 6 << 20


def test_remembered_tokens_stay_few():
    memo = Memo(len)
    for i in range(100_000):
        memo[str(i)]
    assert len(memo) <= 1 << 16


def test_long_tokens_are_not_remembered():
    memo = Memo(len)
    assert [memo["x" * n] for n in (64, 65, 100_000)] == [64, 65, 100_000] and [len(token) for token in memo] == [64]
