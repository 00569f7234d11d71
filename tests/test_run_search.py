"""Searches for the queries of many runs: each text and each vector once, evidence united by reference."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import retrieval as rt, workflow as wf
from plumbline.session import stored


def asked_rows(spark):
    rows = [(f"r{i}", o, wf.DIAGNOSTIC if o == 1 else wf.INSPECTION, "all ask this" if o == 1 else f"text {i % 7}") for i in range(60) for o in (1, 2)]
    rows += [("r3", 1, wf.DIAGNOSTIC, "all ask this"), (None, 1, wf.DIAGNOSTIC, "all ask this"), (None, 2, wf.INSPECTION, "text 1")]  # a run that comes twice, runs without an id
    return spark.createDataFrame(rows, "run_id string, ordinal bigint, purpose string, query_text string")


def corpus(texts):
    """``text 1`` finds a chunk that all runs have already; ``text 6`` finds none."""
    number = F.regexp_extract("question", r"text (\d)", 1)
    hits = F.when(number == "", F.array(F.lit("c0"), F.lit("c1"))).when(number == "1", F.array(F.lit("c1"), F.lit("d1"))).when(number != "6", F.array(F.concat(F.lit("d"), number)))
    found = texts.withColumn("chunk_id", F.explode(hits))
    return found.select("query_id", "chunk_id", F.lit(0.5).alias("score"), F.lit(False).alias("contradicts"))


def test_united_evidence_equals_the_union_of_all_rows(spark):
    asked = asked_rows(spark)
    want = rt.union_evidence(wf.search_once(asked, corpus).withColumn("tie", F.col("chunk_id")))
    got = wf.search_union(asked, corpus)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    rows = [sorted(map(str, df.select(columns).collect())) for df in (got, want)]
    assert rows[0] == rows[1] and got.count() == got.select("run_id", "chunk_id").distinct().count()
    alone = wf.search_union(asked.filter("query_text = 'text 2'"), corpus)
    assert {(r.run_id, r.chunk_id) for r in alone.collect()} == {(f"r{i}", "d2") for i in range(60) if i % 7 == 2}


def test_only_popular_lists_are_repeated(spark, monkeypatch):
    """A list that few rows ask for goes to one place instead of to every salt."""
    lists = stored(spark.range(1000).select(F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("_query"), F.when(F.col("id") == 7, 5000).otherwise(1).alias("_asked"), F.array(F.col("id")).alias("hits")))
    rows = lists.select(F.explode(F.sequence(F.lit(1), "_asked")).alias("i"), "_query").select(F.concat(F.lit("r"), "i").alias("run_id"), "_query")
    met = wf.with_lists(rows, lists)
    assert met.count() == rows.count() and met.filter(F.col("hits")[0] == 7).count() == 5000
    dealt = []
    plain = type(lists).join
    monkeypatch.setattr(type(lists), "join", lambda self, other, *on: dealt.append(other.count()) or plain(self, other, *on))
    wf.with_lists(rows, lists)
    assert dealt == [999 + wf.SALTS]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stock = rng.poisson(0.7, (400, 24)).astype(int)
    kinds = rng.poisson(0.7, (6, 24)).astype(int)
    kinds[2] *= 300  # a vector of wider numbers
    queries = spark.createDataFrame([(f"q{i:02d}", kinds[i % 6].tolist(), 1 + i % 2, ["s1"] if i % 4 == 0 else None) for i in range(48)], "query_id string, vector array<int>, max_tier int, sources array<string>")
    chunks = spark.createDataFrame([(f"c{i:03d}", f"s{i % 3}", 1 + i % 2, v.tolist()) for i, v in enumerate(stock)], "chunk_id string, source_id string, source_tier int, vector array<int>")
    asked, there = rt.with_norm(queries), rt.with_norm(chunks)
    want = {tuple(r) for r in rt.vector_topk(asked, there, 4).filter("score >= 0.4").select("query_id", "chunk_id", "score", "rank").collect()}
    searched = []
    plain = rt.vector_topk
    monkeypatch.setattr(rt, "vector_topk", lambda q, *rest, **more: searched.append(q.count()) or plain(q, *rest, **more))
    got = rt.vector_topk_once(asked, there, 4, 0.4)
    assert {tuple(r) for r in got.select("query_id", "chunk_id", "score", "rank").collect()} == want and want
    assert searched == [len({(i % 6, i % 2, i % 4 == 0) for i in range(48)})]


def test_vectors_are_packed_whole(spark):
    rows = [([0, 1, -128],), ([0, 127, 128],), ([-40000, 5, 2**31 - 1],), ([],), (None,)]
    df = spark.createDataFrame(rows, "vector array<int>")
    kept = [r.vector for r in rt.packed(df).collect()]
    assert [len(v) if v is not None else None for v in kept] == [4, 7, 13, 1, None]
    back = rt._matrix(pd.Series(kept[:3]))
    assert back.tolist() == [r[0] for r in rows[:3]]
    assert [r.norm for r in rt.with_norm(spark.createDataFrame([([3, 4],), ([1, None],), (None,)], "vector array<int>")).collect()] == [5.0, None, None]


def test_rounds_are_stored_compressed(spark):
    """The given evidence, the states and the frontiers are Parquet, of which a later read takes the columns it needs; no rows are checkpointed whole."""
    names = "run_id string, analysis_id string, retries bigint, max_retries bigint, information_rounds bigint, max_information_rounds bigint"
    runs = spark.createDataFrame([("r1", "a1", 0, 2, 0, 2), ("r2", "a2", 0, 2, 0, 2), (None, "a3", 0, 2, 0, 2)], names)
    shape = "run_id string, chunk_id string, document_id string, purpose string, query_ordinal bigint, score double, contradicts boolean, evidence_id string"
    evidence = spark.createDataFrame([("r1", "c1", "d", wf.DIAGNOSTIC, 1, 0.5, False, "e1"), ("r2", "c1", "d", wf.DIAGNOSTIC, 1, 0.5, True, "e2")], shape)
    state, kept = wf.refine(runs, evidence, lambda asked: evidence.limit(0))
    assert {(r.run_id, r.evidence_status, r.retries) for r in state.collect()} == {("r1", "PARTIAL", 2), ("r2", "CONFLICTING", 2), (None, "INSUFFICIENT", 0)}
    assert sorted(r.evidence_id for r in kept.collect()) == ["e1", "e2"]
    for df in (state, kept):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "ExistingRDD" not in plan
