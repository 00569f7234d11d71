import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import images as im
from plumbline.operators import quality as ql
from plumbline.operators import retrieval as rt
from plumbline.operators import workflow as wf
from plumbline.plans import workflow_queries as wq
from plumbline.sources import documents as docs
from plumbline.sources import images as imgs
from plumbline.sources import measurements as ms
from plumbline.sources import tables


def test_machining_columns_round_trip(spark):
    names = ql.machining_columns()
    assert len(names) == 40 and names[0] == "SpindleSpeed_max" and names[4] == "ServoCurrent_X_max"
    df = spark.createDataFrame([tuple(float(i) for i in range(40))], names)
    back = df.select(ql.nest_features().alias("n")).select(*ql.flatten_features("n"))
    assert back.first().asDict() == df.first().asDict()


def test_validation_codes(spark):
    rows = [
        ("s", "2022-08-23 03:44:05.884", "0", "1.5", 0), ("", "2022-08-23", "0", "1", 1), ("s", "not-a-timestamp", "0", "1", 2),
        ("s", "2022-08-23", "2", "1", 3), ("s", "2022-08-23", "1", "not-a-number", 4), ("s", "2022-08-23", "1", "Infinity", 5), ("s", "2022-08-23", "1", "1", -1),
    ]
    df = spark.createDataFrame(rows, "serial_no string, received_at string, passorfail string, f string, row_index bigint")
    checked = ql.validate_rows(df, ["f"])
    got = {r.row_index: r.error_code for r in checked.collect()}
    assert got == {
        0: None, 1: "MISSING_METADATA", 2: "INVALID_TIMESTAMP", 3: "INVALID_LABEL", 4: "INVALID_NUMERIC", 5: "INVALID_NUMERIC", -1: "INVALID_ROW_INDEX",
    }
    good, bad = ql.split_valid(checked)
    assert (good.count(), bad.count()) == (1, 6)
    with pytest.raises(Exception):
        ql.split_valid(checked, fail=True)[0].collect()
    assert {r.error_code for r in ql.validate_rows(df, ["g"]).filter("row_index = 0").collect()} == {"MISSING_FEATURE"}


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("﻿SerialNo,passorfail\na,0\n", encoding="utf-8")
    assert tables.read_labelled_csv(spark, str(path), ["SerialNo"]).first().SerialNo == "a"
    with pytest.raises(ValueError):
        tables.read_labelled_csv(spark, str(path), ["missing"])


def test_cases_registry_and_reports(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "c", "question": "q", "purpose": "INSPECTION_ACTION"}]))
    case = tables.read_cases(spark, str(tmp_path / "cases.json")).first()
    assert case.mode == "DIAGNOSTIC" and case.answerable and case.expected_sources == []
    for folder, model in (("a", "m1"), ("b", "m2")):
        (tmp_path / "models" / folder).mkdir(parents=True)
        (tmp_path / "models" / folder / "metadata.json").write_text(json.dumps({"model_id": model, "feature_version": "1"}))
    registry = tables.model_registry(spark, str(tmp_path / "models"))
    assert tables.active_model(registry, "m2").first().model_id == "m2"
    with pytest.raises(LookupError):
        tables.active_model(registry)
    ranks = spark.createDataFrame([("m1", "v__rms", 0.5, 1)], "model_id string, feature string, importance double, rank int")
    row = tables.model_catalog(registry, ranks).filter("model_id = 'm1'").first()
    assert (row.channel, row.feature) == ("v", "rms")
    (tmp_path / "models" / "b" / "metadata.json").write_text(json.dumps({"model_id": "m1", "feature_version": "1"}))
    with pytest.raises(Exception, match="duplicate model id"):
        tables.model_registry(spark, str(tmp_path / "models")).collect()
    tables.write_reports({"ranks": ranks}, str(tmp_path / "out"), ("parquet", "csv", "json"))
    assert spark.read.parquet(str(tmp_path / "out" / "ranks_parquet")).count() == 1


def test_index_rejects_duplicates(spark):
    paths = spark.createDataFrame([("/r/N15_M07_F10_K001_1.mat",), ("/r/x/N15_M07_F10_K001_01.mat",), ("/r/notes.mat",)], "path string")
    assert ms.index_measurements(paths.limit(1), "rig").first().measurement_id == "rig:K001:N15_M07_F10:01"
    with pytest.raises(Exception, match="duplicate measurement id"):
        ms.index_measurements(paths, "rig").collect()


def test_manifest(spark, tmp_path):
    record = dict(source_id="SRC ONE", title="T", publisher="P", official_url="u", local_path="a.pdf", source_tier="Tier 1", rag_role=["x"], license_status="l", sha256="h", file_type="pdf")
    (tmp_path / "m.json").write_text(json.dumps({"manifest_version": "1", "sources": [record, {**record, "source_id": "LOGS", "local_path": "c", "file_type": "pdf_collection"}]}))
    manifest = docs.read_manifest(spark, str(tmp_path / "m.json"))
    rows = [(None, "a.pdf", "h"), ("c", "c/k1/log.pdf", "1"), ("c", "c/k2/log.pdf", "2")]
    files = spark.createDataFrame(rows, "collection string, path string, sha256 string")
    digest = docs.collection_digests(files.filter("collection is not null")).first()
    manifest = manifest.withColumn("sha256", F.when(F.col("source_id") == "LOGS", digest.collection_sha256).otherwise(F.col("sha256")))
    statuses = docs.source_statuses(manifest, files)
    assert {r.source_id: (r.status, r.document_count) for r in statuses.collect()} == {"SRC ONE": ("READY", 1), "LOGS": ("READY", 2)}
    ids = {r.document_id for r in docs.unique_documents(docs.expand_documents(statuses, files)).collect()}
    assert ids == {"src_one", "logs_k1", "logs_k2"}
    (tmp_path / "bad.json").write_text(json.dumps({"sources": []}))
    with pytest.raises(ValueError):
        docs.read_manifest(spark, str(tmp_path / "bad.json"))


def test_chunk_table_upsert_twice(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.createDataFrame([("d1", "d1:c1", "a"), ("d2", "d2:c1", "b")], "document_id string, chunk_id string, content string")
    docs.write_chunks(rows, path)
    new = spark.createDataFrame([("d1", "d1:c9", "z")], "document_id string, chunk_id string, content string")
    for _ in range(2):
        docs.write_chunks(docs.merge_chunks(new, path), path)
    got = {(r.document_id, r.chunk_id) for r in spark.read.parquet(path).collect()}
    assert got == {("d1", "d1:c9"), ("d2", "d2:c1")}
    assert docs.document_records(spark.read.parquet(path), "d2").count() == 1


def png(width, height, value):
    raw = b"".join(b"\0" + bytes([value, value, value]) * width for _ in range(height))

    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(20, 18, 100))
    (tmp_path / "b.png").write_bytes(png(8, 8, 100))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    decoded = imgs.validate_decoded(imgs.read_images(spark, str(tmp_path)), 100)
    got = {r.origin[-5:]: r.rejection for r in decoded.collect()}
    assert got == {"a.png": None, "b.png": "TOO_SMALL", "c.png": "NOT_DECODABLE"}
    measured = imgs.with_metrics(decoded.filter("rejection is null").withColumn("image_id", F.lit("i"))).first()
    assert (measured.brightness, measured.contrast) == (100.0, 0.0)
    files = spark.createDataFrame([("x", png(16, 16, 1), "image/jpeg"), ("y", b"", "image/png"), ("z", b"GIF8", "image/gif")], "image_id string, content binary, declared_mime string")
    assert {r.image_id: r.rejection for r in imgs.validate_files(files, 10_000).collect()} == {"x": "MIME_MISMATCH", "y": "EMPTY", "z": "UNSUPPORTED"}


def test_edge_response_brute_force():
    gray = np.random.default_rng(2).integers(0, 255, (6, 7)).astype(np.uint8)
    want = gray.astype(int).copy()
    for i in range(1, 5):
        for j in range(1, 6):
            box = gray[i - 1 : i + 2, j - 1 : j + 2].astype(int)
            want[i, j] = min(255, max(0, 9 * box[1, 1] - box.sum()))
    assert (im.edge_response(gray) == want).all()


def test_nesting_audit_makes_no_row_of_a_cell(spark):
    columns = ql.machining_columns()
    df = spark.range(6).select(*[F.when((F.col("id") + i) % 3 != 0, F.col("id") + 0.5).alias(c) for i, c in enumerate(columns)])
    out = ql.nesting_audit(df)
    got = {r.column: (r.rows, r.mismatches, r["values"]) for r in out.collect()}
    assert got == {c: (6, 0, 4) for c in columns}
    assert ql.nesting_audit(df.limit(0)).collect() == []
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_evidence_routes_for_every_state(spark):
    rows = [(s, r, n) for s in ("SUFFICIENT", "PARTIAL", "CONFLICTING", "INSUFFICIENT") for r in range(4) for n in range(4)]
    df = spark.createDataFrame(rows, "s string, r int, n int")
    got = df.select("s", "r", "n", wf.route_evidence(F.col("s"), F.col("r"), F.lit(2), F.col("n"), F.lit(2)).alias("route")).collect()
    for row in got:
        if row.s == "SUFFICIENT":
            want = "sufficient"
        elif row.s == "INSUFFICIENT" or row.r >= 2:
            want = "limited_report" if row.n >= 2 else "additional_information"
        else:
            want = {"PARTIAL": "refine", "CONFLICTING": "counter_evidence"}[row.s]
        assert row.route == want


def test_bounded_refinement(spark):
    """A run that stays partial retries twice and then waits; an insufficient run waits at once."""
    runs = spark.createDataFrame([("r1", "a1", 0, 2, 0, 2), ("r2", "a2", 0, 2, 0, 2)], "run_id string, analysis_id string, retries bigint, max_retries bigint, information_rounds bigint, max_information_rounds bigint")
    shape = "run_id string, chunk_id string, document_id string, purpose string, query_ordinal bigint, score double, contradicts boolean, evidence_id string"
    evidence = spark.createDataFrame([("r1", "c1", "d", wf.DIAGNOSTIC, 1, 0.5, False, "e1")], shape)
    asked = []

    def search(queries):
        asked.append(queries.count())
        return evidence.limit(0)

    state, _ = wf.refine(runs, evidence, search)
    got = {r.run_id: (r.evidence_status, r.retries, r.route) for r in state.collect()}
    assert got == {"r1": ("PARTIAL", 2, "additional_information"), "r2": ("INSUFFICIENT", 0, "additional_information")}
    assert asked == [1, 1]


def test_rounds_search_only_open_runs_and_each_text_once(spark):
    """Missing inspection evidence arrives in the second round; settled runs are never asked for again."""
    shape = "run_id string, chunk_id string, document_id string, purpose string, query_ordinal bigint, score double, contradicts boolean, evidence_id string"
    names = "run_id string, analysis_id string, retries bigint, max_retries bigint, information_rounds bigint, max_information_rounds bigint"
    runs = spark.createDataFrame([(f"r{i}", f"a{i}", 0, 2, 0, 2) for i in range(6)], names)
    rows = [(f"r{i}", "c1", "d", wf.DIAGNOSTIC, 1, 0.5, i == 4, f"e{i}") for i in range(5)] + [("r0", "c2", "d", wf.INSPECTION, 2, 0.5, False, "f0")]
    texts = []

    def corpus(asked):
        texts.append(sorted(r.question for r in asked.collect()))
        late = asked.filter((F.col("purpose") == wf.INSPECTION) & F.col("question").endswith("2"))
        return late.select("query_id", F.lit("c9").alias("chunk_id"), F.lit("d").alias("document_id"), F.lit(0.4).alias("score"), F.lit(False).alias("contradicts"))

    state, evidence = wf.refine(runs, spark.createDataFrame(rows, shape), lambda asked: wf.search_once(asked, corpus))
    got = {r.run_id: (r.evidence_status, r.retries) for r in state.collect()}
    want = {"r0": ("SUFFICIENT", 0), "r4": ("CONFLICTING", 2), "r5": ("INSUFFICIENT", 0)} | {f"r{i}": ("SUFFICIENT", 2) for i in (1, 2, 3)}
    assert got == want
    assert sorted((r.run_id, r.chunk_id) for r in evidence.collect()) == sorted([(r[0], r[1]) for r in rows] + [(f"r{i}", "c9") for i in (1, 2, 3)])
    assert [len(t) for t in texts] == [2, 2]


def test_refinement_computes_the_given_evidence_once(spark):
    shape = "run_id string, chunk_id string, document_id string, purpose string, query_ordinal bigint, score double, contradicts boolean, evidence_id string"
    names = "run_id string, analysis_id string, retries bigint, max_retries bigint, information_rounds bigint, max_information_rounds bigint"
    runs = spark.createDataFrame([("r1", "a1", 0, 2, 0, 2)], names)
    made = spark.sparkContext.accumulator(0)

    def counted(score):
        made.add(1)
        return score

    rows = [("r1", f"c{i}", "d", wf.DIAGNOSTIC, 1, 0.5, False, f"e{i}") for i in range(3)]
    evidence = spark.createDataFrame(rows, shape).withColumn("score", F.udf(counted, "double").asNondeterministic()("score"))
    state, _ = wf.refine(runs, evidence, lambda asked: evidence.limit(0))
    assert state.first().retries == 2 and made.value == len(rows)


def test_unknown_status_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported analysis status"):
        spark.range(1).select(wf.route_verdict(F.lit("odd"))).collect()


def test_rejection_adds_a_limitation(spark):
    keys = wf.report_limitations(F.lit("SUFFICIENT"), F.lit(1), F.lit("REJECTED"))
    assert spark.range(1).select(keys).first()[0] == ["confidence", "control", "human", "rejected"]


def test_contract(spark):
    df = spark.createDataFrame([(["a"], ["a"], "low"), (["a"], ["b"], "odd"), (["a"], ["b"], "high")], "supporting_ids array<string>, contradicting_ids array<string>, confidence_level string")
    assert [r.contract_error for r in wf.contract_violations(df).collect()] == ["SUPPORT_AND_CONTRADICT", "INVALID_LEVEL", None]


def test_errors_stay_with_their_run(spark):
    df = spark.createDataFrame([("a", "RUNNING", None), ("b", "RUNNING", None), ("c", "FAILED", "OLD")], "run_id string, workflow_status string, error_code string")
    got = {r.run_id: (r.workflow_status, r.error_code) for r in wf.capture_errors(df, F.col("run_id") != "a", "NEW").collect()}
    assert got == {"a": ("RUNNING", None), "b": ("FAILED", "NEW"), "c": ("FAILED", "OLD")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_a_run_is_brought_together_once(spark):
    kinds = "run_id string, chunk_id string, document_id string, purpose string, query_ordinal bigint, score double, source_tier bigint, contradicts boolean, tie double"
    rows = [("r1", f"c{i % 10}", "d", wf.DIAGNOSTIC, 2 + i // 10, 1.0 - i / 100, 1, False, float(i)) for i in range(20)]
    rows += [("r1", "c3", "d", wf.INSPECTION, 1, 0.1, 1, True, 0.0), ("r2", "c1", "d", wf.INSPECTION, 1, 0.5, 1, False, 0.0)]
    union = rt.union_evidence(spark.createDataFrame(rows, kinds))
    found = wf.digest_evidence(union.withColumn("evidence_id", F.concat_ws("-", "run_id", "chunk_id")))
    assert plan_of(found).count("Exchange") == 1
    first, second = found.orderBy("run_id").collect()
    assert (first.evidence_count, first.contradicted, first.first_diagnostic, first.first_inspection) == (10, True, "r1-c0", "r1-c3")
    assert first.supporting_ids == [f"r1-c{i}" for i in (3, 0, 1, 2, 4, 5, 6, 7)]
    assert (second.evidence_count, second.first_diagnostic, second.supporting_ids) == (1, None, ["r2-c1"])


def test_requests_are_stored_once(spark, sf):
    assert "FileScan" not in plan_of(wq.validated(spark, sf))


def test_citations_are_traced_where_their_runs_lie(spark, sf):
    assert plan_of(wq.citation_trace(spark, sf)).count("Exchange hashpartitioning(run_id") == 2  # one for each use of the evidence
    kinds = "run_id string, evidence_id string, source_id string"
    rows = [("r1", "e1", "s1"), ("r1", "e1", "s1"), ("r1", "e2", "gone"), ("r1", "e3", None), ("r1", None, "s1"), ("r2", "e1", "s1"), ("r3", "e9", "s1")]
    evidence = spark.createDataFrame(rows, kinds)
    pairs = [("r1", "e1"), ("r1", "e1"), ("r1", "e2"), ("r1", "e3"), ("r1", "e4"), ("r1", None), ("r2", "e1"), ("r4", "e1"), (None, "e1")]
    cited = spark.createDataFrame(pairs, "run_id string, evidence_id string")
    traced = wf.trace_citations(cited, evidence, spark.createDataFrame([("s1",), ("s1",), (None,)], "source_id string"))
    assert {tuple(r) for r in traced.collect()} == {("r1", 6, 4, 2, False), ("r2", 1, 1, 1, True), ("r4", 1, 0, 0, False), (None, 1, 0, 0, False)}


def test_only_collections_are_expanded(spark):
    """A single file may lie where a collection does; files of no collection have no digest."""
    kinds = "collection string, path string, sha256 string"
    files = spark.createDataFrame([(None, "x", "h"), ("x", "x/k1/log.pdf", "1")], kinds).coalesce(1)
    digests = docs.collection_digests(files)
    assert [(r.collection, r.files) for r in digests.collect()] == [("x", 1)]
    sources = "source_id string, title string, local_path string, file_type string, sha256 string"
    rows = [("ONE", "T", "x", "pdf", "h"), ("ALL", "T", "x", "pdf_collection", digests.first().collection_sha256)]
    statuses = docs.source_statuses(spark.createDataFrame(rows, sources), files)
    expanded = docs.unique_documents(docs.expand_documents(statuses, files))
    assert {(r.document_id, r.local_path) for r in expanded.collect()} == {("one", "x"), ("all_k1", "x/k1/log.pdf")}
