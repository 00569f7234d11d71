"""The corpus pipeline, stage by stage, against plain versions of what the stages decide."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import line_dedup, quality, toxicity
from plumbline.llm.queries import vocabulary_paths

from .test_simhash import plain_components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(str(folder / str(number)))
        out.append(spark.read.parquet(str(folder / str(number))))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_dealt_ones(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    assert all(s.columns == stages[0].columns and s.schema == stages[0].schema for s in stages[:-1])


@pytest.mark.parametrize("number,scored,keeps", [(0, toxicity.scored, 0), (1, quality.scored, 1)])
def test_rejected_documents_go_and_the_others_stay(spark, sf, stages, number, scored, keeps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = {r["doc_id"]: r["predicted"] for r in scored(stages[number], labels).collect()}
    before, after = rows_of(stages[number]), rows_of(stages[number + 1])
    assert set(after) == {i for i, p in verdict.items() if p == keeps}
    assert all(after[i] == before[i] for i in after)


def test_boilerplate_lines_go_as_in_sql(stages):
    con = duckdb.connect()
    con.register("documents", stages[2].select("doc_id", "text", "source").toArrow())
    want = {i: t for i, t, *_ in con.execute(line_dedup.SQL.format(ratio=line_dedup.RATIO, min_pages=line_dedup.MIN_PAGES)).fetchall()}
    got = rows_of(stages[3])
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_one_document_of_each_group_stays(stages):
    before = rows_of(stages[3])
    groups = plain_components([(i, r["text"]) for i, r in before.items()])
    after = rows_of(stages[4])
    assert set(after) == {first for _, _, first in groups}
    assert all(after[i] == before[i] for i in after)


def test_all_kept_tokens_are_packed(spark, sf, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_paths()["json_path"])
    ids = {i: np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for i, r in rows_of(stages[4]).items()}
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, rows))


def test_odd_documents_pass(spark, make_docs, odd_texts, tmp_path):
    docs = make_docs([*odd_texts, (3, "again"), (3, "again"), (3, "another text under the id"), (None, "no id"), (None, "no id")]).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.one_per_group(spark, docs, str(tmp_path)).collect()
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert sum(r["text"] == "again" for r in kept) == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_own_columns_survive_every_stage(spark, sf, tmp_path):
    names = ["score", "predicted", "n_lines", "n_dropped", "label_id", "copy_id", "component_id", "text_key"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in names))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[name] == f"{name} {r['doc_id']}" for r in out.collect() for name in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 60
