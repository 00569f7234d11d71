"""Driver contract and a sample of queries against their SQL twins at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SAMPLE = (
    "signal_ordinals feature_summary windowing_comparison interpolated_channel document_chunks vector_topk retrieval_metrics "
    "pair_annotation binary_metrics diagnosed_runs memory_context event_contract collection_digests stream_append stream_wait_resume"
).split()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_contract_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_signal_scan_reads_only_its_columns(spark, sf):
    plan = entry.queries()["channel_time_features"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan or "props" not in plan.split("ReadSchema")[1]
