"""Slice-wise operators against brute force, including one key that holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 10 else f"k{i % 50}", int(i), float(np.round(rng.normal(5, 3), 2))) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v double")


def by_key(rows):
    out = {}
    for k, pos, v in rows:
        out.setdefault(k, []).append((pos, v))
    return {k: sorted(items) for k, items in out.items()}


def test_ordinal_and_running_total(skewed):
    rows, df = skewed
    got = ordered.running_total(df, ["k"], F.floor(F.col("pos") / 100), ["pos"], {"total": F.col("v"), "n": F.lit(1)}).collect()
    want = {}
    for k, items in by_key(rows).items():
        for n, ((pos, _), total) in enumerate(zip(items, np.cumsum([v for _, v in items])), start=1):
            want[k, pos] = (total, n)
    assert len(got) == len(rows)
    assert all(abs(want[r.k, r.pos][0] - r.total) < 1e-6 and want[r.k, r.pos][1] == r.n for r in got)


def test_next_row_across_blocks(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(25)] + [("b", 0, 1.0)], "k string, pos bigint, v double")
    got = {(r.k, r.pos): r.nxt for r in ordered.with_next(df, ["k"], "pos", {"nxt": "v"}, block=4).collect()}
    assert len(got) == 26
    assert got["a", 24] is None and got["b", 0] is None
    assert all(got["a", i] == float((i + 1) ** 2) for i in range(24))


@pytest.mark.parametrize("whole", [20_000, 0])
def test_exact_quantiles(skewed, monkeypatch, whole):
    monkeypatch.setattr(ordered, "WHOLE_GROUP_ROWS", whole)
    rows, df = skewed
    if whole == 0:
        # the bracket path needs groups that are large against the sketch's rank error
        rows = [r for r in rows if r[0] == "hot"]
        df = df.filter("k = 'hot'")
    probs = {"a": 0.1, "m": 0.5, "z": 0.9}
    got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", probs, {"n": F.count("_v")}).collect()}
    for k, items in by_key(rows).items():
        values = [v for _, v in items]
        assert got[k].n == len(values)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    fast_t, slow_t = np.sort(rng.uniform(0, 100, 80)), np.sort(rng.uniform(10, 90, 15))
    slow_v = rng.normal(size=15)
    fast = spark.createDataFrame([("m", float(t)) for t in fast_t], "k string, t double").withColumn("row", F.lit(1))
    slow = spark.createDataFrame([("m", float(t), float(v)) for t, v in zip(slow_t, slow_v)], "k string, t double, value double")
    got = ordered.asof_interpolate(fast, slow, ["k"], "t", "value", 7.0).orderBy("t").collect()
    assert [r.value_at for r in got] == pytest.approx(list(np.interp(fast_t, slow_t, slow_v)))


def most_rows_of_a_task(df):
    """Share of the rows in the fullest partition, with adaptive execution and broadcasts off."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture
def plain_joins(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_key_with_two_thirds_of_the_rows_is_split(spark, plain_joins):
    from plumbline.operators import quality as ql

    rows = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("serial_no"), (F.col("id") * 7 % 1009).cast("double").alias("f"))
    facts = rows.groupBy("serial_no").agg(F.max("f").alias("top"))
    joined = ordered.join_facts(rows, facts, ["serial_no"], F.col("f"))
    assert joined.count() == 30_000
    assert most_rows_of_a_task(joined) < 0.35 < most_rows_of_a_task(rows.join(facts, "serial_no"))
    full = rows.withColumns({"received_at": F.lit("2024-01-01"), "passorfail": F.lit("0")})
    assert most_rows_of_a_task(ql.annotate_pairs(full, ["f"])) < 0.35
