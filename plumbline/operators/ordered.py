"""Ordered analytics whose tasks stay small when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. The operators
here cut every key into ordered slices, work inside the slices in parallel and carry only one
summary row per slice across slice borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPROX_ACCURACY = 10_000
WHOLE_GROUP_ROWS = 20_000  # groups up to this size are ranked whole, larger ones by bracket


SALTS = 16  # tasks over which the rows of one key are spread when facts per key join back


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "inner") -> DataFrame:
    """Join one row of facts per key back to the rows.

    Facts that were just aggregated on the key leave no exchange that adaptive execution could split,
    so the rows of a key are dealt out by a salt and its one row of facts is repeated for each.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order_by: Sequence[str],
    values: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key, in ``order_by`` order.

    ``slice_by`` must not decrease along ``order_by``. The rows are shuffled once, on
    (key, slice); the per-slice totals are the only thing shuffled on the key alone.
    """
    sliced = df.withColumn("_slice", slice_by)
    for name, value in values.items():
        sliced = sliced.withColumn(f"_v_{name}", value)
    parts = [*keys, "_slice"]
    totals = sliced.groupBy(*parts).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*parts)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = sliced
    for name in values:
        numbered = numbered.withColumn(f"_w_{name}", F.sum(f"_v_{name}").over(inside))
    match = F.col("_slice") == F.col("_k_slice")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = numbered.join(offsets, match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in values],
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order_by: Sequence[str],
    out: str,
    start: int = 1,
) -> DataFrame:
    """Number the rows of each key ``start, start+1, ...`` (order_by must be unique in a key)."""
    numbered = running_total(df, keys, slice_by, order_by, {out: F.lit(1).cast("bigint")})
    if start == 1:
        return numbered
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1).cast("bigint"))


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: Mapping[str, str],
    block: int = 4096,
) -> DataFrame:
    """Add the values of the row at ``position + 1``.

    Positions are dense integers. Each block also receives the first row of the following
    block, so one shuffle on (key, block) replaces a lead over the whole key.
    """
    own = F.floor(F.col(position) / block)
    first = F.col(position) % block == 0
    spread = df.withColumn(
        "_block",
        F.explode(F.when(first, F.array(own, own - 1)).otherwise(F.array(own))),
    ).withColumn("_halo", F.col("_block") != own)
    ahead = Window.partitionBy(*keys, "_block").orderBy(position)
    for out, source in columns.items():
        spread = spread.withColumn(out, F.lead(source).over(ahead))
    return spread.filter(~F.col("_halo")).drop("_block", "_halo")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key without holding a key in one task.

    A mergeable sketch brackets every requested rank; only the distinct values inside the
    brackets (about n/1000 of a group) are sorted. A bracket that missed its rank, which the
    sketch's error bound rules out, raises instead of returning an inexact value. ``extra``
    aggregates over ``value`` ride along in the first pass.
    """
    names, levels = list(probs), list(probs.values())
    margin = 5.0 / APPROX_ACCURACY
    cuts = [max(0.0, p - margin) for p in levels] + [min(1.0, p + margin) for p in levels]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    side = {n: c for n, c in (extra or {}).items()} or {"_none": F.lit(None).cast("int")}
    brackets = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", [float(c) for c in cuts], APPROX_ACCURACY).alias("_q"),
        F.struct(*[(F.first(c) if n == "_none" else c).alias(n) for n, c in side.items()]).alias("_x"),
    )
    k = len(levels)
    small = F.col("_n") <= WHOLE_GROUP_ROWS
    tagged = join_facts(rows, brackets, keys, F.col("_v")).select(
        *keys,
        "_n",
        "_x",
        F.explode_outer(
            F.filter(
                F.array(
                    *[
                        F.when(
                            small | (F.col("_v") <= F.col("_q")[i + k]),
                            F.struct(
                                F.lit(i).alias("p"),
                                F.when(small | (F.col("_v") >= F.col("_q")[i]), F.col("_v")).alias("v"),
                            ),
                        )
                        for i in range(k)
                    ]
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("_c"),
    ).filter(F.col("_c").isNotNull())
    tally = tagged.groupBy(*keys, "_n", F.col("_c.p").alias("_p"), F.col("_c.v").alias("_v")).agg(
        F.count(F.lit(1)).alias("_cnt"), F.first("_x").alias("_x")
    )
    upto = (
        Window.partitionBy(*keys, "_p")
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    level = F.element_at(F.array(*[F.lit(float(p)) for p in levels]), F.col("_p") + 1)
    ranked = (
        tally.withColumn("_cum", F.sum("_cnt").over(upto))
        .withColumn("_h", level * (F.col("_n") - 1))
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
    )
    picked = ranked.groupBy(*keys, "_p").agg(
        F.first("_x").alias("_x"),
        F.max("_h").alias("_h"),
        F.max("_lo").alias("_lo"),
        F.min(F.when(F.col("_cum") > F.col("_lo"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.col("_hi"), F.col("_v"))).alias("_b"),
        F.max(F.when(F.col("_v").isNull() & (F.col("_cum") > F.col("_lo")), 1).otherwise(0)).alias("_bad"),
    )
    exact = F.when(
        (F.col("_bad") == 1) | F.col("_b").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo")))
    ranks = [F.max(F.when(F.col("_p") == i, exact)).alias(name) for i, name in enumerate(names)]
    return picked.groupBy(*keys).agg(F.first("_x").alias("_x"), *ranks).select(
        *keys, *[F.col(f"_x.{n}").alias(n) for n in (extra or {})], *names
    )


def asof_interpolate(
    fast: DataFrame,
    slow: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    slice_seconds: float,
    out: str = "value_at",
) -> DataFrame:
    """Linear interpolation of a slow channel at the fast channel's timestamps, clamped at the ends.

    Slow samples of equal time are averaged away beforehand by the caller. Both sides are cut
    into time slices; a slice borrows only the last earlier and first later slow sample.
    """
    slot = F.floor(F.col(time) / slice_seconds)
    point = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    marks = slow.groupBy(*keys, slot.alias("_slot")).agg(
        F.max_by(point, F.col(time)).alias("_last"), F.min_by(point, F.col(time)).alias("_first")
    )
    slots = (
        fast.select(*keys, slot.alias("_slot"), F.lit(None).cast(marks.schema["_last"].dataType).alias("_last"),
                    F.lit(None).cast(marks.schema["_first"].dataType).alias("_first"))
        .unionByName(marks)
        .groupBy(*keys, "_slot")
        .agg(F.first("_last", True).alias("_last"), F.first("_first", True).alias("_first"))
    )
    axis = Window.partitionBy(*keys).orderBy("_slot")
    carried = slots.select(
        *keys,
        "_slot",
        F.last("_last", True).over(axis.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(axis.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    rest = [c for c in fast.columns if c not in (*keys, time)]
    both = fast.select(
        *keys, F.col(time), slot.alias("_slot"), F.struct(*rest, F.lit(1).alias("_")).alias("_row"),
        F.lit(None).cast("double").alias("_v"),
    ).unionByName(
        slow.select(*keys, F.col(time), slot.alias("_slot"), F.col(value).cast("double").alias("_v")),
        allowMissingColumns=True,
    )
    near = Window.partitionBy(*keys, "_slot").orderBy(time)
    sample = F.when(F.col("_v").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    past = near.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    future = near.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = (
        both.withColumn("_p", F.last(sample, True).over(past))
        .withColumn("_f", F.first(sample, True).over(future))
        .filter(F.col("_row").isNotNull())
        .join(carried, [*keys, "_slot"], "left")
        .withColumn("_p", F.coalesce("_p", "_before"))
        .withColumn("_f", F.coalesce("_f", "_after"))
    )
    span = F.col("_f.t") - F.col("_p.t")
    slope = (F.col("_f.v") - F.col("_p.v")) / F.when(span != 0, span)
    blended = (
        F.when(F.col("_p").isNull(), F.col("_f.v"))
        .when(F.col("_f").isNull(), F.col("_p.v"))
        .when(span == 0, F.col("_p.v"))
        .otherwise(F.col("_p.v") + slope * (F.col(time) - F.col("_p.t")))
    )
    return found.select(*keys, time, *[F.col(f"_row.{c}").alias(c) for c in rest], blended.alias(out))
