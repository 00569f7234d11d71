"""Labelled process rows: fail-closed validation, pair annotation and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import safe_ratio
from plumbline.operators.ordered import exact_quantiles, join_facts

# Grammar of the machining feature columns and the near-zero-variance rule.
STATISTICS = ("max", "mean", "min", "std")
AXES = ("X", "Z1", "Z2", "Z3")
GROUPS = {
    "SpindleSpeed": ("spindle_speed", ()),
    "ServoCurrent": ("servo_current", AXES),
    "ServoLoad": ("servo_load", AXES),
    "SpindleLoad": ("spindle_load", ()),
}
REQUIRED_METADATA = ("serial_no", "received_at", "passorfail")
UNIQUE_SHARE = 0.10
FREQUENCY_RATIO = 19


def machining_columns() -> list[str]:
    out = []
    for group, (_, axes) in GROUPS.items():
        out += [f"{group}_{a}_{s}" for s in STATISTICS for a in axes] if axes else [f"{group}_{s}" for s in STATISTICS]
    return out


def nest_features() -> Column:
    """Flat machining columns to one nested struct."""

    def leaf(prefix: str) -> Column:
        return F.struct(*[F.col(f"{prefix}_{s}").alias(s) for s in STATISTICS])

    parts = []
    for group, (name, axes) in GROUPS.items():
        part = F.struct(*[leaf(f"{group}_{a}").alias(a) for a in axes]) if axes else leaf(group)
        parts.append(part.alias(name))
    return F.struct(*parts)


def flatten_features(nested: str) -> list[Column]:
    """The inverse: one column per machining feature."""
    out = []
    for column in machining_columns():
        group, *middle, statistic = column.split("_")
        out.append(F.col(".".join([nested, GROUPS[group][0], *middle, statistic])).alias(column))
    return out


def nesting_audit(df: DataFrame) -> DataFrame:
    """Per machining column: rows whose value differs after nesting and flattening. No cell becomes a row."""
    columns = machining_columns()
    back = df.select(*[F.col(c).alias(f"_{c}") for c in columns], nest_features().alias("_nested"))
    both = back.select(*[F.col(f"_{c}") for c in columns], *flatten_features("_nested"))
    facts = both.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"_d_{c}") for c in columns],
        *[F.count(c).alias(f"_v_{c}") for c in columns],
    )
    cells = [F.struct(F.lit(c).alias("column"), "rows", F.col(f"_d_{c}").alias("mismatches"), F.col(f"_v_{c}").alias("values")) for c in columns]
    return facts.filter(F.col("rows") > 0).select(F.inline(F.array(*cells)))


def validate_rows(df: DataFrame, features: Sequence[str], required: Sequence[str] = REQUIRED_METADATA) -> DataFrame:
    """Add ``error_code``: the first rule a row breaks, or null. Missing columns fail every row."""

    def text(name: str) -> Column:
        return F.trim(F.col(name).cast("string"))

    def number(name: str) -> Column:
        return F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)")

    absent_metadata = [c for c in required if c not in df.columns]
    absent_features = [c for c in features if c not in df.columns]
    if absent_metadata:
        return df.withColumn("error_code", F.lit("MISSING_METADATA"))
    empty = F.lit(False)
    for name in required:
        empty = empty | F.col(name).isNull() | (text(name) == "")
    rules = [
        ("INVALID_ROW_INDEX", F.col("row_index").isNull() | (F.col("row_index") < 0)),
        ("MISSING_METADATA", empty),
        ("INVALID_TIMESTAMP", F.try_to_timestamp(text("received_at")).isNull()),
        ("INVALID_LABEL", ~text("passorfail").isin("0", "1")),
    ]
    if absent_features:
        rules.append(("MISSING_FEATURE", F.lit(True)))
    else:
        bad = F.lit(False)
        for name in features:
            value = number(name)
            bad = bad | value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
        rules.append(("INVALID_NUMERIC", bad))
    first = None
    for code, broken in rules:
        first = F.when(broken, code) if first is None else first.when(broken, code)
    return df.withColumn("error_code", first)


def split_valid(checked: DataFrame, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows; with ``fail`` the first bad row stops the job instead."""
    code = F.col("error_code")
    if fail:
        guarded = checked.withColumn("error_code", F.when(code.isNull(), code).otherwise(F.raise_error(code).cast("string")))
        return guarded.filter(F.col("error_code").isNull()).drop("error_code"), checked.limit(0)
    return checked.filter(code.isNull()).drop("error_code"), checked.filter(code.isNotNull())


def with_label(df: DataFrame) -> DataFrame:
    """PASS/FAIL status with its provenance; a dataset label is never a prediction."""
    return df.withColumns(
        {
            "label_status": F.when(F.trim(F.col("passorfail").cast("string")) == "0", "PASS").otherwise("FAIL"),
            "label_source": F.lit("dataset_ground_truth"),
            "is_prediction": F.lit(False),
        }
    )


def sample_id(dataset: str, prefix: str = "sample-") -> Column:
    """SHA-256 id of the JSON array [dataset, row_index, serial_no, received_at]."""
    parts = [
        F.to_json(F.struct(F.lit(dataset).alias("v"))),
        F.to_json(F.struct(F.col("serial_no").alias("v"))),
        F.to_json(F.struct(F.date_format(F.to_timestamp("received_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("v"))),
    ]
    name, serial, stamp = [F.regexp_extract(p, r'^\{"v":(.*)\}$', 1) for p in parts]
    body = F.concat(F.lit("["), name, F.lit(","), F.col("row_index").cast("string"), F.lit(","), serial, F.lit(","), stamp, F.lit("]"))
    return F.concat(F.lit(prefix), F.sha2(body, 256))


def pair_facts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per serial: rows, labels, timestamps and whether feature vectors differ (mergeable)."""
    vector = F.struct(*[F.col(f) for f in features])
    label = F.trim(F.col("passorfail").cast("string"))
    return df.groupBy("serial_no").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("received_at").alias("_t0"),
        F.max("received_at").alias("_t1"),
        F.count_if(label == "0").alias("_pass"),
        F.count_if(label == "1").alias("_fail"),
        F.min(vector).alias("_v0"),
        F.max(vector).alias("_v1"),
    )


def pair_flags(facts: DataFrame) -> DataFrame:
    paired = F.col("_rows") > 1
    exact = (F.col("_rows") == 2) & (F.col("_pass") == 1) & (F.col("_fail") == 1)
    return facts.select(
        "serial_no",
        paired.alias("paired_serial"),
        (paired & (F.col("_t0") == F.col("_t1"))).alias("same_timestamp_pair"),
        F.when(~paired, "NOT_PAIRED").when(exact, "PASS_FAIL_PAIR").otherwise("UNEXPECTED_PAIRED_LABELS").alias("paired_label_status"),
        F.when(paired, F.col("_v0") != F.col("_v1")).alias("feature_vector_distinct"),
    )


def annotate_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pair flags on every row; rows are neither merged nor relabelled.

    The serials are aggregated before the join back, and the rows of a frequent serial are dealt out
    over salted keys.
    """
    return join_facts(df, pair_flags(pair_facts(df, features)), ["serial_no"], F.hash(*features))


def pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Serials with exactly one PASS and one FAIL row, both sides in one row."""
    label = F.trim(F.col("passorfail").cast("string"))
    sides = [F.max(F.when(label == v, F.col(f))).alias(f"{n}_{f}") for f in features for n, v in (("pass", "0"), ("fail", "1"))]
    grouped = df.groupBy("serial_no").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(label == "0").alias("_p"), F.count_if(label == "1").alias("_f"), *sides
    )
    return grouped.filter((F.col("_n") == 2) & (F.col("_p") == 1) & (F.col("_f") == 1)).drop("_n", "_p", "_f")


def pair_differences(paired: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form (serial, feature, pass, fail, difference, symmetric relative difference)."""
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"pass_{f}").alias("p"), F.col(f"fail_{f}").alias("f")) for f in features]
    )
    long = paired.select("serial_no", F.inline(cells))
    diff = F.col("f") - F.col("p")
    return long.withColumns(
        {"diff": diff, "relative": safe_ratio(diff, (F.abs("f") + F.abs("p")) / 2)}
    )


def feature_differences(differences: DataFrame) -> DataFrame:
    """Per feature: means, medians, sign counts and the difference scaled by the population std.

    The std over both sides follows from sums, so one aggregation serves all of it.
    """
    d, p, f = F.col("diff"), F.col("p"), F.col("f")
    sums = differences.groupBy("feature").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(p).alias("pass_mean"),
        F.avg(f).alias("fail_mean"),
        F.avg(d).alias("mean_diff"),
        F.avg(F.abs(d)).alias("mean_abs_diff"),
        F.avg(F.abs("relative")).alias("mean_abs_relative"),
        F.count_if(d > 0).alias("fail_higher"),
        F.count_if(d < 0).alias("fail_lower"),
        F.count_if(d == 0).alias("equal"),
        F.var_pop(p).alias("_vp"),
        F.var_pop(f).alias("_vf"),
    )
    gap = (F.col("pass_mean") - F.col("fail_mean")) / 2
    spread = F.sqrt((F.col("_vp") + F.col("_vf")) / 2 + gap * gap)
    middles = exact_quantiles(differences, ["feature"], "diff", {"median_diff": 0.5})
    return (
        sums.withColumn("feature_std", spread)
        .withColumn("standardised", F.when(F.col("feature_std") > 0, F.col("mean_abs_diff") / F.col("feature_std")))
        .drop("_vp", "_vf")
        .join(middles, "feature")
    )


def pair_magnitudes(differences: DataFrame, per_feature: DataFrame) -> DataFrame:
    """Root mean square of the standardised differences of every pair (constant features left out)."""
    scale = F.broadcast(per_feature.filter(F.col("feature_std") > 0).select("feature", "feature_std"))
    z = F.col("diff") / F.col("feature_std")
    return differences.join(scale, "feature").groupBy("serial_no").agg(
        F.sqrt(F.avg(z * z)).alias("magnitude"), F.count_if(F.col("diff") != 0).alias("changed_features")
    )


def direction_agreement(differences: DataFrame, expected: dict[str, int]) -> DataFrame:
    """How often a difference has the expected sign per feature."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]), F.col("feature"))
    sign = F.signum("diff")
    return (
        differences.filter(F.col("feature").isin(*expected))
        .groupBy("feature")
        .agg(
            F.count_if(sign == wanted).alias("agree"),
            F.count_if(sign == -wanted).alias("disagree"),
            F.count_if(sign == 0).alias("unchanged"),
        )
    )


def column_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: nulls, distinct values, the two most common frequencies and variance flags."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("column").orderBy(F.desc("n"), "v")
    leaders = (
        counts.filter(F.col("v").isNotNull())
        .withColumn("_r", F.row_number().over(top))
        .filter(F.col("_r") <= 2)
        .groupBy("column")
        .agg(F.max(F.when(F.col("_r") == 1, F.col("n"))).alias("top_count"), F.max(F.when(F.col("_r") == 2, F.col("n"))).alias("second_count"))
    )
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("v").alias("distinct_values"),
    )
    constant = F.col("distinct_values") <= 1
    return totals.join(leaders, "column", "left").withColumns(
        {
            "constant": constant,
            "near_zero_variance": ~constant
            & (F.col("distinct_values") / F.col("rows") <= UNIQUE_SHARE)
            & (F.col("top_count") / F.col("second_count") > FREQUENCY_RATIO),
        }
    )


def identical_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column pairs that agree on every row, from one aggregation."""
    couples = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.every(F.col(a).eqNullSafe(F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(couples)])
    cells = F.array(
        *[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("identical")) for i, (a, b) in enumerate(couples)]
    )
    return row.select(F.inline(cells))


def serial_audit(df: DataFrame, features: Sequence[str]) -> DataFrame:
    facts = pair_facts(df, features)
    many = F.col("_rows") > 1
    return facts.agg(
        F.sum("_rows").alias("rows"),
        F.count(F.lit(1)).alias("unique_serials"),
        F.count_if(many).alias("serials_with_multiple_rows"),
        F.max("_rows").alias("max_rows_per_serial"),
        F.avg("_rows").alias("mean_rows_per_serial"),
        F.count_if((F.col("_pass") > 0) & (F.col("_fail") > 0)).alias("conflicting_label_serials"),
        F.sum(F.when((F.col("_pass") > 0) & (F.col("_fail") > 0), F.col("_rows")).otherwise(0)).alias("conflicting_label_rows"),
        F.count_if(many & (F.col("_v0") != F.col("_v1"))).alias("distinct_vector_serials"),
        F.sum("_pass").alias("pass_rows"),
        F.sum("_fail").alias("fail_rows"),
    )


def compatibility(checked: DataFrame, dataset: str) -> DataFrame:
    """Conversion summary: converted rows, labels, failures by code and id uniqueness."""
    good = F.col("error_code").isNull()
    labelled = with_label(checked).withColumn("sample_id", F.when(good, sample_id(dataset)))
    ids = labelled.filter(good).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    totals = labelled.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(good).alias("converted"),
        F.count_if(good & (F.col("label_status") == "PASS")).alias("pass_rows"),
        F.count_if(good & (F.col("label_status") == "FAIL")).alias("fail_rows"),
        F.count_if(~good).alias("validation_failures"),
    )
    uniqueness = ids.agg(F.count(F.lit(1)).alias("unique_sample_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_sample_ids"))
    joined = totals.withColumn("_k", F.lit(1)).join(uniqueness.withColumn("_k", F.lit(1)), "_k").drop("_k")
    clean = (F.col("converted") == F.col("input_rows")) & (F.col("duplicate_sample_ids") == 0)
    return joined.withColumn("verdict", F.when(clean, "PASS").otherwise("FAIL"))
