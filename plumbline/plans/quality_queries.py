"""Queries over labelled process rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features as ft, quality as ql, queries as qb
from plumbline.operators.ordered import exact_quantiles
from plumbline.plans import views
from plumbline.plans.registry import query, with_views
from plumbline.plans.views import FEATURES, QUALITY_SQL

DATASET = "process_quality"
Q = with_views(QUALITY_SQL)

DIRTY_SQL = """dirty AS (
  SELECT CASE WHEN l_quantity = 13 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS serial_no,
         CASE WHEN l_quantity = 17 THEN 'not-a-timestamp' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS received_at,
         CASE WHEN l_quantity = 19 THEN '2' WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS passorfail,
         CASE WHEN l_quantity = 23 THEN 'not-a-number' WHEN l_quantity = 29 THEN 'NaN' WHEN l_quantity = 31 THEN '' ELSE CAST(l_extendedprice AS VARCHAR) END AS f2,
         l_linenumber - CASE WHEN l_quantity = 37 THEN 100 ELSE 0 END AS row_index, l_quantity AS q
  FROM lineitem),
checked AS (SELECT *, CASE WHEN row_index < 0 THEN 'INVALID_ROW_INDEX' WHEN serial_no = '' THEN 'MISSING_METADATA' WHEN received_at = 'not-a-timestamp' THEN 'INVALID_TIMESTAMP'
  WHEN passorfail = '2' THEN 'INVALID_LABEL' WHEN f2 IN ('not-a-number', 'NaN', '') THEN 'INVALID_NUMERIC' END AS error_code FROM dirty)"""


def dirty_rows(spark, sf_dir):
    """The process rows with faults set by their own quantity."""
    q = F.col("l_quantity")
    return views.table(spark, sf_dir, "lineitem").select(
        F.when(q == 13, "").otherwise(F.col("l_orderkey").cast("string")).alias("serial_no"),
        F.when(q == 17, "not-a-timestamp").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("received_at"),
        F.when(q == 19, "2").when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("passorfail"),
        F.when(q == 23, "not-a-number").when(q == 29, "NaN").when(q == 31, "").otherwise(F.col("l_extendedprice").cast("string")).alias("f2"),
        (F.col("l_linenumber") - F.when(q == 37, 100).otherwise(0)).cast("bigint").alias("row_index"),
    )


@query(
    "row_validation",
    with_views(DIRTY_SQL) + "SELECT coalesce(error_code, 'VALID') AS error_code, passorfail, CAST(count(*) AS BIGINT) AS n FROM checked GROUP BY 1, 2",
)
def row_validation(spark, sf_dir):
    checked = ql.validate_rows(dirty_rows(spark, sf_dir), ["f2"])
    return checked.groupBy(F.coalesce("error_code", F.lit("VALID")).alias("error_code"), "passorfail").agg(F.count(F.lit(1)).alias("n"))


@query(
    "valid_labels",
    with_views(DIRTY_SQL)
    + """SELECT serial_no, CASE passorfail WHEN '0' THEN 'PASS' ELSE 'FAIL' END AS label_status, 'dataset_ground_truth' AS label_source, FALSE AS is_prediction,
  CAST(count(*) AS BIGINT) AS n FROM checked WHERE error_code IS NULL GROUP BY ALL""",
)
def valid_labels(spark, sf_dir):
    good, _ = ql.split_valid(ql.validate_rows(dirty_rows(spark, sf_dir), ["f2"]))
    return ql.with_label(good).groupBy("serial_no", "label_status", "label_source", "is_prediction").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sample_ids",
    Q
    + f"""SELECT serial_no, row_index, 'sample-' || sha256('["{DATASET}",' || row_index || ',"' || serial_no || '","' || replace(received_at, ' ', 'T') || '.000"]') AS sample_id FROM quality""",
)
def sample_ids(spark, sf_dir):
    return views.quality_rows(spark, sf_dir).select("serial_no", "row_index", ql.sample_id(DATASET).alias("sample_id"))


FACTS_SQL = """facts AS (SELECT serial_no, count(*) AS n, count(DISTINCT received_at) AS ts, count(*) FILTER (passorfail = 0) AS p, count(*) FILTER (passorfail = 1) AS f,
  count(DISTINCT (f1, f2, f3, f4)) AS vecs FROM quality GROUP BY 1)"""


@query(
    "pair_annotation",
    with_views(QUALITY_SQL, FACTS_SQL)
    + """SELECT serial_no, row_index, round(f2, 2) AS f2, n > 1 AS paired_serial, n > 1 AND ts = 1 AS same_timestamp_pair,
  CASE WHEN n = 1 THEN 'NOT_PAIRED' WHEN n = 2 AND p = 1 AND f = 1 THEN 'PASS_FAIL_PAIR' ELSE 'UNEXPECTED_PAIRED_LABELS' END AS paired_label_status,
  CASE WHEN n > 1 THEN vecs > 1 END AS feature_vector_distinct FROM quality JOIN facts USING (serial_no)""",
)
def pair_annotation(spark, sf_dir):
    out = ql.annotate_pairs(views.quality_rows(spark, sf_dir), FEATURES)
    return out.select(
        "serial_no", "row_index", F.round("f2", 2).alias("f2"), "paired_serial", "same_timestamp_pair", "paired_label_status", "feature_vector_distinct"
    )


PAIRS_SQL = """pairs AS (
  SELECT serial_no, f1p, f1f, f2p, f2f, f3p, f3f, f4p, f4f FROM (
    SELECT serial_no, count(*) AS n, count(*) FILTER (passorfail = 0) AS p, count(*) FILTER (passorfail = 1) AS f,
      max(f1) FILTER (passorfail = 0) AS f1p, max(f1) FILTER (passorfail = 1) AS f1f, max(f2) FILTER (passorfail = 0) AS f2p, max(f2) FILTER (passorfail = 1) AS f2f,
      max(f3) FILTER (passorfail = 0) AS f3p, max(f3) FILTER (passorfail = 1) AS f3f, max(f4) FILTER (passorfail = 0) AS f4p, max(f4) FILTER (passorfail = 1) AS f4f
    FROM quality GROUP BY 1) WHERE n = 2 AND p = 1 AND f = 1),
diffs AS (
  SELECT serial_no, feature, p, f, f - p AS diff, CASE WHEN abs(f) + abs(p) = 0 THEN 0 ELSE (f - p) / ((abs(f) + abs(p)) / 2) END AS relative FROM (
    SELECT serial_no, 'f1' AS feature, f1p AS p, f1f AS f FROM pairs UNION ALL SELECT serial_no, 'f2', f2p, f2f FROM pairs
    UNION ALL SELECT serial_no, 'f3', f3p, f3f FROM pairs UNION ALL SELECT serial_no, 'f4', f4p, f4f FROM pairs)),
per_feature AS (
  SELECT feature, CAST(count(*) AS BIGINT) AS pairs, avg(p) AS pass_mean, avg(f) AS fail_mean, avg(diff) AS mean_diff, avg(abs(diff)) AS mean_abs_diff,
    avg(abs(relative)) AS mean_abs_relative, CAST(count(*) FILTER (diff > 0) AS BIGINT) AS fail_higher, CAST(count(*) FILTER (diff < 0) AS BIGINT) AS fail_lower,
    CAST(count(*) FILTER (diff = 0) AS BIGINT) AS equal, quantile_cont(diff, 0.5) AS median_diff FROM diffs GROUP BY 1),
stds AS (SELECT feature, stddev_pop(v) AS feature_std FROM (SELECT feature, p AS v FROM diffs UNION ALL SELECT feature, f FROM diffs) GROUP BY 1)"""

PD = with_views(QUALITY_SQL, PAIRS_SQL)


def differences(spark, sf_dir):
    return ql.pair_differences(ql.pairs(views.quality_rows(spark, sf_dir), FEATURES), FEATURES)


@query("pass_fail_pairs", PD + "SELECT serial_no, feature, p, f, round(diff, 6) AS diff, round(relative, 6) AS relative FROM diffs")
def pass_fail_pairs(spark, sf_dir):
    return differences(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("diff", "relative")})


DIFF_COLUMNS = ("pass_mean", "fail_mean", "mean_diff", "mean_abs_diff", "mean_abs_relative", "median_diff", "feature_std", "standardised")


@query(
    "paired_difference_audit",
    PD
    + """SELECT feature, pairs, fail_higher, fail_lower, equal, round(pass_mean, 6) AS pass_mean, round(fail_mean, 6) AS fail_mean, round(mean_diff, 6) AS mean_diff,
  round(mean_abs_diff, 6) AS mean_abs_diff, round(mean_abs_relative, 6) AS mean_abs_relative, round(median_diff, 6) AS median_diff,
  round(feature_std, 6) AS feature_std, round(CASE WHEN feature_std > 0 THEN mean_abs_diff / feature_std END, 6) AS standardised FROM per_feature JOIN stds USING (feature)""",
)
def paired_difference_audit(spark, sf_dir):
    return ql.feature_differences(differences(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in DIFF_COLUMNS})


MAGNITUDE_SQL = """mags AS (SELECT serial_no, sqrt(avg((diff / feature_std) * (diff / feature_std))) AS magnitude, CAST(count(*) FILTER (diff <> 0) AS BIGINT) AS changed_features
  FROM diffs JOIN stds USING (feature) WHERE feature_std > 0 GROUP BY 1)"""


def magnitudes(spark, sf_dir):
    rows = differences(spark, sf_dir)
    return ql.pair_magnitudes(rows, ql.feature_differences(rows))


@query(
    "pair_magnitudes",
    with_views(QUALITY_SQL, PAIRS_SQL, MAGNITUDE_SQL) + "SELECT serial_no, round(magnitude, 6) AS magnitude, changed_features FROM mags",
)
def pair_magnitudes(spark, sf_dir):
    return magnitudes(spark, sf_dir).withColumn("magnitude", F.round("magnitude", 6))


@query(
    "pair_magnitude_quantiles",
    with_views(QUALITY_SQL, PAIRS_SQL, MAGNITUDE_SQL)
    + """SELECT 'all' AS scope, round(min(magnitude), 6) AS lowest, round(quantile_cont(magnitude, 0.1), 6) AS q10, round(quantile_cont(magnitude, 0.25), 6) AS q25,
  round(quantile_cont(magnitude, 0.5), 6) AS median, round(quantile_cont(magnitude, 0.75), 6) AS q75, round(quantile_cont(magnitude, 0.9), 6) AS q90, round(max(magnitude), 6) AS highest FROM mags""",
)
def pair_magnitude_quantiles(spark, sf_dir):
    rows = magnitudes(spark, sf_dir).withColumn("scope", F.lit("all"))
    cuts = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    v = F.col("_v")
    out = exact_quantiles(rows, ["scope"], "magnitude", cuts, {"lowest": F.min(v), "highest": F.max(v)})
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "scope"})


@query(
    "direction_agreement",
    PD
    + """SELECT feature, CAST(count(*) FILTER (sign(diff) = e) AS BIGINT) AS agree, CAST(count(*) FILTER (sign(diff) = -e) AS BIGINT) AS disagree, CAST(count(*) FILTER (diff = 0) AS BIGINT) AS unchanged
FROM diffs JOIN (VALUES ('f2', 1), ('f3', -1)) x(feature, e) USING (feature) GROUP BY 1""",
)
def direction_agreement(spark, sf_dir):
    return ql.direction_agreement(differences(spark, sf_dir), {"f2": 1, "f3": -1})


AUDITED = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_extendedprice")


@query(
    "column_audit",
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in AUDITED)
    + """), c AS (SELECT "column", v, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c WHERE v IS NOT NULL),
t AS (SELECT "column", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS nulls, CAST(count(v) AS BIGINT) AS distinct_values FROM c GROUP BY 1),
l AS (SELECT "column", CAST(max(n) FILTER (r = 1) AS BIGINT) AS top_count, CAST(max(n) FILTER (r = 2) AS BIGINT) AS second_count FROM r GROUP BY 1)
SELECT *, distinct_values <= 1 AS constant, distinct_values > 1 AND distinct_values / CAST(rows AS DOUBLE) <= 0.1 AND top_count / CAST(second_count AS DOUBLE) > 19 AS near_zero_variance FROM t JOIN l USING ("column")""",
)
def column_audit(spark, sf_dir):
    return ql.column_audit(views.table(spark, sf_dir, "lineitem"), AUDITED)


@query(
    "identical_columns",
    "WITH x AS (SELECT l_quantity AS a, l_quantity * 1.0 AS b, l_tax AS c FROM lineitem) "
    "SELECT 'a' AS \"left\", 'b' AS \"right\", bool_and(a = b) AS identical FROM x UNION ALL SELECT 'a', 'c', bool_and(a = c) FROM x UNION ALL SELECT 'b', 'c', bool_and(b = c) FROM x",
)
def identical_columns(spark, sf_dir):
    q = F.col("l_quantity")
    rows = views.table(spark, sf_dir, "lineitem").select(q.alias("a"), (q * 1.0).alias("b"), F.col("l_tax").alias("c"))
    return ql.identical_columns(rows, ("a", "b", "c"))


@query(
    "rows_by_date",
    "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1",
)
def rows_by_date(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "serial_audit",
    with_views(QUALITY_SQL, FACTS_SQL)
    + """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS unique_serials, CAST(count(*) FILTER (n > 1) AS BIGINT) AS serials_with_multiple_rows,
  CAST(max(n) AS BIGINT) AS max_rows_per_serial, round(avg(n), 6) AS mean_rows_per_serial, CAST(count(*) FILTER (p > 0 AND f > 0) AS BIGINT) AS conflicting_label_serials,
  CAST(sum(n) FILTER (p > 0 AND f > 0) AS BIGINT) AS conflicting_label_rows, CAST(count(*) FILTER (n > 1 AND vecs > 1) AS BIGINT) AS distinct_vector_serials,
  CAST(sum(p) AS BIGINT) AS pass_rows, CAST(sum(f) AS BIGINT) AS fail_rows FROM facts""",
)
def serial_audit(spark, sf_dir):
    return ql.serial_audit(views.quality_rows(spark, sf_dir), FEATURES).withColumn("mean_rows_per_serial", F.round("mean_rows_per_serial", 6))


@query(
    "conversion_summary",
    with_views(DIRTY_SQL)
    + """, ids AS (SELECT serial_no, row_index, received_at, count(*) AS n FROM checked WHERE error_code IS NULL GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) FILTER (error_code IS NULL) AS BIGINT) AS converted, CAST(count(*) FILTER (error_code IS NULL AND passorfail = '0') AS BIGINT) AS pass_rows,
  CAST(count(*) FILTER (error_code IS NULL AND passorfail = '1') AS BIGINT) AS fail_rows, CAST(count(*) FILTER (error_code IS NOT NULL) AS BIGINT) AS validation_failures,
  (SELECT CAST(count(*) AS BIGINT) FROM ids) AS unique_sample_ids, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM ids) AS duplicate_sample_ids,
  CASE WHEN count(*) FILTER (error_code IS NOT NULL) = 0 AND (SELECT coalesce(sum(n - 1), 0) FROM ids) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM checked""",
)
def conversion_summary(spark, sf_dir):
    return ql.compatibility(ql.validate_rows(dirty_rows(spark, sf_dir), ["f2"]), DATASET)


@query(
    "clean_conversion_summary",
    with_views(DIRTY_SQL)
    + """, good AS (SELECT * FROM checked WHERE error_code IS NULL), ids AS (SELECT serial_no, row_index, received_at, count(*) AS n FROM good GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) AS BIGINT) AS converted, CAST(count(*) FILTER (passorfail = '0') AS BIGINT) AS pass_rows,
  CAST(count(*) FILTER (passorfail = '1') AS BIGINT) AS fail_rows, CAST(0 AS BIGINT) AS validation_failures,
  (SELECT CAST(count(*) AS BIGINT) FROM ids) AS unique_sample_ids, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM ids) AS duplicate_sample_ids,
  CASE WHEN (SELECT coalesce(sum(n - 1), 0) FROM ids) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM good""",
)
def clean_conversion_summary(spark, sf_dir):
    """The summary of the rows that pass validation: nothing fails any more."""
    checked = ql.validate_rows(dirty_rows(spark, sf_dir), ["f2"])
    return ql.compatibility(checked.filter(F.col("error_code").isNull()), DATASET)


# -- query contexts, nesting, specifications -------------------------------------------------------

PROCESS_SQL = """process AS (
  SELECT l_quantity, CASE l_returnflag WHEN 'R' THEN 'FAIL' ELSE 'PASS' END AS status, l_linestatus = 'O' AND l_linenumber = 1 AS prediction,
    CASE WHEN l_linenumber = 7 THEN 'model' ELSE 'dataset_ground_truth' END AS source_type FROM lineitem)"""


def process_rows(spark, sf_dir):
    """Process rows: some labels are predicted, some come from a model."""
    value = dict(zip(qb.PROCESS_FEATURES, ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("status"),
        ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("prediction"),
        F.when(F.col("l_linenumber") == 7, "model").otherwise(qb.TRUTH_SOURCE).alias("source_type"),
        *[F.col(column).cast("double").alias(name) for name, column in value.items()],
    )


@query(
    "process_contexts",
    with_views(PROCESS_SQL)
    + f"""SELECT mode, md5(query) AS query_md5, rejection, CAST(count(*) AS BIGINT) AS n, round(avg(speed), 6) AS mean_speed FROM (
  SELECT CASE WHEN ok THEN CASE status WHEN 'FAIL' THEN 'FAIL_EVIDENCE_CONTEXT' ELSE 'PASS_CONTROL_CONTEXT' END END AS mode,
    CASE WHEN ok THEN CASE status WHEN 'FAIL' THEN '{qb.PROCESS_QUERIES['FAIL'][1]}' ELSE '{qb.PROCESS_QUERIES['PASS'][1]}' END END AS query,
    CASE WHEN NOT ok THEN 'NOT_DATASET_TRUTH' END AS rejection, CASE WHEN ok THEN l_quantity END AS speed
  FROM (SELECT *, NOT prediction AND source_type = 'dataset_ground_truth' AS ok FROM process)) GROUP BY ALL""",
)
def process_contexts(spark, sf_dir):
    out = qb.process_contexts(process_rows(spark, sf_dir))
    speed = F.col("feature_context.SpindleSpeed_max")
    return out.groupBy("mode", F.md5("query").alias("query_md5"), "rejection").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(speed), 6).alias("mean_speed"))


@query(
    "nesting_audit",
    f"""SELECT c AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS mismatches, CAST(count(*) FILTER ((l_orderkey + i) % 5 <> 0) AS BIGINT) AS values
FROM lineitem, (SELECT unnest({ql.machining_columns()}) AS c, unnest(range({len(ql.machining_columns())})) AS i) GROUP BY 1""",
)
def nesting_audit(spark, sf_dir):
    """All forty machining columns, with nulls in a fifth of the cells."""
    key = F.col("l_orderkey")
    cells = [F.when((key + i) % 5 != 0, F.col("l_extendedprice").cast("double") + i).alias(c) for i, c in enumerate(ql.machining_columns())]
    return ql.nesting_audit(views.table(spark, sf_dir, "lineitem").select(*cells))


@query(
    "missing_spec_fields",
    f"""SELECT s_suppkey, array_to_string(list_filter({list(ft.REQUIRED_SPEC_FIELDS)}, lambda f, i: (s_suppkey + i) % 4 = 0), ',') AS missing FROM supplier""",
)
def missing_spec_fields(spark, sf_dir):
    key = F.col("s_suppkey")
    listed = F.array_compact(F.array(*[F.when((key + i) % 4 != 0, f) for i, f in enumerate(ft.REQUIRED_SPEC_FIELDS, 1)]))
    specs = views.table(spark, sf_dir, "supplier").select("s_suppkey", listed.alias("fields"))
    return ft.missing_fields(specs, "fields", ft.REQUIRED_SPEC_FIELDS).select("s_suppkey", F.array_join("missing", ",").alias("missing"))
