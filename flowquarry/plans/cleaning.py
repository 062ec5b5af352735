"""Cleaning, column checks and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import columns
from flowquarry.operators.preparation import encode_labels, label_dimension
from flowquarry.plans.adapters import EVENT_FEATURES, flows, table
from flowquarry.plans.registry import FLOWS, query, rounded, with_sql

# A rate as text, with what raw flow files hold: infinite over a zero duration, NaN, junk and empty cells.
RATE_TEXT = """CASE WHEN k = 0 THEN 'Infinity' WHEN user_id = 0 THEN 'NaN' WHEN user_id = 1 THEN '-Infinity'
  WHEN event_type = 'signup' AND k = 1 THEN 'n/a' WHEN event_type = 'error' AND k = 2 THEN NULL
  ELSE CAST(value AS {text}) END"""

RAW = FLOWS + ",\nraw AS (SELECT *, " + RATE_TEXT.format(text="VARCHAR") + " AS rate FROM flows)"
CLEAN = """CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0::DOUBLE ELSE {x} END"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).withColumn("rate", F.expr(RATE_TEXT.format(text="STRING")))


@query("clean_numeric", with_sql([RAW], f"""
SELECT row_key, {CLEAN.format(x="TRY_CAST(rate AS DOUBLE)")} AS rate,
       {CLEAN.format(x="TRY_CAST(event_type AS DOUBLE)")} AS kind_number, value FROM raw"""))
def clean_numeric(spark, sf_dir):
    text = raw(spark, sf_dir).select("row_key", "rate", F.col("event_type").alias("kind_number"), "value")
    return columns.clean_numbers(text, ["rate", "kind_number", "value"])


@query("coerce_report", with_sql([RAW], """
SELECT count(*) AS total, count(*) - count(rate) AS missing,
       count(*) FILTER (rate IS NOT NULL AND TRY_CAST(rate AS DOUBLE) IS NULL) AS unreadable,
       count(*) FILTER (isnan(TRY_CAST(rate AS DOUBLE))) AS not_a_number,
       count(*) FILTER (isinf(TRY_CAST(rate AS DOUBLE))) AS infinite
FROM raw"""))
def coerce_report(spark, sf_dir):
    text = raw(spark, sf_dir)
    number = columns.readable(text, "rate")
    return text.agg(
        F.count("*").alias("total"), F.count_if(F.col("rate").isNull()).alias("missing"),
        F.count_if(F.col("rate").isNotNull() & number.isNull()).alias("unreadable"),
        F.count_if(F.isnan(number)).alias("not_a_number"),
        F.count_if(number.isin(float("inf"), float("-inf"))).alias("infinite"))


CHECKED = {"rate": "rate", "value": "CAST(value AS VARCHAR)", "event_type": "event_type", "sparse": "sparse", "constant": "'7'"}
CHECK_ROWS = "\n  UNION ALL ".join(f"SELECT '{n}' AS c, {e} AS t FROM checked" for n, e in CHECKED.items())
CHECK_PROFILE = RAW + f""",
checked AS (SELECT *, CASE WHEN user_id < 60 THEN CAST(user_id AS VARCHAR) END AS sparse FROM raw),
texts AS ({CHECK_ROWS}),
profile AS (
  SELECT c AS "column", count(*) AS n_rows, count(t) AS present, count(TRY_CAST(t AS DOUBLE)) AS numeric,
         var_samp({CLEAN.format(x="TRY_CAST(t AS DOUBLE)")}) AS variance FROM texts GROUP BY c)"""


def _checked(spark, sf_dir):
    sparse = F.when(F.col("user_id") < 60, F.col("user_id").cast("string"))
    df = raw(spark, sf_dir).select("rate", "value", "event_type", sparse.alias("sparse"), F.lit("7").alias("constant"))
    return columns.column_profile(df)


@query("numeric_columns", with_sql([CHECK_PROFILE], """
SELECT "column", numeric / n_rows > 0.7 AS selector_numeric, numeric / n_rows > 0.8 AS study_numeric,
       numeric / present > 0.8 AS explorer_numeric, round(numeric / n_rows, 6) AS numeric_share FROM profile"""))
def numeric_columns(spark, sf_dir):
    profile = _checked(spark, sf_dir)
    flagged = profile.select(
        "column", (F.col("numeric_share") > 0.7).alias("selector_numeric"),
        (F.col("numeric_share") > 0.8).alias("study_numeric"),
        (F.col("numeric_share_of_present") > 0.8).alias("explorer_numeric"), "numeric_share")
    return rounded(flagged, 6, "numeric_share")


@query("dense_columns", with_sql([CHECK_PROFILE], """
SELECT "column", present FROM profile WHERE present >= floor(n_rows * 0.7)"""))
def dense_columns(spark, sf_dir):
    return columns.dense_columns(_checked(spark, sf_dir)).select("column", "present")


@query("zero_variance", with_sql([CHECK_PROFILE], """
SELECT "column", round(variance, 3) AS variance FROM profile WHERE variance > 0"""))
def zero_variance(spark, sf_dir):
    return rounded(columns.varying_columns(_checked(spark, sf_dir)).select("column", "variance"), 3, "variance")


@query("benign_attack_split", with_sql([FLOWS], """
SELECT source, CASE WHEN label = 'BENIGN' THEN 'benign' ELSE 'attack' END AS side, count(*) AS n
FROM flows GROUP BY ALL"""))
def benign_attack_split(spark, sf_dir):
    benign, attack = columns.split_by_label(flows(spark, sf_dir), "label")
    both = benign.select("source", F.lit("benign").alias("side")).unionByName(
        attack.select("source", F.lit("attack").alias("side")))
    return both.groupBy("source", "side").agg(F.count("*").alias("n"))


@query("binary_target", with_sql([FLOWS], """
SELECT source, CAST(sum(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) AS BIGINT) AS attacks, count(*) AS n
FROM flows GROUP BY source"""))
def binary_target(spark, sf_dir):
    marked = columns.with_attack_flag(flows(spark, sf_dir).drop("is_attack"), "label")
    return marked.groupBy("source").agg(F.sum(F.col("is_attack").cast("int")).alias("attacks"), F.count("*").alias("n"))


@query("rows_of_label", with_sql([FLOWS], """
SELECT row_key, value, user_id FROM flows WHERE label = 'rare'"""))
def rows_of_label(spark, sf_dir):
    return flows(spark, sf_dir).filter(F.col("label") == "rare").select("row_key", "value", "user_id")


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
CLASS_TEXTS = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS t FROM lineitem" for c in LINE_COLUMNS)


@query("column_classes", f"""
WITH texts AS ({CLASS_TEXTS})
SELECT c AS "column",
       CASE WHEN c LIKE '%id%' THEN 'identifier' WHEN c LIKE '%ip%' THEN 'network'
            WHEN c LIKE '%time%' OR c LIKE '%duration%' OR c LIKE '%iat%' THEN 'time' WHEN c LIKE '%flag%' THEN 'flag'
            WHEN c LIKE '%length%' OR c LIKE '%size%' OR c LIKE '%bytes%' OR c LIKE '%packet%' THEN 'size'
            WHEN c LIKE '%/s%' OR c LIKE '%rate%' OR c LIKE '%ratio%' THEN 'rate'
            WHEN c LIKE '%mean%' OR c LIKE '%std%' OR c LIKE '%max%' OR c LIKE '%min%' OR c LIKE '%avg%' THEN 'statistic'
            WHEN c LIKE '%protocol%' OR c LIKE '%port%' THEN 'protocol'
            WHEN c LIKE '%label%' OR c LIKE '%category%' THEN 'label' ELSE 'other' END AS column_class,
       count(TRY_CAST(t AS DOUBLE)) / count(t) > 0.8 AS is_numeric, count(DISTINCT t) AS unique_count
FROM texts GROUP BY c""")
def column_classes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    overview = columns.column_overview(line, LINE_COLUMNS)
    return columns.classify_columns(overview).select("column", "column_class", "is_numeric", "unique_count")


@query("missing_features", with_sql([FLOWS], """
SELECT "column", CASE WHEN "column" IN ('duration', 'packets') THEN 'missing'
       WHEN "column" IN ('value', 'user_id', 'k') THEN 'used' ELSE 'unused' END AS status,
       present
FROM (SELECT 'value' AS "column", count(value) AS present FROM flows
      UNION ALL SELECT 'user_id', count(user_id) FROM flows UNION ALL SELECT 'k', count(k) FROM flows
      UNION ALL SELECT 'src_ip', count(src_ip) FROM flows UNION ALL SELECT 'label', count(label) FROM flows
      UNION ALL SELECT 'duration', 0 UNION ALL SELECT 'packets', 0)"""))
def missing_features(spark, sf_dir):
    df = flows(spark, sf_dir).select("value", "user_id", "k", "src_ip", "label")
    wanted = spark.createDataFrame([(c,) for c in (*EVENT_FEATURES, "duration", "packets")], "column string")
    return columns.compare_columns(columns.column_profile(df), wanted)


@query("tabular_matrix", with_sql([FLOWS], """
SELECT row_key, value AS x0, CAST(user_id AS DOUBLE) AS x1, k AS x2,
       CAST((SELECT count(DISTINCT f.label) FROM flows f WHERE f.label < flows.label) AS INTEGER) AS label_id FROM flows"""))
def tabular_matrix(spark, sf_dir):
    df = flows(spark, sf_dir)
    features = columns.present(df, [*EVENT_FEATURES, "duration"])
    matrix = columns.feature_array(encode_labels(df, label_dimension(df)), features, ["row_key", "label_id"])
    return matrix.select("row_key", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(features))], "label_id")
