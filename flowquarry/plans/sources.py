"""Reading and writing flow files, caches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.config import StudyConfig
from flowquarry.operators import sampling, windows
from flowquarry.operators.preparation import label_dimension
from flowquarry.plans.adapters import EVENT_FEATURES, flows
from flowquarry.plans.registry import FLOWS, query, rounded, with_sql
from flowquarry.plans.windows import windows_cte
from flowquarry.session import scratch_path
from flowquarry.sources import cache, ingest, reports

def csv_columns() -> dict:
    return {
        "Flow ID": F.col("row_key").cast("string"), " Timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Src IP": F.col("src_ip"), " Dst IP": F.col("dst_ip"),
        " Flow Bytes/s": F.when(F.col("k") == 0, "Infinity").otherwise(F.col("value").cast("string")),
        "Flow Duration ": F.col("user_id").cast("string"),
        " Label": F.when(~((F.col("k") == 1) & (F.col("event_type") == "signup")), F.col("label")),
    }


def write_raw_files(df, path: str) -> None:
    """One folder of CSV files with padded header names, infinite rates and rows without a label."""
    df.select(*[c.alias(n) for n, c in csv_columns().items()]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _ingested(spark, sf_dir):
    raw, store = scratch_path(spark, "raw-csv"), scratch_path(spark, "flow-store")
    write_raw_files(flows(spark, sf_dir), raw)
    ingest.ingest(spark, raw, store, ["Flow Bytes/s", "Flow Duration"])
    return ingest.ingest(spark, raw, store), store  # the second run finds nothing to do


@query("ingest_csv", with_sql([FLOWS], """
SELECT CAST(row_key AS VARCHAR) AS flow_id, src_ip, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE value END AS rate,
  CAST(user_id AS DOUBLE) AS duration, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, label, label <> 'BENIGN' AS is_attack
FROM flows WHERE NOT (k = 1 AND event_type = 'signup')"""))
def ingest_csv(spark, sf_dir):
    table, _ = _ingested(spark, sf_dir)
    return table.select(
        F.col("Flow ID").alias("flow_id"), F.col("Src IP").alias("src_ip"), F.col("`Flow Bytes/s`").alias("rate"),
        F.col("Flow Duration").alias("duration"), F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.col("Label").alias("label"), "is_attack")


@query("ingest_rejects", with_sql([FLOWS], """
SELECT CAST(row_key AS VARCHAR) AS flow_id, value FROM flows WHERE k = 1 AND event_type = 'signup'"""))
def ingest_rejects(spark, sf_dir):
    _, store = _ingested(spark, sf_dir)
    rejects = ingest.read_rejects(spark, store)
    return rejects.select(F.col("Flow ID").alias("flow_id"), F.col("`Flow Bytes/s`").alias("value"))


FOLDER = r"([^/]+)/[^/]+$"


@query("ingest_day_first_times", with_sql([FLOWS], """
SELECT CAST(row_key AS VARCHAR) AS flow_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN row_key % 50 = 0 THEN 'time' END AS reject_reason
FROM flows WHERE row_key % 50 <> 0
UNION ALL SELECT CAST(row_key AS VARCHAR), NULL, 'time' FROM flows WHERE row_key % 50 = 0"""))
def ingest_day_first_times(spark, sf_dir):
    """Times as the public flow tables write them, day first, and some that cannot be read."""
    raw, store = scratch_path(spark, "raw-csv"), scratch_path(spark, "flow-store")
    day_first = F.when(F.col("row_key") % 50 == 0, "yesterday").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    flows(spark, sf_dir).select(
        F.col("row_key").alias("Flow ID"), day_first.alias("Timestamp"), F.col("label").alias("Label")).write.option("header", True).csv(raw)
    table = ingest.ingest(spark, raw, store)
    rejects = ingest.read_rejects(spark, store).select(F.col("Flow ID").alias("flow_id"), F.lit(None).cast("string").alias("at"), "reject_reason")
    return table.select(
        F.col("Flow ID").alias("flow_id"), F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.lit(None).cast("string").alias("reject_reason")).union(rejects)


@query("ingest_text_columns", with_sql([FLOWS], """
SELECT event_type AS service, count(*) AS n, round(sum(value), 4) AS rate FROM flows GROUP BY event_type"""))
def ingest_text_columns(spark, sf_dir):
    """A column that is no feature stays text."""
    raw, store = scratch_path(spark, "raw-csv"), scratch_path(spark, "flow-store")
    flows(spark, sf_dir).select(
        F.col("event_type").alias(" Service"), F.col("value").alias("Flow Bytes/s"), F.col("label").alias("Label")).write.option("header", True).csv(raw)
    table = ingest.ingest(spark, raw, store)
    return rounded(table.groupBy(F.col("Service").alias("service")).agg(F.count("*").alias("n"), F.sum("`Flow Bytes/s`").alias("rate")), 4, "rate")


def _deliver(df, raw: str, source: str) -> None:
    df.select(F.col("row_key").alias("Flow ID"), F.col("label").alias("Label")).write.mode("overwrite").option("header", True).csv(f"{raw}/{source}")


@query("ingest_redelivered", with_sql([FLOWS], """
SELECT 'even' AS source, label, label <> 'BENIGN' AS is_attack, count(*) AS n FROM flows WHERE row_key % 2 = 0 AND label = 'BENIGN' GROUP BY label
UNION ALL SELECT 'odd', label, label <> 'BENIGN', count(*) FROM flows WHERE row_key % 2 = 1 GROUP BY label"""))
def ingest_redelivered(spark, sf_dir):
    """A source that is delivered again without its attacks keeps none of them."""
    raw, store = scratch_path(spark, "raw-csv"), scratch_path(spark, "flow-store")
    df = flows(spark, sf_dir)
    _deliver(df.filter("row_key % 2 = 0"), raw, "even")
    _deliver(df.filter("row_key % 2 = 1"), raw, "odd")
    ingest.ingest(spark, raw, store, source=FOLDER)
    _deliver(df.filter("row_key % 2 = 0 AND NOT is_attack"), raw, "even")
    table = ingest.ingest(spark, raw, store, source=FOLDER)
    return table.groupBy("source", F.col("Label").alias("label"), "is_attack").agg(F.count("*").alias("n"))


@query("ingest_unlabelled_files", with_sql([FLOWS], """
SELECT source, 'no label column' AS reason, NULL::BIGINT AS n FROM (SELECT DISTINCT source FROM flows) WHERE source < '2024-01-04'
UNION ALL SELECT source, NULL, count(*) FROM flows WHERE source >= '2024-01-04' AND source < '2024-01-07' GROUP BY source"""))
def ingest_unlabelled_files(spark, sf_dir):
    """Files without a label column leave a trace; the others are read."""
    raw, store = scratch_path(spark, "raw-csv"), scratch_path(spark, "flow-store")
    df = flows(spark, sf_dir).filter("source < '2024-01-07'").withColumn("day", F.col("source"))
    df = df.withColumnsRenamed({"label": "Label", "row_key": "Flow ID"})
    for part, columns in (("source < '2024-01-04'", ["day", "Flow ID"]), ("source >= '2024-01-04'", ["day", "Flow ID", "Label"])):
        df.filter(part).select(*columns).write.mode("append").partitionBy("day").option("header", True).csv(raw)
    table = ingest.ingest(spark, raw, store, source=r"day=([^/]+)/[^/]+$")
    bad = ingest.unlabelled_sources(spark, store).withColumn("n", F.lit(None).cast("long"))
    return ingest.list_sources(table).select("source", F.lit(None).cast("string").alias("reason"), F.col("rows").alias("n")).union(bad)


@query("list_sources", with_sql([FLOWS], """
SELECT source, count(*) AS rows FROM flows GROUP BY source"""))
def list_sources(spark, sf_dir):
    return ingest.list_sources(flows(spark, sf_dir))


@query("ingest_label_scan", with_sql([FLOWS], """
SELECT label, count(*) AS n FROM flows WHERE label <> 'BENIGN' AND NOT (k = 1 AND event_type = 'signup') GROUP BY label"""))
def ingest_label_scan(spark, sf_dir):
    table, _ = _ingested(spark, sf_dir)
    return sampling.label_counts(table.filter("is_attack"), "Label")


@query("model_ready_cache", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT window_id, label, count(*) OVER () AS windows FROM cut WHERE step_no = 9"""))
def model_ready_cache(spark, sf_dir):
    df, root = flows(spark, sf_dir), scratch_path(spark, "model-cache")

    def build():
        w = windows.count_windows(df, ["ts", "row_key"], EVENT_FEATURES, "label")
        return windows.flatten_windows(w).select("window_id", "flat", "label"), label_dimension(df)

    config = StudyConfig(features=EVENT_FEATURES)
    cache.load_or_build(spark, root, config, [sf_dir], build)
    rows, _ = cache.load_or_build(spark, root, config, [sf_dir], build)
    return rows.select("window_id", "label", rows.agg(F.count("*")).scalar().alias("windows"))


@query("cache_after_change", with_sql([FLOWS], """
SELECT label, count(*) AS first_rows, CAST(count(*) * 2 AS BIGINT) AS rows_after FROM flows GROUP BY label"""))
def cache_after_change(spark, sf_dir):
    """A cached table is built again when a file below its input was added, and read as it is when none was."""
    source, root, built = scratch_path(spark, "cache-input"), scratch_path(spark, "model-cache"), []
    narrow = flows(spark, sf_dir).select("row_key", "label")
    narrow.write.parquet(source)

    def build():
        built.append(1)
        rows = spark.read.parquet(source)
        return rows, label_dimension(rows)

    load = lambda: cache.load_or_build(spark, root, StudyConfig(features=EVENT_FEATURES), [source], build)[0]
    first = load().groupBy("label").agg(F.count("*").alias("first_rows"))
    load()
    narrow.write.mode("append").parquet(source)
    after = load().groupBy("label").agg(F.count("*").alias("rows_after"))
    if len(built) != 2:
        raise ValueError(f"built {len(built)} times")
    return first.join(after, "label")


AUDIT = "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM flows) * 100, 2) AS percent FROM flows GROUP BY label"


@query("report_json", with_sql([FLOWS], AUDIT))
def report_json(spark, sf_dir):
    root = scratch_path(spark, "reports")
    audit = sampling.class_audit(flows(spark, sf_dir))
    reports.write_versioned_json(audit.limit(1), root, "run-1")
    reports.write_versioned_json(audit, root, "run-2")
    return reports.read_latest_json(spark, root, audit.schema)


@query("report_summary", with_sql([FLOWS], AUDIT))
def report_summary(spark, sf_dir):
    root = scratch_path(spark, "summary")
    audit = sampling.class_audit(flows(spark, sf_dir))
    reports.write_summary(audit, root)
    return rounded(reports.read_summary(spark, root, audit.schema), 2, "percent")


@query("report_csv", with_sql([FLOWS], AUDIT))
def report_csv(spark, sf_dir):
    root = scratch_path(spark, "summary")
    audit = sampling.class_audit(flows(spark, sf_dir))
    reports.write_csv(audit, f"{root}/summary.csv")
    return rounded(reports.read_summary(spark, root, audit.schema), 2, "percent")
