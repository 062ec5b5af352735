"""Streams over the events file, run to the end of the data that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.config import BENIGN, TIME_RESOLUTIONS
from flowquarry.operators.evaluation import detection_rates
from flowquarry.plans.adapters import EVENT_FEATURES, event_columns, table
from flowquarry.plans.registry import FLOWS, query, rounded, with_sql
from flowquarry.plans.windows import windows_cte
from flowquarry.session import scratch_path
from flowquarry.streaming import count_windows, monitors
from flowquarry.streaming.state import state_session

WATERMARK = "10 minutes"


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return event_columns(monitors.read_parquet_stream(spark, f"{sf_dir}/events.parquet*", schema))


def _started(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).drop("window_end")


def _label_counts(name: str):
    duration = TIME_RESOLUTIONS[name]

    @query(f"stream_label_counts_{name}", with_sql([FLOWS], f"""
, counted AS (SELECT time_bucket(INTERVAL '{duration}', ts) AS s, time_bucket(INTERVAL '{duration}', ts) + INTERVAL '{duration}' AS window_end,
  label, count(*) AS n FROM flows GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, label, n FROM counted"""))
    def label_counts(spark, sf_dir):
        counts = monitors.label_counts_stream(event_stream(spark, sf_dir), duration, WATERMARK)
        return _started(monitors.run_bounded(counts, ["n"], scratch_path(spark, "label-counts")))


for _name in TIME_RESOLUTIONS:
    _label_counts(_name)


@query("stream_detection_rate", with_sql([FLOWS], f"""
, marked AS (SELECT ts, label <> 'BENIGN' AS a, value > 5 AS f FROM flows),
counted AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
  count(*) FILTER (NOT a AND NOT f) AS tn, count(*) FILTER (NOT a AND f) AS fp, count(*) FILTER (a AND NOT f) AS fn,
  count(*) FILTER (a AND f) AS tp FROM marked GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, tn, fp, fn, tp, round(COALESCE(tp / nullif(tp + fn, 0), 0), 9) AS detection_rate,
  round(COALESCE(fp / nullif(fp + tn, 0), 0), 9) AS false_alarm_rate, round(COALESCE(tp / nullif(tp + fp, 0), 0), 9) AS attack_precision
FROM counted"""))
def stream_detection_rate(spark, sf_dir):
    flagged = F.when(F.col("value") > 5, "flagged").otherwise(BENIGN)
    counts = monitors.confusion_stream(event_stream(spark, sf_dir).withColumn("predicted", flagged), "1 hour", WATERMARK)
    rates = _started(monitors.run_bounded(
        counts, ["tn", "fp", "fn", "tp"], scratch_path(spark, "detection"), finish=detection_rates))
    return rounded(rates, 9, "detection_rate", "false_alarm_rate", "attack_precision")


@query("stream_count_windows", with_sql([FLOWS, windows_cte(10, 5, "source")], """
SELECT source, window_id, min_by(row_key, step_no) AS first_key, max_by(row_key, step_no) AS last_key,
       max_by(label, step_no) AS label FROM cut GROUP BY source, window_id"""))
def stream_count_windows(spark, sf_dir):
    out = count_windows.run_count_windows(
        event_stream(state_session(spark), sf_dir), scratch_path(spark, "stream-windows"), ended=True, watermark=WATERMARK,
        order=["ts", "row_key"], features=EVENT_FEATURES, label="label", size=10, step=5, group_cols=["source"], keep=["row_key"])
    return out.select("source", "window_id", F.element_at("row_key", 1).alias("first_key"),
                      F.element_at("row_key", -1).alias("last_key"), "label")
