"""Row-count windows and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.config import TIME_RESOLUTIONS, WINDOW_PRESETS
from flowquarry.operators import windows
from flowquarry.operators.columns import with_attack_flag
from flowquarry.operators.positions import ordered_positions
from flowquarry.plans.adapters import EVENT_FEATURES, flows
from flowquarry.plans.registry import FLOWS, query, with_sql


def windows_cte(size: int, step: int, partition: str = "") -> str:
    """One row per (window, time step): each position lists the windows it lies in."""
    by = f"PARTITION BY {partition}" if partition else ""
    return f"""placed AS (SELECT *, row_number() OVER ({by} ORDER BY ts, row_key) - 1 AS pos, count(*) OVER ({by}) - 1 AS last_pos FROM flows),
listed AS (SELECT *, unnest(range(greatest((pos - {size} + {step}) // {step}, 0), pos // {step} + 1)) AS window_id FROM placed),
cut AS MATERIALIZED (SELECT *, pos - window_id * {step} AS step_no FROM listed WHERE window_id * {step} + {size} - 1 <= last_pos)"""


def _windows(spark, sf_dir, size=10, step=5, groups=()):
    return windows.count_windows(
        flows(spark, sf_dir), ["ts", "row_key"], EVENT_FEATURES, "label", size, step, groups, keep=["row_key"])


@query("count_windows", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT window_id, step_no, row_key, value, CAST(user_id AS DOUBLE) AS user_id, k FROM cut"""))
def count_windows(spark, sf_dir):
    steps = _windows(spark, sf_dir).select("window_id", F.posexplode(F.arrays_zip("row_key", "x")).alias("step_no", "s"))
    return steps.select(
        "window_id", F.col("step_no").cast("long").alias("step_no"), F.col("s.row_key").alias("row_key"),
        *[F.get("s.x", F.lit(i)).alias(f) for i, f in enumerate(EVENT_FEATURES)])


@query("window_labels", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT window_id, label FROM cut WHERE step_no = 9"""))
def window_labels(spark, sf_dir):
    return _windows(spark, sf_dir).select("window_id", "label")


@query("window_flatten", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT window_id, string_agg(value || ',' || CAST(user_id AS DOUBLE) || ',' || k, ',' ORDER BY step_no) AS flat
FROM cut GROUP BY window_id"""))
def window_flatten(spark, sf_dir):
    flat = windows.flatten_windows(_windows(spark, sf_dir))
    text = F.array_join(F.transform("flat", lambda v: v.cast("string")), ",")
    return flat.select("window_id", text.alias("flat"))


def _preset(name: str):
    size, step = WINDOW_PRESETS[name]

    @query(f"preset_windows_{name}", with_sql([FLOWS, windows_cte(size, step)], f"""
SELECT window_id, min_by(row_key, step_no) AS first_key, max_by(row_key, step_no) AS last_key,
       max_by(label, step_no) AS label, count(*) AS n_rows FROM cut GROUP BY window_id"""))
    def preset(spark, sf_dir):
        w = windows.preset_windows(
            flows(spark, sf_dir), name, order=["ts", "row_key"], features=EVENT_FEATURES, label="label", keep=["row_key"])
        return w.select(
            "window_id", F.element_at("row_key", 1).alias("first_key"), F.element_at("row_key", -1).alias("last_key"),
            "label", F.size("x").cast("long").alias("n_rows"))

    resolution = TIME_RESOLUTIONS[name]

    @query(f"time_windows_{name}", with_sql([FLOWS], f"""
SELECT strftime(time_bucket(INTERVAL '{resolution}', ts), '%Y-%m-%d %H:%M:%S') AS window_start, source, label,
       count(*) AS n FROM flows GROUP BY ALL"""))
    def time_windows(spark, sf_dir):
        counts = windows.time_window_counts(flows(spark, sf_dir), resolution, "ts", ("source", "label"))
        return counts.select(
            F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "source", "label", "n")


for _name in WINDOW_PRESETS:
    _preset(_name)


@query("windows_by_source", with_sql([FLOWS, windows_cte(10, 5, "source")], """
SELECT source, window_id, min_by(row_key, step_no) AS first_key, max_by(row_key, step_no) AS last_key,
       max_by(label, step_no) AS label, count(*) AS n_rows FROM cut GROUP BY source, window_id"""))
def windows_by_source(spark, sf_dir):
    return _windows(spark, sf_dir, groups=["source"]).select(
        "source", "window_id", F.element_at("row_key", 1).alias("first_key"),
        F.element_at("row_key", -1).alias("last_key"), "label", F.size("x").cast("long").alias("n_rows"))


@query("global_order", with_sql([FLOWS], """
SELECT row_key, row_number() OVER (ORDER BY ts, row_key) - 1 AS pos FROM flows"""))
def global_order(spark, sf_dir):
    return ordered_positions(flows(spark, sf_dir).select("ts", "row_key"), ["ts", "row_key"]).select("row_key", "pos")


@query("windows_per_label", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT label, count(*) AS windows, CAST(sum(attacks) AS BIGINT) AS attack_rows FROM (
  SELECT window_id, max_by(label, step_no) AS label, count(*) FILTER (label <> 'BENIGN') AS attacks
  FROM cut GROUP BY window_id) GROUP BY label"""))
def windows_per_label(spark, sf_dir):
    marked = with_attack_flag(flows(spark, sf_dir), "label").withColumn("hit", F.col("is_attack").cast("int"))
    w = windows.count_windows(marked, ["ts", "row_key"], ["hit"], "label")
    attacks = F.aggregate(F.flatten("x"), F.lit(0.0), lambda acc, v: acc + v).cast("long")
    return w.groupBy("label").agg(F.count("*").alias("windows"), F.sum(attacks).alias("attack_rows"))
