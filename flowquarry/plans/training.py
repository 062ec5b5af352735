"""Classifiers on the embeddings; results depend on the optimiser, so only rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.config import StudyConfig
from flowquarry.operators import model, training
from flowquarry.plans.adapters import flows, vectors
from flowquarry.plans.registry import FLOWS, VECTORS, hash_order, query, rounded, with_sql
from flowquarry.plans.studies import FlowColumns, prepare, train_and_evaluate
from flowquarry.plans.windows import windows_cte
from flowquarry.session import scratch_path, settle

NAMES = FlowColumns("row_key", "source", "label", "ts", ("src_ip", "dst_ip"))
# models are fitted on at most FIT_ROWS windows and measured on all windows
FLOW_CONFIG = StudyConfig(sample_size=None, k_folds=2, features=("src_ip", "dst_ip", "value", "user_id", "k"))
FIT_ROWS = 3_000
SEED = 79


@query("train_dense")
def train_dense(spark, sf_dir):
    df = vectors(spark, sf_dir)
    model, scaler = training.fit_final(df, "dense", max_iter=10)
    return training.score(model, scaler, df, ["id"]).select("id", "y_true", "y_pred")


@query("train_weighted")
def train_weighted(spark, sf_dir):
    df = vectors(spark, sf_dir)
    model, scaler = training.fit_final(df, "logistic", max_iter=10)
    return training.score(model, scaler, df, ["id"]).select("id", "y_true", "y_pred")


@query("cv_accuracy")
def cv_accuracy(spark, sf_dir):
    pred = training.cross_validate(vectors(spark, sf_dir), "logistic", k=3, max_iter=10)
    return rounded(training.fold_accuracy(pred), 6, "accuracy")


@query("cv_class_losses")
def cv_class_losses(spark, sf_dir):
    pred = training.cross_validate(
        vectors(spark, sf_dir), "dense", k=2, max_iter=6, stages=2, overrides={"hidden": (16,)})
    return rounded(training.stage_losses(pred), 6, "cross_entropy")


CANDIDATES = [("logistic", {"reg_param": r}) for r in (0.0, 0.01, 0.1)] + [("dense", {"hidden": h}) for h in ((16,), (32, 16))]


@query("successive_halving")
def successive_halving(spark, sf_dir):
    return rounded(training.successive_halving(vectors(spark, sf_dir), CANDIDATES, max_iter=9), 6, "accuracy")


@query("search_rungs", """
SELECT CAST(rung AS INTEGER) AS rung, CAST(CASE rung WHEN 0 THEN 5 ELSE 1 END AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS kept,
  CAST(3 * power(3, rung) AS INTEGER) AS max_iter, true AS best_kept FROM range(2) r(rung)""")
def search_rungs(spark, sf_dir):
    """How many candidates a search tries and keeps, and whether those kept have the best of the accuracies it returns."""
    log = training.successive_halving(vectors(spark, sf_dir), CANDIDATES, max_iter=9)
    worst_kept, best_gone = (F.min(F.when(F.col("kept"), F.col("accuracy"))), F.max(F.when(~F.col("kept"), F.col("accuracy"))))
    return log.groupBy("rung", "max_iter").agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("kept"),
        (worst_kept >= F.coalesce(best_gone, F.lit(0.0))).alias("best_kept"))


@query("class_weight_copies", with_sql([VECTORS], f"""
, weights AS (SELECT label_id, count(*) AS n, (SELECT count(*) / count(DISTINCT label_id) FROM vectors) / count(*) AS weight FROM vectors GROUP BY label_id),
drawn AS (SELECT label_id, n, floor(weight) + CASE WHEN CAST('0x' || substr({hash_order(SEED, "id")}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
            < weight - floor(weight) THEN 1 ELSE 0 END AS copies FROM vectors JOIN weights USING (label_id))
SELECT label_id, n, CAST(sum(copies) AS BIGINT) AS copies FROM drawn GROUP BY label_id, n""".lstrip("\n")))
def class_weight_copies(spark, sf_dir):
    """Rows that a network is fitted on, per class: near even, by repeated rows in place of weights."""
    df = vectors(spark, sf_dir).select("id", "label_id")
    counts = df.groupBy("label_id").agg(F.count("*").alias("n"))
    copies = training.with_copies(df, SEED, "id").groupBy("label_id").agg(F.count("*").alias("copies"))
    return counts.join(copies, "label_id")


@query("saved_model_scores", "SELECT vec_id AS id, true AS same_class, true AS same_chances, true AS same_name FROM embeddings")
def saved_model_scores(spark, sf_dir):
    """A pipeline with scaler and labels scores rows after it was saved and loaded as it did before."""
    df = vectors(spark, sf_dir).withColumn("label", F.concat(F.lit("class "), F.col("label_id")))
    fitted = model.fit_pipeline(df, "logistic", max_iter=5)
    path = scratch_path(spark, "model")
    model.save_pipeline(fitted, path)
    before = model.score_pipeline(fitted, df, ["id"])
    after = model.score_pipeline(model.load_pipeline(path), df.drop("label", "label_id"), ["id"]).withColumnsRenamed(
        {"proba": "p", "y_pred": "y", "predicted": "n"})
    return before.join(after, "id").select(
        "id", (F.col("y_pred") == F.col("y")).alias("same_class"), (F.col("proba") == F.col("p")).alias("same_chances"),
        (F.col("predicted") == F.col("n")).alias("same_name"))


@query("window_grid")
def window_grid(spark, sf_dir):
    rows = []
    for size, step in ((10, 5), (10, 10)):
        data = settle(prepare(flows(spark, sf_dir), FLOW_CONFIG.with_changes(window_size=size, window_step=step), NAMES)[0], "windows")
        for reg in (0.0, 0.1):
            pred = training.cross_validate(data, "logistic", k=2, max_iter=5, overrides={"reg_param": reg}, fit_rows=FIT_ROWS)
            rows.append((size, step, reg, pred.count(), training.mean_accuracy(pred)))
    return rounded(training.grid_results(spark.createDataFrame(
        rows, "window_size int, window_step int, reg_param double, windows long, accuracy double")), 6, "accuracy")


def _report(spark, sf_dir):
    return train_and_evaluate(flows(spark, sf_dir), "logistic", FLOW_CONFIG, NAMES, max_iter=5, fit_rows=FIT_ROWS)


@query("train_and_evaluate")
def train_evaluate(spark, sf_dir):
    return _report(spark, sf_dir).select(
        F.round("accuracy", 6).alias("accuracy"), F.round("detection_rate", 6).alias("detection_rate"),
        F.round("false_alarm_rate", 6).alias("false_alarm_rate"), F.size("confusion").alias("classes"),
        F.aggregate("per_class.support", F.lit(0).cast("long"), lambda n, s: n + s).alias("windows"))


@query("evaluated_windows", with_sql([FLOWS, windows_cte(10, 5)], """
SELECT label, count(*) AS windows FROM cut WHERE step_no = 9 GROUP BY label"""))
def evaluated_windows(spark, sf_dir):
    """Windows of each label that a report is measured on: all there are, at their real shares."""
    pairs = F.arrays_zip(F.col("class_names").alias("label"), F.col("per_class.support").alias("windows"))
    return _report(spark, sf_dir).select(F.inline(pairs)).filter("windows > 0")
