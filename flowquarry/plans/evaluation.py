"""Metrics of a predictions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.config import BENIGN
from flowquarry.operators import evaluation
from flowquarry.plans.adapters import CLASSES, predictions
from flowquarry.plans.registry import PREDICTIONS, query, rounded, with_sql

P = [PREDICTIONS]
GRID = "ids AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS c)"
BINARY = """counts AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred <> 0) AS fp,
  count(*) FILTER (y_true <> 0 AND y_pred = 0) AS fn, count(*) FILTER (y_true <> 0 AND y_pred <> 0) AS tp FROM predictions)"""
SCORES = """scores AS (SELECT y_true, unnest(range(10)) AS class, unnest(proba) AS score FROM predictions),
steps AS (SELECT class, score, count(*) FILTER (y_true = class) AS pos, count(*) FILTER (y_true <> class) AS neg FROM scores GROUP BY class, score),
curve AS (SELECT class, score, pos, neg, sum(pos) OVER w AS up, sum(neg) OVER w AS un,
  sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an FROM steps
  WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""
FOLDED = """folded AS (SELECT *, CAST(id % 5 AS INTEGER) AS fold, CAST(id % 3 + 1 AS INTEGER) AS stage FROM predictions),
losses AS (SELECT fold, stage, y_true, avg(-ln(least(greatest(proba[y_true + 1], 1e-12), 1.0))) AS ce FROM folded GROUP BY ALL)"""


@query("predicted_class", with_sql(P, "SELECT id, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM predictions"))
def predicted_class(spark, sf_dir):
    return evaluation.with_predicted_class(predictions(spark, sf_dir).drop("y_pred")).select("id", "y_pred")


@query("accuracy", with_sql(P, "SELECT round(avg((y_true = y_pred)::INT), 9) AS accuracy FROM predictions"))
def accuracy(spark, sf_dir):
    return rounded(evaluation.accuracy(predictions(spark, sf_dir)), 9, "accuracy")


@query("confusion_matrix", with_sql([*P, GRID], """
SELECT t.c AS y_true, p.c AS y_pred, (SELECT count(*) FROM predictions x WHERE x.y_true = t.c AND x.y_pred = p.c) AS n
FROM ids t CROSS JOIN ids p"""))
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(predictions(spark, sf_dir), CLASSES)


@query("per_class_prf", with_sql([*P, GRID], """
, sums AS (SELECT c AS class, (SELECT count(*) FROM predictions WHERE y_true = c) AS support,
  (SELECT count(*) FROM predictions WHERE y_pred = c) AS predicted,
  (SELECT count(*) FROM predictions WHERE y_pred = c AND y_true = c) AS hit FROM ids)
SELECT class, round(CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END, 9) AS "precision",
  round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 9) AS recall,
  round(CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) ELSE 0 END, 9) AS f1, support FROM sums"""))
def per_class_prf(spark, sf_dir):
    return rounded(evaluation.per_class_scores(predictions(spark, sf_dir), CLASSES), 9, "precision", "recall", "f1")


@query("binary_confusion", with_sql([*P, BINARY], "SELECT * FROM counts"))
def binary_confusion(spark, sf_dir):
    return evaluation.binary_counts(predictions(spark, sf_dir))


@query("detection_rates", with_sql([*P, BINARY], """
SELECT *, round(COALESCE(tp / nullif(tp + fn, 0), 0), 9) AS detection_rate,
  round(COALESCE(fp / nullif(fp + tn, 0), 0), 9) AS false_alarm_rate, round(COALESCE(tp / nullif(tp + fp, 0), 0), 9) AS attack_precision
FROM counts"""))
def detection_rates(spark, sf_dir):
    rates = evaluation.detection_rates(evaluation.binary_counts(predictions(spark, sf_dir)))
    return rounded(rates, 9, "detection_rate", "false_alarm_rate", "attack_precision")


@query("per_attack_detection", with_sql(P, """
SELECT y_true, count(*) AS samples, count(*) FILTER (y_true = y_pred) AS detected,
  round(count(*) FILTER (y_true = y_pred) / count(*), 9) AS detection_rate FROM predictions WHERE y_true <> 0 GROUP BY y_true"""))
def per_attack_detection(spark, sf_dir):
    return rounded(evaluation.attack_type_rates(predictions(spark, sf_dir)), 9, "detection_rate")


@query("per_class_accuracy", """
WITH """ + PREDICTIONS + """, ids AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS y_true)
SELECT y_true, round(COALESCE(avg((predictions.y_true = y_pred)::INT), 0), 9) AS accuracy
FROM ids LEFT JOIN predictions USING (y_true) GROUP BY y_true""")
def per_class_accuracy(spark, sf_dir):
    # Two class ids more than occur: an absent class has accuracy 0.
    return rounded(evaluation.class_accuracy(predictions(spark, sf_dir), CLASSES + 2), 9, "accuracy")


@query("roc_points", with_sql([*P, SCORES], """
SELECT CAST(class AS INTEGER) AS class, score, round(un / an, 9) AS fpr, round(up / ap, 9) AS tpr FROM curve WHERE ap > 0 AND an > 0"""))
def roc_points(spark, sf_dir):
    return rounded(evaluation.roc_points(evaluation.score_ranks(predictions(spark, sf_dir))), 9, "fpr", "tpr")


@query("auc_ovr", with_sql([*P, SCORES], """
SELECT CAST(class AS INTEGER) AS class, round(CAST(sum(neg * (2 * up - pos)) AS DOUBLE) / (2 * any_value(ap) * any_value(an)), 9) AS auc
FROM curve WHERE ap > 0 AND an > 0 GROUP BY class"""))
def auc_ovr(spark, sf_dir):
    return rounded(evaluation.roc_auc(evaluation.score_ranks(predictions(spark, sf_dir))), 9, "auc")


@query("calibration_bins", with_sql(P, """
SELECT CAST(ceil(list_max(proba) * 15) AS INTEGER) AS bin, count(*) AS n, round(avg((y_true = y_pred)::INT), 9) AS accuracy,
  round(avg(list_max(proba)), 9) AS confidence FROM predictions GROUP BY 1"""))
def calibration_bins(spark, sf_dir):
    return rounded(evaluation.calibration_bins(predictions(spark, sf_dir), 15), 9, "accuracy", "confidence")


@query("calibration_error", with_sql(P, """
, bins AS (SELECT ceil(list_max(proba) * 15) AS bin, count(*) AS n, avg((y_true = y_pred)::INT) AS a, avg(list_max(proba)) AS c FROM predictions GROUP BY 1)
SELECT round(sum(abs(a - c) * n) / sum(n), 9) AS ece FROM bins"""))
def calibration_error(spark, sf_dir):
    return rounded(evaluation.calibration_error(predictions(spark, sf_dir), 15), 9, "ece")


def _losses(spark, sf_dir):
    # Fold and stage by the row id, so that every class meets several of both.
    staged = predictions(spark, sf_dir).withColumns({
        "fold": (F.col("id") % 5).cast("int"), "stage": (F.col("id") % 3 + 1).cast("int")})
    return evaluation.class_cross_entropy(staged, ("fold", "stage"))


@query("class_cross_entropy", with_sql([*P, FOLDED], """
SELECT fold, stage, y_true, round(ce, 9) AS cross_entropy FROM losses"""))
def class_cross_entropy(spark, sf_dir):
    return rounded(_losses(spark, sf_dir), 9, "cross_entropy")


@query("fold_mean_loss", with_sql([*P, FOLDED], """
SELECT y_true, stage, round(avg(ce), 9) AS cross_entropy, count(*) AS folds FROM losses GROUP BY y_true, stage"""))
def fold_mean_loss(spark, sf_dir):
    return rounded(evaluation.mean_over_folds(_losses(spark, sf_dir), ("y_true", "stage")), 9, "cross_entropy")


@query("loss_curve", with_sql([*P, FOLDED], """
, grid AS (SELECT CAST(c AS INTEGER) AS y_true, CAST(s AS INTEGER) AS stage FROM range(10) a(c), range(1, 5) b(s))
SELECT y_true, stage, round(avg(ce), 9) AS cross_entropy FROM grid LEFT JOIN losses USING (y_true, stage) GROUP BY y_true, stage"""))
def loss_curve(spark, sf_dir):
    mean = evaluation.mean_over_folds(_losses(spark, sf_dir), ("y_true", "stage")).drop("folds")
    return rounded(evaluation.loss_curve(mean, CLASSES, 4), 9, "cross_entropy")


@query("evaluation_report", with_sql([*P, GRID, BINARY], """
, cells AS (SELECT t.c AS y_true, p.c AS y_pred, (SELECT count(*) FROM predictions x WHERE x.y_true = t.c AND x.y_pred = p.c) AS n
  FROM ids t CROSS JOIN ids p),
lines AS (SELECT y_true, '[' || string_agg(n, ',' ORDER BY y_pred) || ']' AS line FROM cells GROUP BY y_true),
bins AS (SELECT ceil(list_max(proba) * 10) AS bin, count(*) AS n, avg((y_true = y_pred)::INT) AS a, avg(list_max(proba)) AS c FROM predictions GROUP BY 1)
SELECT (SELECT round(avg((y_true = y_pred)::INT), 9) FROM predictions) AS accuracy, round(tp / (tp + fn), 9) AS detection_rate,
  round(fp / (fp + tn), 9) AS false_alarm_rate, round(tp / (tp + fp), 9) AS attack_precision,
  (SELECT round(sum(abs(a - c) * n) / sum(n), 9) FROM bins) AS calibration_error,
  (SELECT '[' || string_agg(line, ',' ORDER BY y_true) || ']' FROM lines) AS confusion,
  (SELECT count(DISTINCT y_true) FROM predictions WHERE y_true <> 0) AS attack_types FROM counts"""))
def evaluation_report(spark, sf_dir):
    dimension = spark.createDataFrame(
        [(i, BENIGN if i == 0 else f"attack_{i}") for i in range(CLASSES)], "label_id int, label string")
    report = evaluation.report(predictions(spark, sf_dir), dimension, BENIGN)
    rates = ("accuracy", "detection_rate", "false_alarm_rate", "attack_precision", "calibration_error")
    return rounded(report, 9, *rates).select(
        *rates, F.to_json("confusion").alias("confusion"), F.size("attack_types").cast("long").alias("attack_types"))
