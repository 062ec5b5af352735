import math

import pytest

from flowquarry.operators import evaluation

SCHEMA = "id int, y_true int, proba array<double>"


def frame(spark, rows):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], SCHEMA)
    return evaluation.with_predicted_class(df)


@pytest.fixture
def pred(spark):
    return frame(spark, [
        (0, [0.7, 0.2, 0.1]), (0, [0.4, 0.4, 0.2]), (0, [0.1, 0.8, 0.1]),
        (1, [0.2, 0.7, 0.1]), (1, [0.4, 0.3, 0.3]), (1, [0.1, 0.1, 0.8])])


def test_first_largest_probability_wins(pred):
    assert [r["y_pred"] for r in pred.orderBy("id").collect()] == [0, 0, 1, 1, 0, 2]


def test_confusion_and_scores_with_an_absent_class(pred):
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluation.confusion_matrix(pred, 4).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 6 and cells[(0, 0)] == 2 and cells[(3, 3)] == 0
    scores = {r["class"]: r for r in evaluation.per_class_scores(pred, 4).collect()}
    assert (scores[0]["precision"], scores[0]["recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert scores[1]["f1"] == pytest.approx(2 * 1 / (3 + 2))
    assert (scores[3]["precision"], scores[3]["recall"], scores[3]["f1"], scores[3]["support"]) == (0, 0, 0, 0)
    assert {r["y_true"]: r["accuracy"] for r in evaluation.class_accuracy(pred, 3).collect()}[2] == 0


def test_binary_rates(pred, spark):
    row = evaluation.detection_rates(evaluation.binary_counts(pred)).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 1, 1, 2)
    assert row["detection_rate"] == pytest.approx(2 / 3) and row["false_alarm_rate"] == pytest.approx(1 / 3)
    only_benign = frame(spark, [(0, [1.0, 0.0])])
    row = evaluation.detection_rates(evaluation.binary_counts(only_benign)).first()
    assert (row["tn"], row["detection_rate"], row["attack_precision"]) == (1, 0, 0)


def test_attack_types_count_only_the_exact_class(pred):
    rows = evaluation.attack_type_rates(pred).collect()
    assert [(r["y_true"], r["samples"], r["detected"]) for r in rows] == [(1, 3, 1)]


def test_auc_with_ties(spark):
    scores = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = frame(spark, [(y, [1 - s, s]) for y, s in scores])
    ranks = evaluation.score_ranks(df)
    pairs = [(a, b) for ya, a in scores for yb, b in scores if ya == 1 and yb == 0]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert {r["class"]: r["auc"] for r in evaluation.roc_auc(ranks).collect()}[1] == pytest.approx(expected)
    points = sorted((r["fpr"], r["tpr"]) for r in evaluation.roc_points(ranks).collect() if r["class"] == 1)
    assert points == [pytest.approx(p) for p in [(0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1), (1, 1)]]


def test_classes_without_both_sides_have_no_curve(spark):
    df = frame(spark, [(0, [0.6, 0.4]), (0, [0.7, 0.3])])
    assert evaluation.roc_auc(evaluation.score_ranks(df)).count() == 0


def test_calibration_error(spark):
    df = frame(spark, [(0, [0.95, 0.05]), (1, [0.95, 0.05]), (1, [0.35, 0.65])])
    expected = abs(0.5 - 0.95) * 2 / 3 + abs(1 - 0.65) / 3
    assert evaluation.calibration_error(df).first()[0] == pytest.approx(expected)


def test_cross_entropy_is_clipped_and_averaged(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5])])
    got = {r["y_true"]: r["cross_entropy"] for r in evaluation.class_cross_entropy(df).collect()}
    assert got[0] == 0 and got[1] == pytest.approx((-math.log(1e-12) + math.log(2)) / 2)
    losses = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (1, 2, 1.0)], "y_true int, stage int, cross_entropy double")
    mean = evaluation.mean_over_folds(losses, ("y_true", "stage")).drop("folds")
    curve = {(r["y_true"], r["stage"]): r["cross_entropy"] for r in evaluation.loss_curve(mean, 2, 2).collect()}
    assert curve == {(0, 1): 3.0, (0, 2): None, (1, 1): None, (1, 2): 1.0}


def test_report(pred, spark):
    dimension = spark.createDataFrame([(0, "BENIGN"), (1, "dos"), (2, "scan")], "label_id int, label string")
    row = evaluation.report(pred, dimension, "BENIGN").first()
    assert row["confusion"] == [[2, 1, 0], [1, 1, 1], [0, 0, 0]] and row["accuracy"] == pytest.approx(0.5)
    assert row["per_class"]["support"] == [3, 3, 0] and [t["label"] for t in row["attack_types"]] == ["dos"]
    assert evaluation.benign_id(dimension.filter("label <> 'BENIGN'"), "BENIGN") == 0
