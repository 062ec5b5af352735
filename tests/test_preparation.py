from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import preparation


def frame(spark, n=103):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 10 == 0), [float(v) for v in rng.normal(3, 2, 3)] + [7.0]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label_id int, x array<double>")


def test_label_dimension_is_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("C",)], "label string")
    got = [(r["label_id"], r["label"]) for r in preparation.label_dimension(df).orderBy("label_id").collect()]
    assert got == [(0, "C"), (1, "a"), (2, "b")]
    assert preparation.encode_labels(df, preparation.label_dimension(df)).count() == 4


def test_folds_are_even_in_every_class(spark):
    folded = preparation.assign_folds(frame(spark), 5, 79, "id", "label_id").collect()
    counts = Counter((r["label_id"], r["fold"]) for r in folded)
    for cls in (0, 1):
        sizes = [counts[(cls, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(1 for r in folded if r["label_id"] == cls)


def test_small_classes_switch_to_plain_folds(spark):
    df = frame(spark, 23)  # 3 rows of class 1, fewer than the 5 folds
    sizes = Counter(r["fold"] for r in preparation.assign_folds(df, 5, 79, "id", "label_id").collect())
    assert sorted(sizes.values()) == [4, 4, 5, 5, 5]


def test_split_sizes(spark):
    split = preparation.split_train_validation(frame(spark), 0.2, 79, "id", "label_id").collect()
    assert Counter(r["label_id"] for r in split if r["is_validation"]) == {0: 18, 1: 2}


def test_fold_scalers_equal_numpy(spark):
    rows = preparation.assign_folds(frame(spark), 4, 79, "id", "label_id")
    data = rows.collect()
    scalers = {(r["fold"], r["feature"]): r for r in preparation.fold_scalers(rows, "x", 4).collect()}
    for f in range(4):
        train = np.array([r["x"] for r in data if r["fold"] != f])
        for j in range(4):
            s = scalers[(f, j)]
            assert s["n"] == len(train)
            assert s["mean"] == pytest.approx(train[:, j].mean())
            assert s["sd"] == pytest.approx(train[:, j].std() or 1.0)


def test_scaled_training_rows_are_standard_and_constants_are_centred(spark):
    df = frame(spark)
    scaled = preparation.scale_array(df, preparation.train_scaler(df, "x"), "x")
    z = np.array([r["scaled"] for r in scaled.collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.std(axis=0), [1, 1, 1, 0])


def test_window_scaler_pools_time_steps(spark):
    df = spark.createDataFrame([(0, [[1.0, 10.0], [3.0, 10.0]]), (1, [[5.0, 10.0], [7.0, 10.0]])], "w int, x array<array<double>>")
    scaled = preparation.scale_windows(df, preparation.window_scaler(df, "x"), "x").orderBy("w").collect()
    sd = np.std([1, 3, 5, 7])
    assert np.allclose([r["scaled"] for r in scaled], [[[-3 / sd, 0], [-1 / sd, 0]], [[1 / sd, 0], [3 / sd, 0]]])


def test_block_folds_leave_a_gap(spark):
    w = spark.range(40).select(F.col("id").alias("window_id"))
    got = {r["window_id"]: r["fold"] for r in preparation.assign_block_folds(w, 3, 10, 2).collect()}
    assert got[0] == 0 and got[7] == 0 and got[8] == got[9] == -1 and got[10] == 1 and got[30] == 0
