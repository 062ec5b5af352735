import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import evaluation, profiling, ranks

PICK = np.random.default_rng(12)


def table(spark, values):
    return spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, value double").repartition(4)


VALUES = {
    "wide": PICK.normal(0, 1000, 3_000), "ties": PICK.integers(0, 5, 2_000), "hot": np.concatenate([np.full(1_500, 7.0), PICK.normal(0, 1, 500)]),
    "two": np.array([3.0, -1.0]), "one": np.array([5.0]),
}
QUANTILES = (0.25, 0.5, 0.75)


@pytest.mark.parametrize("small_group", [10_000, 100])
def test_quantiles_equal_numpy(spark, monkeypatch, small_group):
    monkeypatch.setattr(ranks, "SMALL_GROUP", small_group)  # few rows: brackets hold all of them, or real brackets
    monkeypatch.setattr(ranks, "ACCURACY", 500)
    rows = table(spark, VALUES)
    brackets = ranks.quantile_brackets(rows, ["g"], "value", QUANTILES)
    cells = ranks.strata(rows, brackets, ["g"], "value", 3)
    found = cells.groupBy("g", "n").agg(*[a for q in QUANTILES for a in ranks.quantile_at(q)])
    found = found.select("g", *[ranks.interpolated(q).alias(f"q{int(q * 100)}") for q in QUANTILES])
    got = {r["g"]: tuple(r)[1:] for r in found.collect()}
    assert got == {g: pytest.approx(tuple(np.quantile(v, QUANTILES))) for g, v in VALUES.items()}
    if small_group == 100:
        assert cells.filter("g = 'wide'").count() < 200  # what lies between the brackets is one row each


def test_cells_and_running_counts(spark):
    rows = table(spark, VALUES)
    cuts = ranks.cell_cuts(rows, ["g"], "value", {"total": F.count("*")})
    counts = rows.groupBy("g", "value").agg(F.count("*").alias("n"))
    held = ranks.running_in_cells(counts, cuts, ["g"], "value", ["n"]).collect()
    cells = ranks.before_cells(spark.createDataFrame(held).groupBy("g", "_cell").agg(F.sum("n").alias("n")), ["g"], ["n"])
    before = {(r["g"], r["_cell"]): r["before_n"] for r in cells.collect()}
    for r in held:
        assert before[r["g"], r["_cell"]] + r["in_n"] == (VALUES[r["g"]] <= r["value"]).sum()
        assert r["total"] == len(VALUES[r["g"]])
    assert len({r["_cell"] for r in held if r["g"] == "wide"}) > 200


def test_ks_and_boxes_of_a_larger_table(spark):
    rows = [(bool(i % 3), float(v), float(i % 7)) for i, v in enumerate(PICK.normal(0, 1, 12_000))]
    rows = [(flag, a + 0.1 * flag, b) for flag, a, b in rows]
    df = spark.createDataFrame(rows, "is_attack boolean, a double, b double").repartition(4)
    got = {r["feature"]: r["ks_statistic"] for r in profiling.ks_test(profiling.value_ranks(df, ["a", "b"])).collect()}
    for j, name in ((1, "a"), (2, "b")):
        x, y = (np.array([r[j] for r in rows if r[0] == flag]) for flag in (True, False))
        at = np.unique(np.concatenate([x, y]))
        gap = np.abs(np.searchsorted(np.sort(x), at, side="right") / len(x) - np.searchsorted(np.sort(y), at, side="right") / len(y))
        assert got[name] == pytest.approx(gap.max())
    boxes = {(r["feature"], r["class"]): r for r in profiling.box_statistics(df, ["a"]).collect()}
    values = np.array([r[1] for r in rows if r[0]])
    q1, q2, q3 = np.quantile(values, QUANTILES)
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    row = boxes["a", "attack"]
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, q2, q3))
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (inside.min(), inside.max(), len(values) - len(inside))


def test_auc_of_many_scores(spark):
    y = PICK.integers(0, 2, 4_000)
    score = np.round(np.clip(PICK.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    df = spark.createDataFrame([(int(t), [1 - float(s), float(s)]) for t, s in zip(y, score)], "y_true int, proba array<double>").repartition(4)
    got = {r["class"]: r["auc"] for r in evaluation.roc_auc(evaluation.score_ranks(df)).collect()}
    pos, neg = score[y == 1], score[y == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got[1] == pytest.approx(expected)
    points = [(r["fpr"], r["tpr"]) for r in evaluation.roc_points(evaluation.score_ranks(df)).filter("class = 1").orderBy(F.desc("score")).collect()]
    assert points == [pytest.approx(((neg >= s).mean(), (pos >= s).mean())) for s in sorted(set(score.tolist()), reverse=True)]
