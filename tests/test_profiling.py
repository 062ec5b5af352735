import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.functions.stats import chi2_tail, kolmogorov_tail
from flowquarry.operators import profiling
from flowquarry.plans.studies import feature_study

RNG = np.random.default_rng(11)
# A third of the values are the same, as in count columns of flow tables.
DATA = [(bool(i % 3), 0.0 if i % 3 == 1 else round(float(RNG.normal(i % 2, 2)), 3), float(i % 7)) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA, "is_attack boolean, a double, b double")


def split(j):
    return (np.array([r[j] for r in DATA if r[0]]), np.array([r[j] for r in DATA if not r[0]]))


def test_numeric_profile(df):
    row = {r["feature"]: r for r in profiling.numeric_profile(df, ["a", "b"]).collect()}["a"]
    a = np.array([r[1] for r in DATA])
    assert row["mean"] == pytest.approx(a.mean()) and row["std"] == pytest.approx(a.std(ddof=1))
    assert row["unique_count"] == len(set(a)) and row["zero_ratio"] == pytest.approx((a == 0).mean())
    assert row["cv"] == pytest.approx(a.std(ddof=1) / a.mean())
    approx = {r["feature"]: r for r in profiling.numeric_profile(df, ["b"], approximate=True).collect()}
    assert approx["b"]["unique_count"] == 7


def test_zero_mean_has_infinite_variation(spark):
    df = spark.createDataFrame([(True, -1.0), (False, 1.0)], "is_attack boolean, x double")
    assert profiling.numeric_profile(df, ["x"]).first()["cv"] == math.inf


def test_ks_equals_the_direct_computation(df):
    ranks = profiling.value_ranks(df, ["a", "b"])
    got = {r["feature"]: r for r in profiling.ks_test(ranks).collect()}
    for j, name in ((1, "a"), (2, "b")):
        x, y = split(j)
        at = np.unique(np.concatenate([x, y]))
        gap = [abs((x <= v).mean() - (y <= v).mean()) for v in at]
        assert got[name]["ks_statistic"] == pytest.approx(max(gap))


def test_tails_against_tables(spark):
    one = spark.range(1)
    # Critical values: chi-square 5 % at 1, 2, 5 and 10 degrees; Kolmogorov 5 % at 1.3581.
    for x, dof in ((3.8415, 1), (5.9915, 2), (11.0705, 5), (18.3070, 10)):
        got = one.select(chi2_tail(F.lit(x), F.lit(dof))).first()[0]
        assert got == pytest.approx(0.05, abs=1e-5)
    n = 2_000_000
    tail = one.select(kolmogorov_tail(F.lit(1.3581 / math.sqrt(n / 2)), F.lit(n), F.lit(n))).first()[0]
    assert tail == pytest.approx(0.05, abs=1e-4)
    assert one.select(kolmogorov_tail(F.lit(0.0), F.lit(50), F.lit(50))).first()[0] == 1.0


def test_effect_size(df):
    row = {r["feature"]: r for r in profiling.effect_sizes(profiling.class_moments(df, ["a", "b"])).collect()}["a"]
    x, y = split(1)
    pooled = math.sqrt(((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / (len(x) + len(y) - 2))
    assert row["cohens_d"] == pytest.approx(abs(x.mean() - y.mean()) / pooled)
    assert row["mean_ratio"] == pytest.approx(x.mean() / y.mean())


def test_box_statistics(df):
    got = {(r["feature"], r["class"]): r for r in profiling.box_statistics(df, ["a", "b"]).collect()}
    for cls, values in zip(("attack", "benign"), split(1)):
        row, (q1, q2, q3) = got[("a", cls)], np.quantile(values, [0.25, 0.5, 0.75])
        assert (row["q1"], row["median"], row["q3"]) == (pytest.approx(q1), pytest.approx(q2), pytest.approx(q3))
        reach = 1.5 * (q3 - q1)
        inside = values[(values >= q1 - reach) & (values <= q3 + reach)]
        assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
        assert row["outliers"] == len(values) - len(inside)


def test_corrected_moments(spark, df):
    a = np.array([r[1] for r in DATA])
    n, c = len(a), a - a.mean()
    g1 = (c**3).mean() / (c**2).mean() ** 1.5
    g2 = (c**4).mean() / (c**2).mean() ** 2 - 3
    row = profiling.corrected_moments(df, ["a"]).first()
    assert row["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    flat = spark.createDataFrame([(5.0,)] * 5 + [(None,)], "x double")
    assert tuple(profiling.corrected_moments(flat, ["x"]).first()) == ("x", 5, 0.0, 0.0)


def test_yates_and_cramers_v(spark):
    rows = [("u", True)] * 12 + [("u", False)] * 5 + [("v", True)] * 6 + [("v", False)] * 9
    df = spark.createDataFrame(rows, "c string, is_attack boolean")
    row = profiling.chi_square(profiling.category_counts(df, ["c"])).first()
    table, n = np.array([[12, 5], [6, 9]]), 32
    e = np.outer(table.sum(axis=1), table.sum(axis=0)) / n
    chi2 = ((np.abs(table - e) - 0.5) ** 2 / e).sum()
    assert row["dof"] == 1 and row["chi2_statistic"] == pytest.approx(chi2)
    assert row["cramers_v"] == pytest.approx(math.sqrt(chi2 / n))


def test_categories_that_are_not_tested(spark):
    rows = [("x", str(i), i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "one string, many string, is_attack boolean")
    counts = profiling.category_counts(df, ["one", "many"])
    bounded = profiling.chi_square(counts, max_categories=50)
    assert [(r["chi2_statistic"], r["cramers_v"]) for r in bounded.collect()] == [(None, None)] * 2
    free = {r["column"]: r["chi2_statistic"] for r in profiling.chi_square(counts).collect()}
    assert free["one"] is None and abs(free["many"] - 60) < 1e-9
    scored = profiling.categorical_importance(profiling.categorical_profile(counts), bounded)
    got = {r["column"]: r for r in scored.collect()}
    assert got["one"]["entropy"] == 0 and not got["one"]["is_discriminative"]
    assert got["many"]["importance_score"] == pytest.approx((3.0 + 2.0) / 7)


def test_null_categories_and_ties(spark):
    df = spark.createDataFrame([("b", True), ("a", True), (None, False)], "c string, is_attack boolean")
    row = profiling.categorical_profile(profiling.category_counts(df, ["c"])).first()
    assert (row["unique_count"], row["most_frequent"]) == (3, "a")
    assert row["entropy"] == pytest.approx(math.log(3))


def test_histogram_covers_all_rows(df):
    rows = profiling.density_histogram(df, ["a"]).collect()
    counts, edges = np.histogram([r[1] for r in DATA], bins=30)
    assert {r["bin"]: r["n"] for r in rows} == {i: c for i, c in enumerate(counts) if c}
    assert sum(r["density"] * (edges[1] - edges[0]) for r in rows) == pytest.approx(1)


def test_marker_sizes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", 0.0)], "feature string, variance double")
    got = {r["feature"]: r["marker_size"] for r in profiling.marker_sizes(df).collect()}
    low = 1e-12
    assert got["c"] == 120 and got["b"] == pytest.approx(900)
    assert got["a"] == pytest.approx(120 + 780 * math.log(1 + 1 / low) / math.log(1 + 4 / low))


def test_feature_study_ranks_the_telling_column_first(spark):
    rows = [(i % 2 == 0, float(i % 2) * 5 + (i % 5) / 10 + 1, float(i % 5), "x" if i % 2 else "y") for i in range(200)]
    df = spark.createDataFrame(rows, "is_attack boolean, telling double, dull double, kind string")
    study = feature_study(df, ["telling", "dull", "kind"])
    ranked = {r["feature"]: r for r in study["ranking"].collect()}
    assert ranked["telling"]["is_discriminative"] and ranked["kind"]["is_discriminative"]
    assert not ranked["dull"]["is_discriminative"] and ranked["telling"]["rank"] == 1
    assert tuple(study["summary"].first())[:2] == (3, 2)
    assert [r["feature"] for r in study["suggestion"].collect()][0] == "telling"
