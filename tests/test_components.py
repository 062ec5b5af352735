import numpy as np
import pytest

from flowquarry.operators import components, profiling

RNG = np.random.default_rng(3)
BASE = RNG.normal(size=(300, 3))
X = np.column_stack([BASE[:, 0], BASE[:, 0] + 0.01 * BASE[:, 1], BASE[:, 1], 5 + 100 * BASE[:, 2], BASE @ [1, 1, 1]])
NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], ["id", *NAMES])


@pytest.fixture(scope="module")
def fit(df):
    return components.fit_components(df, NAMES)


def test_ratios_are_those_of_the_standardised_data(fit):
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(fit.ratios, values / values.sum())
    assert all(row[np.argmax(np.abs(row))] > 0 for row in fit.loadings)


def test_counts_for_targets(spark, fit):
    cumulative = np.cumsum(fit.ratios)
    for r in components.variance_targets(spark, fit).collect():
        k = r["n_components"]
        assert cumulative[k - 1] > r["variance_threshold"] and (k == 1 or cumulative[k - 2] <= r["variance_threshold"])


def test_projection(df, fit):
    rows = components.project(df, fit, ["id"]).orderBy("id").collect()
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    assert np.allclose([[r["pc1"], r["pc2"], r["pc3"]] for r in rows], z @ fit.loadings[:3].T)


def test_correlated_pairs_lose_the_weaker_feature(spark, df):
    pairs = profiling.high_correlations(profiling.correlation_matrix(df, NAMES), 0.95)
    assert [(r["feature1"], r["feature2"]) for r in pairs.collect()] == [("a", "b")]
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.1)], "feature string, pca_importance_score double")
    assert {r["feature"] for r in components.prune_correlated(scores, pairs).collect()} == {"b", "c"}
    tie = spark.createDataFrame([("a", 0.3), ("b", 0.3)], "feature string, pca_importance_score double")
    assert {r["feature"] for r in components.prune_correlated(tie, pairs).collect()} == {"a"}
    one = spark.createDataFrame([("b", 0.3)], "feature string, pca_importance_score double")
    assert {r["feature"] for r in components.prune_correlated(one, pairs).collect()} == {"b"}


def test_report_and_scores(spark, fit):
    report = components.component_report(spark, fit, 0.95, top=2)
    rows = report.filter("component = 1").orderBy("place").collect()
    order = np.argsort(-np.abs(fit.loadings[0]))[:2]
    assert [r["feature"] for r in rows] == [NAMES[j] for j in order]
    scores = {r["feature"]: r["pca_importance_score"] for r in components.distinctive_scores(report, 1, 2).collect()}
    assert scores == {NAMES[j]: pytest.approx(abs(fit.loadings[0][j]) * fit.ratios[0]) for j in order}
    ranked = components.rank_distinctive(components.distinctive_scores(report))
    assert components.distinctive_per_component(report, ranked).filter("distinctive = 2").count() >= 1
