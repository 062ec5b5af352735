"""Principal components of standardised features and the features they point to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.operators.columns import number
from flowquarry.operators.profiling import correlations, per_feature

# Shares of variance that are reported.
VARIANCE_TARGETS = (0.80, 0.90, 0.95, 0.99)


@dataclass(frozen=True)
class Components:
    """Fitted components; every part is bounded by the number of columns."""

    features: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    ratios: np.ndarray  # explained share, descending
    loadings: np.ndarray  # component x feature

    def count_for(self, target: float) -> int:
        """Smallest number of components whose cumulative share exceeds ``target``."""
        cumulative = np.cumsum(self.ratios)
        return min(int(np.searchsorted(cumulative, target, side="right")) + 1, len(cumulative))


def fit_components(df: DataFrame, features: Sequence[str]) -> Components:
    """Components of the correlation matrix, which is that of features scaled by their population deviation.

    Spark reduces the rows to one matrix of columns x columns; only that is solved on the driver.
    """
    d = len(features)
    matrix = correlations(df, features)
    moments = {r["feature"]: r for r in per_feature(df, features, {"mean": F.avg, "sd": F.stddev_pop}).collect()}
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, loadings = np.clip(values[order], 0, None), vectors[:, order].T
    # The sign of a component is free; its largest loading is made positive.
    leading = loadings[np.arange(d), np.argmax(np.abs(loadings), axis=1)]
    loadings = loadings * np.where(leading < 0, -1.0, 1.0)[:, None]
    return Components(
        tuple(features), np.array([moments[f]["mean"] for f in features]),
        np.array([moments[f]["sd"] or 1.0 for f in features]), values / values.sum(), loadings)


def variance_targets(spark: SparkSession, fit: Components, targets: Sequence[float] = VARIANCE_TARGETS) -> DataFrame:
    cumulative = np.cumsum(fit.ratios)
    rows = [(float(t), fit.count_for(t), float(cumulative[fit.count_for(t) - 1]), fit.count_for(t)) for t in targets]
    return spark.createDataFrame(
        rows, "variance_threshold double, n_components int, explained_variance double, data_shape int")


def component_report(spark: SparkSession, fit: Components, target: float = 0.95, top: int = 10) -> DataFrame:
    """(component, explained_variance, cumulative_variance, feature, pca_score, abs_pca_score, place): strongest loadings."""
    rows = [
        (i + 1, float(fit.ratios[i]), f, float(fit.loadings[i, j]))
        for i in range(fit.count_for(target)) for j, f in enumerate(fit.features)
    ]
    table = spark.createDataFrame(rows, "component int, explained_variance double, feature string, pca_score double")
    shares = table.select("component", "explained_variance").distinct().withColumn(
        "cumulative_variance", F.sum("explained_variance").over(
            Window.partitionBy().orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
    strongest = Window.partitionBy("component").orderBy(F.desc("abs_pca_score"), "feature")
    return (
        table.withColumn("abs_pca_score", F.abs("pca_score"))
        .withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= top)
        .join(F.broadcast(shares.select("component", "cumulative_variance")), "component")
    )


def project(df: DataFrame, fit: Components, keep: Sequence[str], components: int = 3) -> DataFrame:
    """Coordinates pc1, pc2, ... of each row; a linear expression per row, no shuffle."""
    x = df.select(*keep, F.array(*[number(df, f) for f in fit.features]).alias("_x"))
    out = []
    for i in range(min(components, len(fit.ratios))):
        weights = fit.loadings[i] / fit.sd
        shift = float(np.dot(weights, fit.mean))
        w = F.array(*[F.lit(float(v)) for v in weights])
        dot = F.aggregate(F.zip_with("_x", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        out.append((dot - F.lit(shift)).alias(f"pc{i + 1}"))
    return x.select(*keep, *out)


def distinctive_scores(
    report: DataFrame, max_components: int = 10, per_component: int = 10, min_loading: float = 0.05
) -> DataFrame:
    """Sum of |loading| * explained share over the leading components where a feature is among the strongest."""
    leading = report.filter(
        (F.col("component") <= max_components) & (F.col("place") <= per_component)
        & (F.col("abs_pca_score") > min_loading))
    return leading.groupBy("feature").agg(
        F.sum(F.col("abs_pca_score") * F.col("explained_variance")).alias("pca_importance_score"))


def prune_correlated(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drops the weaker feature of every highly correlated pair of candidates (the second one on a tie)."""
    first = scores.select(F.col("feature").alias("feature1"), F.col("pca_importance_score").alias("s1"))
    second = scores.select(F.col("feature").alias("feature2"), F.col("pca_importance_score").alias("s2"))
    weaker = pairs.join(first, "feature1").join(second, "feature2").select(
        F.when(F.col("s1") < F.col("s2"), F.col("feature1")).otherwise(F.col("feature2")).alias("feature"))
    return scores.join(weaker, "feature", "left_anti")


def rank_distinctive(kept: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("pca_importance_score"), "feature"))
    return kept.withColumn("rank", rank)


def distinctive_per_component(report: DataFrame, ranked: DataFrame, components: int = 5, top: int = 5) -> DataFrame:
    """How many of the strongest features of each leading component are distinctive."""
    marked = report.filter((F.col("component") <= components) & (F.col("place") <= top)).join(
        F.broadcast(ranked.select("feature", F.lit(1).alias("_hit"))), "feature", "left")
    return marked.groupBy("component").agg(F.count("_hit").alias("distinctive"))
