"""Feature statistics: profiles, tests of attack against benign, rankings.

Moments are aggregated by feature before any shuffle. Everything that needs the
distinct values of a feature (distinct counts, Kolmogorov-Smirnov, quantiles)
shares one table of value counts, where a value that fills a third of the rows is
a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.stats import chi2_tail, importance, kolmogorov_tail
from flowquarry.operators.columns import long_form, number, quoted, readable
from flowquarry.operators.gram import pair_correlations
from flowquarry.operators.positions import attach
from flowquarry.operators.ranks import (
    before_cells,
    cell_cuts,
    interpolated,
    quantile_at,
    quantile_brackets,
    running_in_cells,
    strata,
)
from flowquarry.session import settle

Stat = Callable[[Column], Column]
EPSILON = 1e-12


def per_feature(
    df: DataFrame, features: Sequence[str], stats: dict[str, Stat], by: Sequence[str] = (), nulls: bool = False
) -> DataFrame:
    """One row per feature (and group) with the given aggregates, from one pass over the table.

    Unreadable values count as 0, or are left out when ``nulls`` is set. Tasks
    aggregate before the shuffle, so only features x groups rows move.
    """
    long = long_form(df, features, by, nulls)
    return long.groupBy(*by, "feature").agg(*[fn(F.col("value")).alias(s) for s, fn in stats.items()])


# --- shared tables -----------------------------------------------------------

def value_counts(df: DataFrame, features: Sequence[str], flag: str = "is_attack") -> DataFrame:
    """(feature, value, attack, benign): rows of each class per distinct value."""
    return long_form(df, features, [flag]).groupBy("feature", "value").agg(
        F.count_if(F.col(flag)).alias("attack"), F.count_if(~F.col(flag)).alias("benign"))


def value_ranks(df: DataFrame, features: Sequence[str], flag: str = "is_attack") -> DataFrame:
    """Value counts with the totals of their feature and, in value order, running counts inside a cell of its values."""
    cuts = cell_cuts(long_form(df, features, [flag]), ["feature"], "value", {
        "n_attack": F.count_if(F.col(flag)), "n_benign": F.count_if(~F.col(flag))})
    return running_in_cells(value_counts(df, features, flag), cuts, ["feature"], "value", ["attack", "benign"])


def category_counts(df: DataFrame, columns: Sequence[str], flag: str = "is_attack") -> DataFrame:
    """(column, value, attack, benign) of the columns as text, NULL as 'missing': the contingency tables."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(quoted(c).cast("string"), F.lit("missing")).alias("value"))
        for c in columns])
    return df.select(quoted(flag).alias("_flag"), F.inline(pairs)).groupBy("column", "value").agg(
        F.count_if(F.col("_flag")).alias("attack"), F.count_if(~F.col("_flag")).alias("benign"))


# --- numeric features --------------------------------------------------------

def quick_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of the readable values."""
    return per_feature(df, features, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}, nulls=True)


def numeric_profile(
    df: DataFrame, features: Sequence[str], counts: DataFrame | None = None, approximate: bool = False,
    flag: str = "is_attack",
) -> DataFrame:
    """Moments, range, distinct count and ratio, share of zeros and signed variation of each feature.

    ``approximate`` replaces the exact distinct count, the one part that shuffles
    distinct values, by a sketch.
    """
    stats: dict[str, Stat] = {
        "rows": lambda c: F.count(c), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "zero_ratio": lambda c: F.avg((c == 0).cast("int")),
    }
    if approximate:
        stats["unique_count"] = F.approx_count_distinct
    profile = per_feature(df, features, stats)
    if not approximate:
        counts = value_counts(df, features, flag) if counts is None else counts
        profile = profile.join(counts.groupBy("feature").agg(F.count("*").alias("unique_count")), "feature")
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(F.try_divide("std", "mean"))
    return profile.withColumns({"unique_ratio": F.col("unique_count") / F.col("rows"), "cv": cv})


def class_moments(df: DataFrame, features: Sequence[str], flag: str = "is_attack") -> DataFrame:
    """n, mean and sample variance of attack and benign rows, one row per feature."""
    by_class = per_feature(df, features, {"n": F.count, "mean": F.avg, "var": F.var_samp}, [flag])
    sides = (("attack", F.col(flag)), ("benign", ~F.col(flag)))
    return by_class.groupBy("feature").agg(
        *[F.coalesce(F.max(F.when(side, F.col("n"))), F.lit(0)).alias(f"n_{cls}") for cls, side in sides],
        *[F.max(F.when(side, F.col(s))).alias(f"{cls}_{s}") for cls, side in sides for s in ("mean", "var")])


def effect_sizes(moments: DataFrame) -> DataFrame:
    """Cohen's d with pooled variance (0 when that is 0) and the ratio of means (infinite over a zero mean)."""
    pooled = F.sqrt(
        F.try_divide((F.col("n_attack") - 1) * F.col("attack_var") + (F.col("n_benign") - 1) * F.col("benign_var"),
                     F.col("n_attack") + F.col("n_benign") - 2))
    gap = F.abs(F.col("attack_mean") - F.col("benign_mean"))
    return moments.withColumns({
        "cohens_d": F.when(pooled > 0, gap / pooled).otherwise(F.lit(0.0)),
        "mean_ratio": F.when(F.col("benign_mean") == 0, F.lit(float("inf"))).otherwise(
            F.try_divide("attack_mean", "benign_mean")),
    })


def ks_test(ranks: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per feature.

    The gap of the two distributions at a value is the gap before its cell plus what the cell adds, so a cell's largest
    and smallest addition are all that is needed of it.
    """
    added = F.try_divide("in_attack", "n_attack") - F.try_divide("in_benign", "n_benign")
    cells = ranks.groupBy("feature", "n_attack", "n_benign", "_cell").agg(
        F.sum("attack").alias("attack"), F.sum("benign").alias("benign"), F.max(added).alias("_most"), F.min(added).alias("_least"))
    before = F.try_divide("before_attack", "n_attack") - F.try_divide("before_benign", "n_benign")
    gap = F.greatest(F.abs(before + F.col("_most")), F.abs(before + F.col("_least")))
    return (
        before_cells(cells, ["feature"], ["attack", "benign"]).groupBy("feature", "n_attack", "n_benign")
        .agg(F.max(gap).alias("ks_statistic"))
        .withColumn("ks_pvalue", kolmogorov_tail(F.col("ks_statistic"), F.col("n_attack"), F.col("n_benign")))
    )


def numeric_importance(profile: DataFrame, effects: DataFrame, ks: DataFrame, min_rows: int = 0) -> DataFrame:
    """Discriminative flag and composite score; tests count only with more than ``min_rows`` rows per class.

    The default asks for a row of each class, without which there is nothing to test; 10 is a usual choice.
    """
    tested = (F.col("n_attack") > min_rows) & (F.col("n_benign") > min_rows)
    joined = profile.join(effects, "feature").join(ks.select("feature", "ks_statistic", "ks_pvalue"), "feature")
    joined = joined.withColumns({
        c: F.when(tested, F.col(c)) for c in
        ("ks_statistic", "ks_pvalue", "cohens_d", "attack_mean", "benign_mean", "mean_ratio")})
    return joined.withColumns({
        "is_discriminative": F.coalesce((F.col("ks_pvalue") < 0.05) & (F.col("cohens_d") > 0.2), F.lit(False)),
        "importance_score": importance(F.col("cv"), F.col("unique_ratio"), F.col("ks_pvalue"), F.col("cohens_d")),
    })


def corrected_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis (0 for constant columns, NULL for too few rows)."""
    base = per_feature(df, features, {
        "n": F.count, "variance": F.var_samp, "g1": F.skewness, "g2": F.kurtosis}, nulls=True)
    n = F.col("n").cast("double")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    flat = F.col("variance") == 0
    return base.select(
        "feature", "n",
        F.when(n > 2, F.when(flat, 0.0).otherwise(skew)).alias("skewness"),
        F.when(n > 3, F.when(flat, 0.0).otherwise(kurt)).alias("kurtosis"))


def variance_ranking(df: DataFrame, features: Sequence[str], top: int = 10) -> DataFrame:
    return per_feature(df, features, {"variance": F.var_samp}, nulls=True).orderBy(F.desc("variance"), "feature").limit(top)


def variance_by_label(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, label, variance): the long form of the feature-by-label table."""
    return per_feature(df, features, {"variance": F.var_samp}, [label], nulls=True).filter("variance IS NOT NULL")


def pivot_labels(by_label: DataFrame, labels: Sequence[str], label: str = "label") -> DataFrame:
    return by_label.groupBy("feature").pivot(label, list(labels)).agg(F.first("variance"))


def marker_sizes(by_label: DataFrame, value: str = "variance") -> DataFrame:
    """120 + 780 * ln(1 + v/min) / ln(1 + max/min), 120 where v <= 0; min is at least 1e-12."""
    edge = by_label.agg(F.greatest(F.min(value), F.lit(EPSILON)).alias("lo"), F.max(value).alias("hi"))
    scaled = F.log(1 + F.col(value) / F.col("_e.lo")) / F.log(1 + F.col("_e.hi") / F.col("_e.lo")) * 780 + 120
    return by_label.withColumn("_e", edge.select(F.struct("lo", "hi")).scalar()).withColumn(
        "marker_size", F.when(F.col(value) > 0, scaled).otherwise(F.lit(120.0))).drop("_e")


def class_differences(moments: DataFrame) -> DataFrame:
    """Attack minus benign mean, the same scaled by the largest difference, variation per class, and separation."""
    gap = F.col("attack_mean") - F.col("benign_mean")
    largest = F.greatest(F.max(F.abs("mean_difference")).over(Window.partitionBy()), F.lit(EPSILON))
    pooled = F.sqrt((F.col("attack_var") + F.col("benign_var")) / 2) + EPSILON
    both = moments.filter((F.col("n_attack") > 0) & (F.col("n_benign") > 0)).withColumn("mean_difference", gap)
    return both.select(
        "feature", "mean_difference", (F.col("mean_difference") / largest).alias("scaled_difference"),
        (F.sqrt("attack_var") / (F.abs("attack_mean") + EPSILON)).alias("cv_attack"),
        (F.sqrt("benign_var") / (F.abs("benign_mean") + EPSILON)).alias("cv_benign"),
        (F.abs("mean_difference") / pooled).alias("separation"))


def top_separation(differences: DataFrame, top: int = 10) -> DataFrame:
    return differences.select("feature", "separation").orderBy(F.desc("separation"), "feature").limit(top)


def box_statistics(df: DataFrame, features: Sequence[str], flag: str = "is_attack") -> DataFrame:
    """Exact quartiles, whiskers (the extreme values within 1.5 interquartile ranges) and rows beyond them, per feature and class.

    Two scans: a sketch brackets the quartiles, and with them the fences; then the values inside the brackets are
    counted one by one and those between them as a whole.
    """
    by, quartiles = ["feature", "class"], (0.25, 0.5, 0.75)
    class_name = F.when(F.col(flag), "attack").otherwise("benign")
    long = long_form(df, features, [flag]).select("feature", class_name.alias("class"), "value")
    brackets = quantile_brackets(long, by, "value", quartiles)
    low, high = [F.get("_low", F.lit(i)) for i in range(3)], [F.get("_high", F.lit(i)) for i in range(3)]
    # a fence is 2.5 of one quartile less 1.5 of the other
    fences = ((low[0] * 2.5 - high[2] * 1.5, high[0] * 2.5 - low[2] * 1.5), (low[2] * 2.5 - high[0] * 1.5, high[2] * 2.5 - low[0] * 1.5))
    brackets = brackets.select(
        *by, "n", F.concat("_low", F.array(*[f[0] for f in fences])).alias("_low"), F.concat("_high", F.array(*[f[1] for f in fences])).alias("_high"))
    cells = settle(strata(long, brackets, by, "value", 5), "strata")
    found = cells.groupBy(*by, "n").agg(*[a for q in quartiles for a in quantile_at(q)])
    found = found.select(*by, "n", *[interpolated(q).alias(c) for q, c in zip(quartiles, ("q1", "median", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # no stretch between brackets spans a fence, so its ends say on which side it lies
    inside = (F.col("least") >= F.col("q1") - reach) & (F.col("most") <= F.col("q3") + reach)
    return cells.join(F.broadcast(found), [*by, "n"]).groupBy(*by, "n", "q1", "median", "q3").agg(  # a row per feature and class
        F.min(F.when(inside, F.col("least"))).alias("whisker_low"), F.max(F.when(inside, F.col("most"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("rows"))).alias("outliers"))


def density_histogram(df: DataFrame, features: Sequence[str], bins: int = 30) -> DataFrame:
    """(feature, bin, n, density) for equal bins between minimum and maximum; the last bin is closed."""
    edges = per_feature(df, features, {"lo": F.min, "hi": F.max, "rows": F.count}, nulls=True)
    # A constant feature is given the unit range around its value.
    edges = edges.select(
        "feature", "rows",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    long = long_form(df, features, nulls=True).filter("value IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    placed = attach(long, edges, ["feature"]).groupBy("feature", bin_no.alias("bin"), "lo", "hi", "rows").agg(
        F.count("*").alias("n"))
    return placed.select(
        "feature", "bin", "n", (F.col("n") / (F.col("rows") * (F.col("hi") - F.col("lo")) / bins)).alias("density"))


# --- categorical features ----------------------------------------------------

def top_values(df: DataFrame, column: str, top: int = 3) -> DataFrame:
    return df.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def categorical_profile(counts: DataFrame) -> DataFrame:
    """Distinct count and ratio, most frequent value and its share, entropy (natural log) per column."""
    rows = F.col("attack") + F.col("benign")
    sized = counts.withColumn("n", rows)
    totals = sized.groupBy("column").agg(F.sum("n").alias("rows"))
    share = F.col("n") / F.col("rows")
    # Ties go to the smallest text: the order key is (count, then the text in reverse order).
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return (
        attach(sized, totals, ["column"]).groupBy("column", "rows")
        .agg(F.count("*").alias("unique_count"), best.alias("most_frequent"),
             F.max(share).alias("most_frequent_ratio"), F.abs(-F.sum(share * F.log(share))).alias("entropy"))
        .withColumn("unique_ratio", F.col("unique_count") / F.col("rows"))
    )


def chi_square(counts: DataFrame, max_categories: int | None = None) -> DataFrame:
    """Independence test of value and class with Cramér's V, a row for every column.

    Yates' correction applies with one degree of freedom. The statistics are NULL for a column of one value, for
    rows of one class only, and, if ``max_categories`` is given, for a column of that many categories or more.
    """
    totals = counts.groupBy("column").agg(
        F.count("*").alias("categories"), F.sum("attack").alias("n_attack"), F.sum("benign").alias("n_benign"))
    fits = (F.col("categories") > 1) & (F.col("n_attack") > 0) & (F.col("n_benign") > 0)
    if max_categories is not None:
        fits = fits & (F.col("categories") < max_categories)
    tested = totals.withColumn("fits", fits)
    joined = attach(counts, tested, ["column"])
    n = F.col("n_attack") + F.col("n_benign")
    dof = F.col("categories") - 1

    def cell(seen: str, total: str) -> Column:
        expected = (F.col("attack") + F.col("benign")) * F.col(total) / n
        gap = F.abs(F.col(seen) - expected)
        gap = F.when(dof == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return gap * gap / expected

    statistic = F.sum(cell("attack", "n_attack") + cell("benign", "n_benign"))
    return joined.groupBy("column", "categories", "n_attack", "n_benign", "fits").agg(
        F.when(F.col("fits"), statistic).alias("chi2_statistic")).select(
        "column", dof.cast("long").alias("dof"), "chi2_statistic", F.sqrt(F.col("chi2_statistic") / n).alias("cramers_v"))


def categorical_importance(profile: DataFrame, chi2: DataFrame) -> DataFrame:
    tested = profile.join(chi2, "column", "left").withColumn("chi2_pvalue", chi2_tail("chi2_statistic", "dof"))
    return tested.withColumns({
        "is_discriminative": F.coalesce((F.col("chi2_pvalue") < 0.05) & (F.col("cramers_v") > 0.1), F.lit(False)),
        "importance_score": importance(
            F.col("entropy"), F.col("unique_ratio"), F.col("chi2_pvalue"), F.col("cramers_v")),
    })


# --- rankings ----------------------------------------------------------------

def rank_features(scored: DataFrame, top: int | None = 25) -> DataFrame:
    """Features by score with rank numbers, the ``top`` first ones or all; the window has one row per feature."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("importance_score"), "feature"))
    ranked = scored.withColumn("rank", rank)
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def suggest_features(ranked: DataFrame, min_score: float = 0.1, target: int = 30) -> DataFrame:
    return ranked.filter(F.col("importance_score") > min_score).orderBy("rank").limit(target).select(
        "rank", "feature", "is_discriminative")


def analysis_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("features"), F.count_if("is_discriminative").alias("discriminative"),
        F.coalesce(F.max("importance_score"), F.lit(0.0)).alias("top_score"))


# --- correlation -------------------------------------------------------------

def correlations(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson matrix on the driver, for the eigenvalues of the component study; the rows are reduced on the executors."""
    vectors = df.select(array_to_vector(F.array(*[number(df, f) for f in features])).alias("v"))
    return Correlation.corr(vectors, "v").first()[0].toArray()


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, feature1, feature2, r) for i <= j, from blocks of columns; nothing but the means reaches the driver."""
    found = {r["feature"]: r["mean"] for r in per_feature(df, features, {"mean": F.avg}).collect()}
    return pair_correlations(df, features, [found.get(f, 0.0) for f in features])


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, feature1, feature2, r) for all pairs, those below the diagonal mirrored."""
    upper = correlation_pairs(df, features)
    below = upper.filter("i < j").select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "r")
    return upper.unionByName(below)


def high_correlations(matrix: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs i < j with |r| above the threshold, strongest first."""
    return matrix.filter((F.col("i") < F.col("j")) & (F.abs("r") > threshold)).select(
        "feature1", "feature2", F.abs("r").alias("correlation")).orderBy(F.desc("correlation"), "feature1", "feature2")


def lower_triangle(matrix: DataFrame, ranked: DataFrame, top: int = 20) -> DataFrame:
    """Correlations below the diagonal among the first ``top`` features of a ranking (columns feature, rank)."""
    chosen = ranked.filter(F.col("rank") <= top)
    a = F.broadcast(chosen.select(F.col("feature").alias("feature1"), F.col("rank").alias("rank1")))
    b = F.broadcast(chosen.select(F.col("feature").alias("feature2"), F.col("rank").alias("rank2")))
    return matrix.join(a, "feature1").join(b, "feature2").filter("rank1 > rank2").select(
        "feature1", "feature2", "r")


def pair_values(df: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """The two features side by side, rows where both can be read."""
    return df.select(quoted(key), readable(df, first).alias("x"), readable(df, second).alias("y")).dropna(
        subset=["x", "y"])
