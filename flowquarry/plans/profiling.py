"""Feature profiles, class tests, rankings and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import profiling
from flowquarry.plans.adapters import LINE_FEATURES, flows, lines, table
from flowquarry.plans.registry import FLOWS, LINE_FEATURE_NAMES, LINE_LONG, LINES, query, rounded, with_sql
from flowquarry.plans.studies import feature_study

BASE = [LINES, LINE_LONG]
INF = "CAST('inf' AS DOUBLE)"
MOMENTS = """moments AS (
  SELECT feature, count(*) FILTER (is_attack) AS n_attack, count(*) FILTER (NOT is_attack) AS n_benign,
         avg(value) FILTER (is_attack) AS attack_mean, avg(value) FILTER (NOT is_attack) AS benign_mean,
         var_samp(value) FILTER (is_attack) AS attack_var, var_samp(value) FILTER (NOT is_attack) AS benign_var
  FROM line_long GROUP BY feature)"""
KS = """counted AS (SELECT feature, value, count(*) FILTER (is_attack) AS attack, count(*) FILTER (NOT is_attack) AS benign
  FROM line_long GROUP BY feature, value),
cumulated AS (SELECT feature,
    sum(attack) OVER (PARTITION BY feature ORDER BY value) / sum(attack) OVER (PARTITION BY feature)
  - sum(benign) OVER (PARTITION BY feature ORDER BY value) / sum(benign) OVER (PARTITION BY feature) AS gap FROM counted),
ks AS (SELECT feature, max(abs(gap)) AS d FROM cumulated GROUP BY feature),
scaled AS (SELECT feature, d, d * sqrt(n_attack::DOUBLE * n_benign / (n_attack + n_benign)) AS l FROM ks JOIN moments USING (feature)),
tested AS (SELECT feature, d, CASE WHEN l < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
    lambda i: (CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * i * i * l * l))), 0.0), 1.0) END AS p FROM scaled)"""
PROFILE = f"""profile AS (SELECT feature, count(*) AS n_rows, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  max(value) AS max, count(DISTINCT value) AS unique_count, count(*) FILTER (value = 0) / count(*) AS zero_ratio,
  CASE WHEN avg(value) = 0 THEN {INF} ELSE stddev_samp(value) / avg(value) END AS cv FROM line_long GROUP BY feature)"""
D = """CASE WHEN ((n_attack - 1) * attack_var + (n_benign - 1) * benign_var) / (n_attack + n_benign - 2) > 0
  THEN abs(attack_mean - benign_mean) / sqrt(((n_attack - 1) * attack_var + (n_benign - 1) * benign_var) / (n_attack + n_benign - 2))
  ELSE 0 END"""


@query("numeric_profile", with_sql([*BASE, PROFILE], """
SELECT feature, n_rows AS "rows", round(mean, 4) AS mean, round(std, 4) AS std, min, max, round(zero_ratio, 9) AS zero_ratio,
       unique_count, round(unique_count / n_rows, 9) AS unique_ratio, round(cv, 8) AS cv FROM profile"""))
def numeric_profile(spark, sf_dir):
    profile = profiling.numeric_profile(lines(spark, sf_dir), LINE_FEATURES)
    return rounded(rounded(rounded(profile, 4, "mean", "std"), 9, "zero_ratio", "unique_ratio"), 8, "cv")


@query("quick_stats", with_sql(BASE, """
SELECT feature, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max
FROM line_long GROUP BY feature"""))
def quick_stats(spark, sf_dir):
    return rounded(profiling.quick_stats(lines(spark, sf_dir), LINE_FEATURES), 4, "mean", "std")


@query("value_counts_top3", """
SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY l_suppkey
ORDER BY n DESC, l_suppkey::VARCHAR LIMIT 3""")
def value_counts_top3(spark, sf_dir):
    keyed = lines(spark, sf_dir).select(F.col("l_suppkey").cast("string").alias("l_suppkey"))
    return profiling.top_values(keyed, "l_suppkey")


CATEGORIES = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}
ORDER_FLAGS = """flagged AS (SELECT *, o_totalprice > 250000 AS is_attack FROM orders),
texts AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, is_attack FROM flagged
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, is_attack FROM flagged
  UNION ALL SELECT 'o_clerk', CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing' ELSE 'c' || (o_custkey // 100) END, is_attack FROM flagged),
contingency AS (SELECT "column", value, count(*) FILTER (is_attack) AS attack, count(*) FILTER (NOT is_attack) AS benign
  FROM texts GROUP BY ALL),
totals AS (SELECT "column", count(*) AS categories, sum(attack) AS a, sum(benign) AS b, sum(attack) + sum(benign) AS n
  FROM contingency GROUP BY ALL),
cells AS (SELECT "column", categories, n, attack AS o, (attack + benign) * a / n AS e FROM contingency JOIN totals USING ("column")
  UNION ALL SELECT "column", categories, n, benign, (attack + benign) * b / n FROM contingency JOIN totals USING ("column")),
chi AS (SELECT "column", CAST(any_value(categories) - 1 AS BIGINT) AS dof, any_value(n) AS n,
  sum(power(CASE WHEN categories = 2 THEN abs(o - e) - least(abs(o - e), 0.5) ELSE abs(o - e) END, 2) / e) AS chi2
  FROM cells WHERE categories >= 2 GROUP BY "column")"""


def _categories(spark, sf_dir, columns=("o_orderstatus", "o_orderpriority", "o_clerk")):
    clerk = F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("c"), F.expr("o_custkey div 100").cast("string")))
    df = table(spark, sf_dir, "orders").withColumns({"o_clerk": clerk, "is_attack": F.col("o_totalprice") > 250000})
    return profiling.category_counts(df, columns)


@query("contingency", with_sql([ORDER_FLAGS], 'SELECT * FROM contingency'))
def contingency(spark, sf_dir):
    return _categories(spark, sf_dir)


@query("categorical_profile", with_sql([ORDER_FLAGS], """
, sized AS (SELECT "column", value, attack + benign AS n, sum(attack + benign) OVER (PARTITION BY "column") AS total FROM contingency)
SELECT "column", CAST(any_value(total) AS BIGINT) AS "rows", count(*) AS unique_count,
       first(value ORDER BY n DESC, value) AS most_frequent, round(max(n / total), 9) AS most_frequent_ratio,
       round(abs(-sum(n / total * ln(n / total))), 9) AS entropy, round(count(*) / any_value(total), 9) AS unique_ratio
FROM sized GROUP BY "column" """))
def categorical_profile(spark, sf_dir):
    profile = profiling.categorical_profile(_categories(spark, sf_dir))
    return rounded(profile, 9, "most_frequent_ratio", "entropy", "unique_ratio")


@query("chi2_cramers_v", with_sql([ORDER_FLAGS], """
SELECT "column", dof, round(chi2, 6) AS chi2_statistic, round(sqrt(chi2 / n), 8) AS cramers_v FROM chi"""))
def chi2_cramers_v(spark, sf_dir):
    return rounded(rounded(profiling.chi_square(_categories(spark, sf_dir)), 6, "chi2_statistic"), 8, "cramers_v")


@query("chi2_yates", """
WITH cells AS (SELECT quality, toxic, count(*) AS o FROM labels GROUP BY ALL),
grid AS (SELECT q.quality, t.toxic, COALESCE(o, 0) AS o FROM (SELECT DISTINCT quality FROM labels) q
  CROSS JOIN (SELECT DISTINCT toxic FROM labels) t LEFT JOIN cells ON cells.quality = q.quality AND cells.toxic = t.toxic),
expected AS (SELECT o, sum(o) OVER (PARTITION BY quality) * sum(o) OVER (PARTITION BY toxic) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM grid)
SELECT 'quality' AS "column", CAST(1 AS BIGINT) AS dof,
       round(sum(power(abs(o - e) - least(abs(o - e), 0.5), 2) / e), 8) AS chi2_statistic,
       round(sqrt(sum(power(abs(o - e) - least(abs(o - e), 0.5), 2) / e) / any_value(n)), 8) AS cramers_v FROM expected""")
def chi2_yates(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").withColumn("is_attack", F.col("toxic") == 1)
    counts = profiling.category_counts(marked, ["quality"])
    return rounded(profiling.chi_square(counts), 8, "chi2_statistic", "cramers_v")


# With an even number of degrees of freedom the chi-square tail is a finite sum.
@query("categorical_importance", with_sql([ORDER_FLAGS], """
, tails AS (SELECT "column", chi2, n, exp(-chi2 / 2) * list_sum(list_transform(range(dof // 2),
    lambda i: power(chi2 / 2, i) / gamma(i + 1))) AS p FROM chi WHERE "column" <> 'o_clerk'),
spreads AS (SELECT "column", count(*) AS c, -sum((attack + benign) / n * ln((attack + benign) / n)) AS h
  FROM contingency JOIN totals USING ("column") GROUP BY "column")
SELECT "column", round(h, 6) AS entropy, round(p, 6) AS chi2_pvalue, p < 0.05 AND sqrt(chi2 / n) > 0.1 AS is_discriminative,
  round((least(h, 3) + least(2 * c / n, 2) + 4 * (1 - p) * sqrt(chi2 / n)) / 7, 6) AS importance_score
FROM tails JOIN spreads USING ("column")"""))
def categorical_importance(spark, sf_dir):
    counts = _categories(spark, sf_dir, ("o_orderstatus", "o_orderpriority"))
    scored = profiling.categorical_importance(profiling.categorical_profile(counts), profiling.chi_square(counts))
    return rounded(scored, 6, "entropy", "chi2_pvalue", "importance_score").select(
        "column", "entropy", "chi2_pvalue", "is_discriminative", "importance_score")


@query("ks_two_sample", with_sql([*BASE, MOMENTS, KS], """
SELECT feature, round(d, 9) AS ks_statistic, round(p, 6) AS ks_pvalue FROM tested"""))
def ks_two_sample(spark, sf_dir):
    ks = profiling.ks_test(profiling.value_ranks(lines(spark, sf_dir), LINE_FEATURES))
    return rounded(rounded(ks, 9, "ks_statistic"), 6, "ks_pvalue").select("feature", "ks_statistic", "ks_pvalue")


@query("cohens_d", with_sql([*BASE, MOMENTS], f"""
SELECT feature, n_attack, n_benign, round({D}, 8) AS cohens_d FROM moments"""))
def cohens_d(spark, sf_dir):
    effects = profiling.effect_sizes(profiling.class_moments(lines(spark, sf_dir), LINE_FEATURES))
    return rounded(effects.select("feature", "n_attack", "n_benign", "cohens_d"), 8, "cohens_d")


@query("mean_ratio", with_sql([*BASE, MOMENTS], f"""
SELECT feature, round(attack_mean, 4) AS attack_mean, round(benign_mean, 4) AS benign_mean,
       round(CASE WHEN benign_mean = 0 THEN {INF} ELSE attack_mean / benign_mean END, 8) AS mean_ratio FROM moments"""))
def mean_ratio(spark, sf_dir):
    effects = profiling.effect_sizes(profiling.class_moments(lines(spark, sf_dir), LINE_FEATURES))
    return rounded(rounded(effects.select("feature", "attack_mean", "benign_mean", "mean_ratio"),
                           4, "attack_mean", "benign_mean"), 8, "mean_ratio")


@query("numeric_importance", with_sql([*BASE, MOMENTS, KS, PROFILE], f"""
SELECT feature, p < 0.05 AND {D} > 0.2 AS is_discriminative,
  round((least(cv, 3) + least(2 * unique_count / n_rows, 2) + 4 * (1 - p) * {D}) / 7, 6) AS importance_score
FROM profile JOIN tested USING (feature) JOIN moments USING (feature)"""))
def numeric_importance(spark, sf_dir):
    df = lines(spark, sf_dir)
    ranks = profiling.value_ranks(df, LINE_FEATURES)
    scored = profiling.numeric_importance(
        profiling.numeric_profile(df, LINE_FEATURES, ranks),
        profiling.effect_sizes(profiling.class_moments(df, LINE_FEATURES)), profiling.ks_test(ranks))
    return rounded(scored.select("feature", "is_discriminative", "importance_score"), 6, "importance_score")


@query("boxplot_stats", with_sql(BASE, """
, classed AS (SELECT feature, CASE WHEN is_attack THEN 'attack' ELSE 'benign' END AS class, value FROM line_long),
quart AS (SELECT feature, class, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM classed GROUP BY feature, class)
SELECT feature, class, n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM classed JOIN quart USING (feature, class) GROUP BY feature, class, n"""))
def boxplot_stats(spark, sf_dir):
    boxes = profiling.box_statistics(lines(spark, sf_dir), LINE_FEATURES)
    return rounded(boxes, 6, "q1", "median", "q3")


@query("histogram_30", with_sql([FLOWS], """
, edges AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM flows)
SELECT 'value' AS feature, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n,
  round(count(*) / (any_value(edges.n) * (any_value(hi) - any_value(lo)) / 30), 9) AS density
FROM flows, edges GROUP BY 2"""))
def histogram_30(spark, sf_dir):
    return rounded(profiling.density_histogram(flows(spark, sf_dir), ["value"]), 9, "density")


@query("moments_corrected", with_sql(BASE, """
SELECT feature, count(*) AS n, round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis
FROM line_long GROUP BY feature"""))
def moments_corrected(spark, sf_dir):
    return rounded(profiling.corrected_moments(lines(spark, sf_dir), LINE_FEATURES), 5, "skewness", "kurtosis")


@query("variance_ranking", with_sql(BASE, """
SELECT feature, round(sqrt(var_samp(value)), 4) AS deviation FROM line_long GROUP BY feature ORDER BY deviation DESC LIMIT 3"""))
def variance_ranking(spark, sf_dir):
    top = profiling.variance_ranking(lines(spark, sf_dir), LINE_FEATURES, 3)
    return rounded(top.select("feature", F.sqrt("variance").alias("deviation")), 4, "deviation")


@query("variance_by_label", with_sql(BASE, """
SELECT feature, label, round(sqrt(var_samp(value)), 4) AS deviation FROM line_long GROUP BY feature, label"""))
def variance_by_label(spark, sf_dir):
    v = profiling.variance_by_label(lines(spark, sf_dir), LINE_FEATURES)
    return rounded(v.select("feature", "label", F.sqrt("variance").alias("deviation")), 4, "deviation")


@query("variance_pivot", with_sql(BASE, """
SELECT feature, round(sqrt(var_samp(value) FILTER (label = 'BENIGN')), 4) AS "BENIGN",
  round(sqrt(var_samp(value) FILTER (label = 'A')), 4) AS "A", round(sqrt(var_samp(value) FILTER (label = 'R')), 4) AS "R"
FROM line_long GROUP BY feature"""))
def variance_pivot(spark, sf_dir):
    v = profiling.variance_by_label(lines(spark, sf_dir), LINE_FEATURES).withColumn("variance", F.sqrt("variance"))
    return rounded(profiling.pivot_labels(v, ["BENIGN", "A", "R"]), 4, "BENIGN", "A", "R")


@query("marker_sizes", with_sql(BASE, """
, v AS (SELECT feature, label, var_samp(value) AS variance FROM line_long GROUP BY feature, label),
e AS (SELECT greatest(min(variance), 1e-12) AS lo, max(variance) AS hi FROM v)
SELECT feature, label, round(CASE WHEN variance > 0 THEN 120 + 780 * ln(1 + variance / lo) / ln(1 + hi / lo) ELSE 120 END, 6) AS marker_size
FROM v, e"""))
def marker_sizes(spark, sf_dir):
    sized = profiling.marker_sizes(profiling.variance_by_label(lines(spark, sf_dir), LINE_FEATURES))
    return rounded(sized.select("feature", "label", "marker_size"), 6, "marker_size")


DIFFERENCES = """differences AS (SELECT feature, attack_mean - benign_mean AS gap,
  sqrt(attack_var) / (abs(attack_mean) + 1e-12) AS cv_attack, sqrt(benign_var) / (abs(benign_mean) + 1e-12) AS cv_benign,
  abs(attack_mean - benign_mean) / (sqrt((attack_var + benign_var) / 2) + 1e-12) AS separation FROM moments)"""


def _differences(spark, sf_dir):
    return profiling.class_differences(profiling.class_moments(lines(spark, sf_dir), LINE_FEATURES))


@query("mean_difference", with_sql([*BASE, MOMENTS, DIFFERENCES], """
SELECT feature, round(gap, 4) AS mean_difference, round(gap / (SELECT greatest(max(abs(gap)), 1e-12) FROM differences), 8) AS scaled_difference
FROM differences"""))
def mean_difference(spark, sf_dir):
    d = _differences(spark, sf_dir).select("feature", "mean_difference", "scaled_difference")
    return rounded(rounded(d, 4, "mean_difference"), 8, "scaled_difference")


@query("cv_by_class", with_sql([*BASE, MOMENTS, DIFFERENCES], """
SELECT feature, round(cv_attack, 8) AS cv_attack, round(cv_benign, 8) AS cv_benign FROM differences"""))
def cv_by_class(spark, sf_dir):
    return rounded(_differences(spark, sf_dir).select("feature", "cv_attack", "cv_benign"), 8, "cv_attack", "cv_benign")


@query("discriminative_score", with_sql([*BASE, MOMENTS, DIFFERENCES], """
SELECT feature, round(separation, 8) AS separation FROM differences ORDER BY separation DESC LIMIT 5"""))
def discriminative_score(spark, sf_dir):
    return rounded(profiling.top_separation(_differences(spark, sf_dir), 5), 8, "separation")


PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r FROM lineitem"
    for i, a in enumerate(LINE_FEATURE_NAMES) for j, b in enumerate(LINE_FEATURE_NAMES))


@query("correlation_matrix", f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, feature1, feature2, round(r, 8) AS r FROM ({PAIRS})")
def correlation_matrix(spark, sf_dir):
    return rounded(profiling.correlation_matrix(lines(spark, sf_dir), LINE_FEATURES), 8, "r")


@query("high_corr_pairs", f"SELECT feature1, feature2, round(abs(r), 8) AS correlation FROM ({PAIRS}) WHERE i < j AND abs(r) > 0.002")
def high_corr_pairs(spark, sf_dir):
    matrix = profiling.correlation_matrix(lines(spark, sf_dir), LINE_FEATURES)
    return rounded(profiling.high_correlations(matrix, 0.002), 8, "correlation")


@query("numeric_pairs", with_sql([FLOWS], """
SELECT row_key, value AS x, k AS y FROM flows WHERE value IS NOT NULL AND k IS NOT NULL"""))
def numeric_pairs(spark, sf_dir):
    return profiling.pair_values(flows(spark, sf_dir), "value", "k", "row_key")


# The tail with one degree of freedom is the complementary error function, here by its series.
STUDY = [*BASE, MOMENTS, KS, PROFILE, f"""scores AS (
  SELECT feature, 'numeric' AS type, p < 0.05 AND {D} > 0.2 AS is_discriminative,
    (least(cv, 3) + least(2 * unique_count / n_rows, 2) + 4 * (1 - p) * {D}) / 7 AS score
  FROM profile JOIN tested USING (feature) JOIN moments USING (feature)
  UNION ALL SELECT 'l_linestatus', 'categorical', p < 0.05 AND v > 0.1, (least(h, 3) + least(2 * c / n, 2) + 4 * (1 - p) * v) / 7
  FROM (SELECT *, sqrt(x / n) AS v, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60),
      lambda i: power(-1.0::DOUBLE, i) * power(sqrt(x / 2), 2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))) AS p
    FROM (SELECT any_value(n) AS n, any_value(c) AS c, sum(power(abs(a - ea) - least(abs(a - ea), 0.5), 2) / ea
        + power(abs(b - eb) - least(abs(b - eb), 0.5), 2) / eb) AS x, -sum((a + b) / n * ln((a + b) / n)) AS h
      FROM (SELECT a, b, sum(a + b) OVER () AS n, count(*) OVER () AS c, (a + b) * sum(a) OVER () / sum(a + b) OVER () AS ea,
          (a + b) * sum(b) OVER () / sum(a + b) OVER () AS eb
        FROM (SELECT count(*) FILTER (is_attack) AS a, count(*) FILTER (NOT is_attack) AS b FROM lines GROUP BY l_linestatus))))),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS "rank" FROM scores)"""]


def _study(spark, sf_dir):
    return feature_study(lines(spark, sf_dir), [*LINE_FEATURES, "l_linestatus"])


@query("feature_ranking", with_sql(STUDY, """
SELECT "rank", feature, type, is_discriminative, round(score, 6) AS importance_score FROM ranked WHERE "rank" <= 25"""))
def feature_ranking(spark, sf_dir):
    return rounded(_study(spark, sf_dir)["ranking"], 6, "importance_score").select(
        "rank", "feature", "type", "is_discriminative", "importance_score")


@query("suggested_features", with_sql(STUDY, """
SELECT "rank", feature, is_discriminative FROM ranked WHERE score > 0.1 ORDER BY "rank" LIMIT 30"""))
def suggested_features(spark, sf_dir):
    return _study(spark, sf_dir)["suggestion"]


@query("analysis_summary", with_sql(STUDY, """
SELECT count(*) AS features, count(*) FILTER (is_discriminative) AS discriminative, round(max(score), 6) AS top_score FROM scores"""))
def analysis_summary(spark, sf_dir):
    return rounded(_study(spark, sf_dir)["summary"], 6, "top_score")


@query("study_columns", with_sql([FLOWS], """
SELECT unnest(['k', 'value']) AS feature, CAST(count(*) AS BIGINT) AS rows FROM flows"""))
def study_columns(spark, sf_dir):
    """Which columns a study looks at: ids, times, addresses and labels are none of them."""
    df = flows(spark, sf_dir).select(
        F.col("row_key").alias("Flow ID"), F.col("ts").alias("Timestamp"), F.col("src_ip").alias("Src IP"), F.col("dst_ip").alias("Dst IP"),
        "value", "k", F.col("label").alias("Label"), "is_attack")
    scores = feature_study(df, [c for c in df.columns if c != "is_attack"])["scores"]
    return scores.select("feature", df.agg(F.count("*")).scalar().alias("rows"))
