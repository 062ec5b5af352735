"""Principal components of the embeddings and the features they single out."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.operators import components, profiling
from flowquarry.operators.columns import model_columns
from flowquarry.plans import studies
from flowquarry.plans.adapters import EMBEDDING_SIZE, embedding_columns, vectors
from flowquarry.plans.registry import VECTORS, query, rounded, with_sql
from flowquarry.session import scratch_path
from flowquarry.sources import reports

THRESHOLD = 0.09
CORR = """pairs AS (SELECT a.pos AS i, b.pos AS j, corr(a.v, b.v) AS r FROM coords a JOIN coords b ON a.id = b.id AND a.pos < b.pos GROUP BY a.pos, b.pos)"""


def _fit(spark, sf_dir):
    df, names = embedding_columns(spark, sf_dir)
    return df, components.fit_components(df, names)


@query("component_input", f"""
WITH {VECTORS}
SELECT 'e' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature FROM coords GROUP BY pos HAVING var_samp(v) > 0""")
def component_input(spark, sf_dir):
    df, names = embedding_columns(spark, sf_dir)
    wide = df.withColumns({"constant": F.lit(1.0), "text": F.lit("x")})
    kept = model_columns(wide, [*names, "constant", "text"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("pca_variance_targets")
def pca_variance_targets(spark, sf_dir):
    _, fit = _fit(spark, sf_dir)
    return rounded(components.variance_targets(spark, fit), 9, "explained_variance")


@query("pca_components")
def pca_components(spark, sf_dir):
    _, fit = _fit(spark, sf_dir)
    return rounded(components.component_report(spark, fit), 6, "pca_score", "abs_pca_score", "explained_variance", "cumulative_variance")


@query("pca_scores")
def pca_scores(spark, sf_dir):
    df, fit = _fit(spark, sf_dir)
    return rounded(components.project(df, fit, ["id", "label_id"]), 6, "pc1", "pc2", "pc3")


@query("pca_invariants", f"""
SELECT CAST(c AS INTEGER) AS component, 0.0::DOUBLE AS score_mean, 1.0::DOUBLE AS variance_share, 1.0::DOUBLE AS loading_length,
  (SELECT count(*) FROM embeddings) AS rows FROM range(1, 4) r(c)""")
def pca_invariants(spark, sf_dir):
    """What holds for components however they are found: scores have mean 0 and the component's share of the variance, loadings length 1."""
    df, fit = _fit(spark, sf_dir)
    scores = components.project(df, fit, ["id"]).unpivot(["id"], ["pc1", "pc2", "pc3"], "name", "score")
    measured = scores.groupBy(F.substring("name", 3, 1).cast("int").alias("component")).agg(
        F.avg("score").alias("score_mean"), F.var_pop("score").alias("variance"), F.count("*").alias("rows"))
    report = components.component_report(spark, fit, 0.999999, top=len(fit.features)).groupBy("component", "explained_variance").agg(
        F.sqrt(F.sum(F.col("pca_score") * F.col("pca_score"))).alias("loading_length"))
    share = F.col("variance") / (F.col("explained_variance") * len(fit.features))
    checked = measured.join(report, "component").withColumn("variance_share", share).withColumn("score_mean", F.abs(F.round("score_mean", 6)))
    return rounded(checked, 6, "variance_share", "loading_length").select("component", "score_mean", "variance_share", "loading_length", "rows")


@query("embedding_correlations", with_sql([VECTORS, CORR], f"""
SELECT 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature1, 'e' || lpad(CAST(j AS VARCHAR), 2, '0') AS feature2,
  round(abs(r), 8) AS correlation FROM pairs WHERE abs(r) > {THRESHOLD}"""))
def embedding_correlations(spark, sf_dir):
    df, names = embedding_columns(spark, sf_dir)
    return rounded(profiling.high_correlations(profiling.correlation_matrix(df, names), THRESHOLD), 8, "correlation")


@query("correlation_triangle", with_sql([VECTORS, CORR], """
SELECT 'e' || lpad(CAST(j AS VARCHAR), 2, '0') AS feature1, 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature2,
  round(r, 8) AS r FROM pairs WHERE j < 20"""))
def correlation_triangle(spark, sf_dir):
    df, names = embedding_columns(spark, sf_dir)
    order = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank int")
    return rounded(profiling.lower_triangle(profiling.correlation_matrix(df, names), order), 8, "r")


def _distinctive(spark, sf_dir, threshold=THRESHOLD):
    df, fit = _fit(spark, sf_dir)
    report = components.component_report(spark, fit)
    pairs = profiling.high_correlations(profiling.correlation_matrix(df, list(fit.features)), threshold)
    kept = components.prune_correlated(components.distinctive_scores(report), pairs)
    return report, components.rank_distinctive(kept)


@query("correlation_pruning", with_sql([VECTORS, CORR], f"""
, scores AS (SELECT pos, round(stddev_samp(v), 9) AS score FROM coords GROUP BY pos),
weaker AS (SELECT CASE WHEN a.score < b.score THEN a.pos ELSE b.pos END AS pos FROM pairs JOIN scores a ON a.pos = i JOIN scores b ON b.pos = j
           WHERE abs(r) > {THRESHOLD}),
kept AS (SELECT * FROM scores WHERE pos NOT IN (SELECT pos FROM weaker))
SELECT 'e' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, round(score, 6) AS pca_importance_score,
  CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank FROM kept""".lstrip("\n")))
def correlation_pruning(spark, sf_dir):
    """Of every highly correlated pair the coordinate that varies less goes; what is left is ranked."""
    df, names = embedding_columns(spark, sf_dir)
    spread = profiling.per_feature(df, names, {"pca_importance_score": lambda c: F.round(F.stddev_samp(c), 9)})
    pairs = profiling.high_correlations(profiling.correlation_matrix(df, names), THRESHOLD)
    return rounded(components.rank_distinctive(components.prune_correlated(spread, pairs)), 6, "pca_importance_score")


@query("distinctive_features")
def distinctive_features(spark, sf_dir):
    return rounded(_distinctive(spark, sf_dir)[1], 6, "pca_importance_score")


@query("distinctive_per_component")
def distinctive_per_component(spark, sf_dir):
    return components.distinctive_per_component(*_distinctive(spark, sf_dir))


def _component_study(spark, sf_dir):
    df, names = embedding_columns(spark, sf_dir)
    labelled = df.select("*", F.col("label_id").cast("string").alias("label"), F.lit("all").alias("source"))
    return studies.component_study(labelled, names, key="id", threshold=THRESHOLD)


@query("component_study")
def component_study(spark, sf_dir):
    return rounded(_component_study(spark, sf_dir)["distinctive"], 6, "pca_importance_score")


@query("component_study_correlations", with_sql([VECTORS, CORR], f"""
SELECT 'e' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature1, 'e' || lpad(CAST(j AS VARCHAR), 2, '0') AS feature2,
  round(abs(r), 8) AS correlation, round(abs(r), 8) AS correlation_abs FROM pairs WHERE abs(r) > {THRESHOLD}"""))
def component_study_correlations(spark, sf_dir):
    return rounded(_component_study(spark, sf_dir)["correlations"], 8, "correlation", "correlation_abs")


@query("component_study_tables", """
SELECT unnest(['class_differences', 'components', 'configurations', 'coordinates', 'correlations', 'distinctive', 'distinctive_correlations',
  'per_component', 'variance_by_label']) AS "table", true AS fits""")
def component_study_tables(spark, sf_dir):
    """Every table of a study written as CSV, read back, and held against what the others say of its rows."""
    study, root = _component_study(spark, sf_dir), scratch_path(spark, "component-study")
    reports.write_tables(study, root)
    rows = {name: spark.read.option("header", True).csv(f"{root}/{name}") for name in study}
    n = {name: rows[name].count() for name in rows}
    chosen, labels = n["distinctive"], rows["coordinates"].select("label").distinct().count()
    fits = {
        "configurations": n["configurations"] == len(components.VARIANCE_TARGETS),
        "components": n["components"] % 10 == 0 and n["components"] > 0,
        "distinctive": 0 < chosen <= EMBEDDING_SIZE,
        "correlations": n["correlations"] <= EMBEDDING_SIZE * (EMBEDDING_SIZE - 1) // 2,
        "distinctive_correlations": n["distinctive_correlations"] == min(chosen, 20) * (min(chosen, 20) - 1) // 2,
        "per_component": n["per_component"] == 5,
        "coordinates": n["coordinates"] == vectors(spark, sf_dir).count(),
        "variance_by_label": n["variance_by_label"] == chosen * labels,
        "class_differences": n["class_differences"] in (0, chosen),  # 0 where no label is benign
    }
    return spark.createDataFrame(sorted(fits.items()), "table string, fits boolean")


assert EMBEDDING_SIZE == 64  # the two-digit column names of the SQL rest on it
