"""Whole analyses put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.config import BENIGN, IP_COLUMNS, LABEL_COLUMN, TIMESTAMP_COLUMN, StudyConfig
from flowquarry.functions.addresses import octets, seed_key
from flowquarry.operators import components, evaluation, profiling
from flowquarry.operators.columns import STUDY_EXCLUDED, column_profile, feature_array, model_columns, numeric_columns, present
from flowquarry.operators.preparation import encode_labels, label_dimension
from flowquarry.operators.privacy import anonymize, with_octets
from flowquarry.operators.sampling import balance, head_rows, oversample, sample_labels
from flowquarry.operators.training import cross_validate, last_stage
from flowquarry.operators.windows import count_windows, flatten_windows
from flowquarry.session import settle


@dataclass(frozen=True)
class FlowColumns:
    """Names of the special columns of a flow table."""

    key: str = "row_key"
    source: str = "source"
    label: str = LABEL_COLUMN
    ts: str = TIMESTAMP_COLUMN
    ips: tuple[str, ...] = IP_COLUMNS


def model_features(df: DataFrame, config: StudyConfig, names: FlowColumns) -> list[str]:
    """Features of the model: with ``feature_mode`` "octets" each address stands for its four octets."""
    out: list[str] = []
    for f in present(df, config.features):
        if f in names.ips and config.feature_mode == "octets":
            out += [f"{f}_Octet_{i}" for i in range(1, 5)]
        else:
            out.append(f)
    return out


def prepare(flows: DataFrame, config: StudyConfig, names: FlowColumns | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed and windowed rows (id, x, label_id) of a balanced sample, or of all labelled rows without a sample size, with the label dimension."""
    names = names or FlowColumns()
    if config.sample_size is None:
        sample = flows.filter(F.col(f"`{names.label}`").isNotNull())
    else:
        sample = settle(balance(
            flows, config.sample_size, config.benign_ratio, config.seed, names.key, names.label, names.source), "sample")
    sample = settle(oversample(sample, max(2, config.k_folds), config.seed, names.key, names.label), "sample")
    ips = present(sample, names.ips)
    features = model_features(sample, config, names)
    if config.anonymize:
        sample = anonymize(sample, ips, seed_key(config.seed))
    sample = with_octets(sample, ips, octets)
    dimension = settle(label_dimension(sample, names.label), "labels")
    rows = encode_labels(sample, dimension, names.label)
    if not config.use_windows:
        row_id = F.concat_ws("-", F.col(f"`{names.key}`").cast("string"), F.col("copy").cast("string"))
        keyed = rows.withColumn("id", row_id)
        return feature_array(keyed, features, ["id", "label_id"]), dimension
    windows = count_windows(
        rows, [names.ts, names.key, "copy"], features, "label_id", config.window_size, config.window_step)
    flat = flatten_windows(windows).select(
        F.col("window_id").alias("id"), F.col("flat").alias("x"), F.col("label").alias("label_id"))
    return flat, dimension


def train_and_evaluate(
    flows: DataFrame, model_type: str, config: StudyConfig, names: FlowColumns | None = None, max_iter: int = 20,
    fit_rows: int | None = None,
) -> DataFrame:
    """One report row, measured on out-of-fold predictions of all prepared rows; ``fit_rows`` bounds what a model is fitted on."""
    rows, dimension = prepare(flows, config, names)
    pred = last_stage(cross_validate(
        settle(rows, "rows"), model_type, config.k_folds, config.seed, max_iter=max_iter, fit_rows=fit_rows))
    return evaluation.report(settle(pred, "out-of-fold"), dimension, BENIGN)


def feature_study(
    df: DataFrame, columns: Sequence[str], flag: str = "is_attack", top: int = 25
) -> dict[str, DataFrame]:
    """Scores, ranking, suggestion and summary of the columns against the attack flag.

    Columns with more than 70 % readable numbers are numeric, the others categorical. Ids, times, addresses and labels
    (``STUDY_EXCLUDED``) are no features.
    """
    columns = [c for c in columns if c not in STUDY_EXCLUDED]
    profile = column_profile(df, columns)
    numeric = {r["column"] for r in numeric_columns(profile, 0.7).select("column").collect()}
    numbers = [c for c in columns if c in numeric]
    categories = [c for c in columns if c not in numeric]
    scored: DataFrame | None = None
    if numbers:
        ranks = settle(profiling.value_ranks(df, numbers, flag), "ranks")
        scored = profiling.numeric_importance(
            profiling.numeric_profile(df, numbers, ranks),
            profiling.effect_sizes(profiling.class_moments(df, numbers, flag)),
            profiling.ks_test(ranks),
        ).select("feature", F.lit("numeric").alias("type"), "unique_count", "cv", F.lit(None).cast("double").alias(
            "entropy"), F.col("ks_pvalue").alias("p_value"), F.col("cohens_d").alias("effect"),
            "is_discriminative", "importance_score")
    if categories:
        counts = settle(profiling.category_counts(df, categories, flag), "categories")
        by_text = profiling.categorical_importance(
            profiling.categorical_profile(counts), profiling.chi_square(counts)
        ).select(F.col("column").alias("feature"), F.lit("categorical").alias("type"), "unique_count",
                 F.lit(None).cast("double").alias("cv"), "entropy", F.col("chi2_pvalue").alias("p_value"),
                 F.col("cramers_v").alias("effect"), "is_discriminative", "importance_score")
        scored = by_text if scored is None else scored.unionByName(by_text)
    if scored is None:
        raise ValueError("no columns to study")
    scored = settle(scored, "scores")
    ranked = profiling.rank_features(scored, None)
    return {"scores": scored, "ranking": ranked.filter(F.col("rank") <= top), "suggestion": profiling.suggest_features(ranked),
            "summary": profiling.analysis_summary(scored)}


def head_sample(flows: DataFrame, max_rows: int, sources: int, order: Sequence[str], source: str = "source") -> DataFrame:
    """The first max_rows // 4 rows of attack and benign rows of the first ``sources`` sources."""
    first = flows.select(source).distinct().orderBy(source).limit(sources)
    chosen = flows.join(F.broadcast(first), source, "left_semi")
    return head_rows(chosen, max_rows // 4, [source, "is_attack"], order)


def component_study(
    flows: DataFrame,
    columns: Sequence[str],
    cap: int | None = None,
    seed: int = 79,
    key: str = "row_key",
    label: str = "label",
    source: str = "source",
    target: float = 0.95,
    threshold: float = 0.95,
    max_components: int = 10,
    per_component: int = 10,
    min_loading: float = 0.05,
) -> dict[str, DataFrame]:
    """Components, correlations, distinctive features and their class tables of all rows.

    With ``cap``, of at most so many rows of each label, taken evenly from the sources.
    """
    spark = flows.sparkSession
    sample = flows if cap is None else settle(sample_labels(flows, cap, seed, key, label, source), "component-sample")
    kept = model_columns(sample, columns)
    fit = components.fit_components(sample, kept)
    matrix = settle(profiling.correlation_matrix(sample, kept), "correlations")
    pairs = profiling.high_correlations(matrix, threshold)
    report = components.component_report(spark, fit, target)
    scores = components.distinctive_scores(report, max_components, per_component, min_loading)
    ranked = settle(components.rank_distinctive(components.prune_correlated(scores, pairs)), "distinctive")
    chosen = [r["feature"] for r in ranked.orderBy("rank").select("feature").collect()]
    marked = report.join(F.broadcast(ranked.select("feature", F.lit(True).alias("_d"))), "feature", "left").withColumn(
        "is_distinctive", F.coalesce("_d", F.lit(False))).drop("_d")
    labelled = sample.withColumn("is_attack", F.col(label) != BENIGN)
    return {
        "configurations": components.variance_targets(spark, fit),
        "components": marked,
        "distinctive": ranked,
        "correlations": pairs.withColumn("correlation_abs", F.abs("correlation")),
        "distinctive_correlations": profiling.lower_triangle(matrix, ranked),
        "per_component": components.distinctive_per_component(report, ranked),
        "coordinates": components.project(sample, fit, [key, label]),
        "variance_by_label": profiling.variance_by_label(sample, chosen, label),
        "class_differences": profiling.class_differences(profiling.class_moments(labelled, chosen)),
    }
