"""Averaging, clipping and noising of client updates, and scenario comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.stats import standard_normal
from flowquarry.operators.positions import attach, order_hash


# --- one round, as tables (round, client, pos, w0, w1) -----------------------

def federated_average(weights: DataFrame, value: str = "w") -> DataFrame:
    """Unweighted mean over clients per round and position."""
    return weights.groupBy("round", "pos").agg(F.avg(value).alias(value))


def update_norms(updates: DataFrame) -> DataFrame:
    gap = F.col("w1") - F.col("w0")
    return updates.groupBy("round", "client").agg(
        F.sqrt(F.sum(gap * gap)).alias("norm"), F.count("*").alias("dim"))


def clip_updates(updates: DataFrame, clip: float) -> DataFrame:
    """Scales each client's update so that its length is at most ``clip``; adds norm, dim, factor and ``w``."""
    factor = F.when(F.col("norm") > 0, F.least(F.lit(1.0), F.lit(clip) / (F.col("norm") + 1e-12))).otherwise(1.0)
    joined = attach(updates, update_norms(updates), ["round", "client"])
    return joined.withColumn("factor", factor).withColumn(
        "w", F.col("w0") + (F.col("w1") - F.col("w0")) * F.col("factor"))


def noise_scale(sigma: float, clip: float, dim: Column, per_dimension: bool = True) -> Column:
    """Deviation per coordinate: sigma * clip, divided by sqrt(dim) unless ``per_dimension`` is off."""
    spread = sigma * max(1e-6, clip)
    return F.lit(spread) / F.greatest(F.lit(1.0), F.sqrt(dim.cast("double"))) if per_dimension else F.lit(spread)


def noise_updates(clipped: DataFrame, sigma: float, clip: float, seed: int, per_dimension: bool = True) -> DataFrame:
    """Adds Gaussian noise to ``w``, drawn from a hash of (seed, round, client, position)."""
    z = standard_normal(order_hash(seed, *[F.col(c).cast("string") for c in ("round", "client", "pos")]))
    return clipped.withColumn("w", F.col("w") + z * noise_scale(sigma, clip, F.col("dim"), per_dimension))


def indicative_epsilon(scenarios: DataFrame) -> DataFrame:
    """steps * (batch / rows) / sigma^2 with a floor on rows, NULL without noise.

    An indication, not a privacy accountant.
    """
    steps = F.col("rounds") * F.col("num_clients") * F.col("local_epochs")
    rows = F.greatest(F.lit(10000), F.col("batch_size") * F.col("num_clients") * 100)
    sigma = F.col("noise_multiplier")
    estimate = steps * (F.col("batch_size") / rows) / F.greatest(sigma * sigma, F.lit(1e-6))
    return scenarios.withColumn("epsilon", F.when(sigma.isNotNull(), estimate))


def ciphertext_count(length: Column, degree: int = 8192) -> Column:
    """Packed vectors hold degree / 2 values each."""
    return F.ceil(length / (degree // 2)).cast("long")


# --- scenario results --------------------------------------------------------

# What each scenario is expected to show.
SCENARIO_RULES = (
    ("A", False, False, 0.70, None, None, False),
    ("B", False, False, 0.45, None, None, False),
    ("C", False, True, 0.45, None, 20.0, False),
    ("D", True, False, None, 0.80, None, True),
    ("E", True, True, None, None, 20.0, True),
)
RULE_SCHEMA = (
    "scenario string, expect_use_dp boolean, expect_use_he boolean, min_accuracy double, max_accuracy double, "
    "max_he_mb_per_round double, expect_epsilon_not_null boolean")


def scenario_summary(results: DataFrame, overheads: DataFrame, baseline: str = "A") -> DataFrame:
    """One row per scenario: accuracy and gap to the baseline, times, privacy loss, error, transfer volume.

    ``results`` has one row per scenario; ``overheads`` one row per scenario and
    round (duration_s, he_available, mb, mode, enc_s, agg_s, dec_s). error,
    training_time and delta are NULL if the results have none.
    """
    optional = {"error": "string", "training_time": "double", "delta": "double"}
    results = results.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in results.columns})
    available = F.col("he_available")
    per_round = overheads.groupBy("scenario").agg(
        F.avg("duration_s").alias("round_time_mean_s"),
        F.when(F.count("duration_s") == 1, 0.0).otherwise(F.stddev_samp("duration_s")).alias("round_time_std_s"),
        F.avg(F.when(available, F.col("mb"))).alias("he_mb_per_round"),
        F.sum(F.when(available, F.col("mb"))).alias("he_mb_total"),
        F.coalesce(
            F.max(F.when(available & (F.col("mode") == "encrypt"), F.col("mode"))),
            F.min_by(F.when(available, F.col("mode")), F.when(available, F.col("round")))).alias("he_mode"),
        F.avg("enc_s").alias("enc_mean_s"), F.avg("agg_s").alias("agg_mean_s"), F.avg("dec_s").alias("dec_mean_s"))
    # A validation accuracy of 0 counts as missing, as an empty one does.
    scored = results.withColumn("accuracy", F.coalesce(F.nullif("validation_accuracy", F.lit(0.0)), "final_accuracy"))
    base = scored.filter(F.col("scenario") == baseline).agg(F.max("accuracy").alias("a"))
    total_time = F.nullif("total_time", F.lit(0.0))
    return (
        scored.join(per_round, "scenario", "left")
        .withColumn("acc_vs_baseline", F.col("accuracy") - base.scalar())
        .withColumn("he_mb_per_sec", F.col("he_mb_total") / total_time)
    )


def check_scenarios(summary: DataFrame, rules: DataFrame) -> DataFrame:
    """(scenario, passed, violations) for every rule row; a scenario without a result fails."""
    joined = rules.join(summary.withColumn("_found", F.lit(True)), "scenario", "left")
    broken = F.array(
        F.when(F.col("_found").isNull(), "scenario missing"),
        F.when(F.col("use_dp") != F.col("expect_use_dp"), "use_dp"),
        F.when(F.col("use_he") != F.col("expect_use_he"), "use_he"),
        F.when(F.col("accuracy") < F.col("min_accuracy"), "accuracy below minimum"),
        F.when(F.col("accuracy") > F.col("max_accuracy"), "accuracy above maximum"),
        F.when(F.col("he_mb_per_round") > F.col("max_he_mb_per_round"), "transfer volume above maximum"),
        F.when(F.col("_found") & F.col("expect_epsilon_not_null") & F.col("epsilon").isNull(), "epsilon missing"),
    )
    violations = F.filter(broken, lambda v: v.isNotNull())
    return joined.select("scenario", (F.size(violations) == 0).alias("passed"), violations.alias("violations"))
