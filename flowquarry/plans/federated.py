"""Client updates, rounds and scenario comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowquarry.operators import federated
from flowquarry.plans.adapters import client_updates, scenario_tables
from flowquarry.plans.registry import FLOWS, UPDATES, hash_order, query, rounded, with_sql

CLIP, SIGMA, SEED = 0.1, 0.8, 79
U = [UPDATES]
CLIPPED = f"""norms AS (SELECT round, client, sqrt(sum((w1 - w0) * (w1 - w0))) AS norm, count(*) AS dim FROM updates GROUP BY ALL),
clipped AS (SELECT u.*, norm, dim, CASE WHEN norm > 0 THEN least(1.0, {CLIP} / (norm + 1e-12)) ELSE 1.0 END AS factor,
  w0 + (w1 - w0) * CASE WHEN norm > 0 THEN least(1.0, {CLIP} / (norm + 1e-12)) ELSE 1.0 END AS w
  FROM updates u JOIN norms USING (round, client))"""
DIGEST = hash_order(SEED, "round", "client", "pos")
NOISED = f"""draws AS (SELECT *, (CAST('0x' || substr({DIGEST}, 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE AS u1,
  CAST('0x' || substr({DIGEST}, 14, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u2 FROM clipped),
noised AS (SELECT round, client, pos, w + sqrt(-2 * ln(u1)) * cos({2 * math.pi!r}::DOUBLE * u2) * {SIGMA * CLIP!r}::DOUBLE / greatest(1.0, sqrt(dim)) AS w FROM draws)"""


@query("fedavg", with_sql(U, "SELECT round, pos, round(avg(w1), 9) AS w FROM updates GROUP BY round, pos"))
def fedavg(spark, sf_dir):
    weights = client_updates(spark, sf_dir).withColumnRenamed("w1", "w")
    return rounded(federated.federated_average(weights), 9, "w")


@query("clip_update", with_sql([*U, CLIPPED], """
SELECT client, pos, dim, round(norm, 9) AS norm, round(factor, 9) AS factor, round(w, 9) AS w FROM clipped"""))
def clip_update(spark, sf_dir):
    clipped = federated.clip_updates(client_updates(spark, sf_dir), CLIP)
    return rounded(clipped, 9, "norm", "factor", "w").select("client", "pos", "dim", "norm", "factor", "w")


@query("noisy_update", with_sql([*U, CLIPPED, NOISED], "SELECT client, pos, round(w, 8) AS w FROM noised"))
def noisy_update(spark, sf_dir):
    clipped = federated.clip_updates(client_updates(spark, sf_dir), CLIP)
    noised = federated.noise_updates(clipped, SIGMA, CLIP, SEED)
    return rounded(noised.select("client", "pos", "w"), 8, "w")


@query("noisy_average", with_sql([*U, CLIPPED, NOISED], "SELECT round, pos, round(avg(w), 8) AS w FROM noised GROUP BY round, pos"))
def noisy_average(spark, sf_dir):
    clipped = federated.clip_updates(client_updates(spark, sf_dir), CLIP)
    return rounded(federated.federated_average(federated.noise_updates(clipped, SIGMA, CLIP, SEED)), 8, "w")


@query("ciphertext_count", with_sql(U, """
SELECT client, count(*) AS length, CAST(ceil(count(*) / 16) AS BIGINT) AS ciphertexts FROM updates GROUP BY client"""))
def ciphertext_count(spark, sf_dir):
    lengths = client_updates(spark, sf_dir).groupBy("client").agg(F.count("*").alias("length"))
    return lengths.withColumn("ciphertexts", federated.ciphertext_count(F.col("length"), 32))


SCENARIOS = """base AS (SELECT *, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C'
  WHEN 'signup' THEN 'D' ELSE 'E' END AS scenario FROM flows),
days AS (SELECT scenario, source, round(avg(value), 6) AS d, round(avg(k), 6) AS mk, count(*) AS n FROM base GROUP BY scenario, source),
results AS (SELECT scenario, 'success' AS status, round(avg((k < 60)::INT), 6) AS final_accuracy, round(avg((k < 80)::INT), 6) AS va,
  round(avg(value) * 10, 6) AS total_time, round(avg(value) * 8, 6) AS training_time, count(DISTINCT source) AS rounds, count(DISTINCT user_id) AS num_clients FROM base GROUP BY scenario),
scored AS (SELECT *, scenario IN ('D', 'E') AS use_dp, scenario IN ('C', 'E') AS use_he,
  CASE WHEN scenario = 'A' AND va <> 0 THEN va ELSE final_accuracy END AS accuracy FROM results),
epsilons AS (SELECT scenario, CASE WHEN use_dp THEN rounds * num_clients * 2 * (64 / greatest(10000, 64 * num_clients * 100)) / greatest(0.8::DOUBLE * 0.8::DOUBLE, 1e-6) END AS epsilon FROM scored),
per_round AS (SELECT scenario, avg(d) AS round_mean, stddev_samp(d) AS round_std,
  CASE WHEN scenario IN ('C', 'E') THEN avg(mk / 3) END AS mb_round, CASE WHEN scenario IN ('C', 'E') THEN sum(mk / 3) END AS mb_total,
  CASE WHEN scenario NOT IN ('C', 'E') THEN NULL WHEN scenario = 'E' AND bool_or(n % 2 = 0) THEN 'encrypt' ELSE 'estimate' END AS he_mode,
  CASE WHEN scenario IN ('C', 'E') THEN avg(d / 10) END AS enc, CASE WHEN scenario IN ('C', 'E') THEN avg(mk / 100) END AS agg
  FROM days GROUP BY scenario),
summary AS (SELECT * FROM scored JOIN per_round USING (scenario) JOIN epsilons USING (scenario))"""


def _summary(spark, sf_dir):
    results, overheads = scenario_tables(spark, sf_dir)
    return federated.scenario_summary(federated.indicative_epsilon(results), overheads)


@query("epsilon_indicative", with_sql([FLOWS, SCENARIOS], "SELECT scenario, round(epsilon, 8) AS epsilon FROM epsilons"))
def epsilon_indicative(spark, sf_dir):
    results, _ = scenario_tables(spark, sf_dir)
    return rounded(federated.indicative_epsilon(results).select("scenario", "epsilon"), 8, "epsilon")


@query("scenario_summary", with_sql([FLOWS, SCENARIOS], """
SELECT scenario, status, use_dp, use_he, rounds, num_clients, accuracy, total_time, round(epsilon, 8) AS epsilon, training_time,
  CASE WHEN use_dp THEN 1e-5::DOUBLE END AS delta, CAST(NULL AS VARCHAR) AS error,
  round(accuracy - (SELECT accuracy FROM scored WHERE scenario = 'A'), 6) AS acc_vs_baseline,
  round(round_mean, 5) AS round_time_mean_s, round(round_std, 5) AS round_time_std_s, round(mb_round, 5) AS he_mb_per_round,
  round(mb_total, 5) AS he_mb_total, round(mb_total / total_time, 5) AS he_mb_per_sec, he_mode,
  round(enc, 5) AS enc_mean_s, round(agg, 5) AS agg_mean_s, CAST(NULL AS DOUBLE) AS dec_mean_s FROM summary"""))
def scenario_summary(spark, sf_dir):
    s = rounded(_summary(spark, sf_dir), 5, "round_time_mean_s", "round_time_std_s", "he_mb_per_round", "he_mb_total",
                "he_mb_per_sec", "enc_mean_s", "agg_mean_s", "dec_mean_s")
    s = rounded(rounded(s, 8, "epsilon"), 6, "acc_vs_baseline")
    return s.select(
        "scenario", "status", "use_dp", "use_he", "rounds", "num_clients", "accuracy", "total_time", "epsilon", "training_time", "delta", "error",
        "acc_vs_baseline", "round_time_mean_s", "round_time_std_s", "he_mb_per_round", "he_mb_total", "he_mb_per_sec",
        "he_mode", "enc_mean_s", "agg_mean_s", "dec_mean_s")


@query("scenario_checks", with_sql([FLOWS, SCENARIOS], """
, rules(scenario, dp, he, lo, hi, mb, eps) AS (VALUES ('A', FALSE, FALSE, 0.70, NULL, NULL, FALSE), ('B', FALSE, FALSE, 0.45, NULL, NULL, FALSE),
  ('C', FALSE, TRUE, 0.45, NULL, 20.0, FALSE), ('D', TRUE, FALSE, NULL, 0.80, NULL, TRUE), ('E', TRUE, TRUE, NULL, NULL, 20.0, TRUE)),
broken AS (SELECT scenario, concat_ws('; ', CASE WHEN s.scenario IS NULL THEN 'scenario missing' END, CASE WHEN use_dp <> dp THEN 'use_dp' END,
  CASE WHEN use_he <> he THEN 'use_he' END, CASE WHEN accuracy < lo THEN 'accuracy below minimum' END,
  CASE WHEN accuracy > hi THEN 'accuracy above maximum' END, CASE WHEN mb_round > mb THEN 'transfer volume above maximum' END,
  CASE WHEN eps AND s.scenario IS NOT NULL AND epsilon IS NULL THEN 'epsilon missing' END) AS violations
  FROM rules LEFT JOIN summary s USING (scenario))
SELECT scenario, violations = '' AS passed, violations FROM broken"""))
def scenario_checks(spark, sf_dir):
    rules = spark.createDataFrame(list(federated.SCENARIO_RULES), federated.RULE_SCHEMA)
    checked = federated.check_scenarios(_summary(spark, sf_dir), rules)
    return checked.withColumn("violations", F.concat_ws("; ", "violations"))


# From zero weights the softmax is uniform, so the first step has a closed form.
