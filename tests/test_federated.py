import math

import numpy as np
import pytest

from flowquarry.operators import federated

SCHEMA = "round int, client int, pos int, w0 double, w1 double"


def updates(spark):
    return spark.createDataFrame([(1, 0, 0, 1.0, 4.0), (1, 0, 1, 1.0, 5.0), (1, 1, 0, 1.0, 1.0), (1, 1, 1, 1.0, 1.0)], SCHEMA)


def test_clip_shortens_long_updates_only(spark):
    rows = {(r["client"], r["pos"]): r for r in federated.clip_updates(updates(spark), 2.5).collect()}
    assert rows[(0, 0)]["norm"] == 5 and rows[(0, 0)]["w"] == pytest.approx(2.5) and rows[(0, 1)]["w"] == pytest.approx(3.0)
    assert rows[(1, 0)]["factor"] == 1 and rows[(1, 0)]["w"] == 1


def test_noise_is_reproducible_and_has_the_stated_spread(spark):
    wide = spark.createDataFrame([(1, 0, i, 0.0, 0.0) for i in range(4000)], SCHEMA)
    first = federated.noise_updates(federated.clip_updates(wide, 2.0), 0.8, 2.0, 79)
    again = federated.noise_updates(federated.clip_updates(wide.repartition(7), 2.0), 0.8, 2.0, 79)
    a, b = ({r["pos"]: r["w"] for r in d.collect()} for d in (first, again))
    assert a == b
    z = np.array(list(a.values())) / (0.8 * 2.0 / math.sqrt(4000))
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.04


def test_average(spark):
    got = {r["pos"]: r["w1"] for r in federated.federated_average(updates(spark), "w1").collect()}
    assert got == {0: 2.5, 1: 3.0}


def test_epsilon_uses_the_row_floor_and_is_null_without_noise(spark):
    df = spark.createDataFrame([("D", 10, 5, 2, 12, 0.8), ("B", 10, 5, 2, 12, None), ("E", 10, 5, 2, 64, 0.8)],
                               "scenario string, rounds int, num_clients int, local_epochs int, batch_size int, noise_multiplier double")
    got = {r["scenario"]: r["epsilon"] for r in federated.indicative_epsilon(df).collect()}
    assert got["D"] == pytest.approx(100 * (12 / 10000) / 0.64) and got["B"] is None
    assert got["E"] == pytest.approx(100 * (64 / 32000) / 0.64)


def scenario_tables(spark):
    results = spark.createDataFrame(
        [("A", 0.9, 0.5, 10.0, None, False, False), ("B", 0.0, 0.6, 20.0, None, False, False),
         ("D", None, 0.85, 0.0, None, True, True)],
        "scenario string, validation_accuracy double, final_accuracy double, total_time double, epsilon double, use_dp boolean, use_he boolean")
    overheads = spark.createDataFrame(
        [("A", 1, 2.0, False, None, None), ("D", 1, 1.0, True, 10.0, "estimate"), ("D", 2, 3.0, True, 20.0, "encrypt")],
        "scenario string, round int, duration_s double, he_available boolean, mb double, mode string")
    for c in ("enc_s", "agg_s", "dec_s"):
        overheads = overheads.selectExpr("*", f"CAST(NULL AS DOUBLE) AS {c}")
    return results, overheads


def test_scenario_summary(spark):
    rows = {r["scenario"]: r for r in federated.scenario_summary(*scenario_tables(spark)).collect()}
    assert rows["B"]["accuracy"] == 0.6 and rows["B"]["acc_vs_baseline"] == pytest.approx(-0.3)
    assert rows["A"]["round_time_std_s"] == 0 and rows["D"]["round_time_std_s"] == pytest.approx(math.sqrt(2))
    assert (rows["D"]["he_mb_per_round"], rows["D"]["he_mb_total"], rows["D"]["he_mode"]) == (15, 30, "encrypt")
    assert rows["D"]["he_mb_per_sec"] is None and rows["B"]["round_time_mean_s"] is None


def test_scenario_checks(spark):
    rules = spark.createDataFrame(list(federated.SCENARIO_RULES), federated.RULE_SCHEMA)
    summary = federated.scenario_summary(*scenario_tables(spark))
    got = {r["scenario"]: (r["passed"], r["violations"]) for r in federated.check_scenarios(summary, rules).collect()}
    assert got["A"] == (True, []) and got["B"] == (True, []) and got["C"] == (False, ["scenario missing"])
    assert got["D"] == (False, ["use_he", "accuracy above maximum", "epsilon missing"])
