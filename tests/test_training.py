from collections import Counter

import numpy as np
import pytest

from flowquarry.config import StudyConfig
from flowquarry.operators import training
from flowquarry.plans.studies import FlowColumns, component_study, prepare, train_and_evaluate


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(i % 3 * 3, 1, 2)], i % 3) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x array<double>, label_id int")


@pytest.mark.parametrize("model_type", ["logistic", "forest"])
def test_every_row_is_predicted_once_out_of_fold(data, model_type):
    pred = training.cross_validate(data, model_type, k=3, max_iter=10, overrides={"num_trees": 3} if model_type == "forest" else None)
    assert Counter(r["id"] for r in pred.collect()) == {i: 1 for i in range(240)}
    assert training.mean_accuracy(pred) > 0.85


def test_network_stages(data):
    pred = training.cross_validate(data, "dense", k=2, max_iter=12, stages=2, overrides={"hidden": (6,)})
    losses = training.stage_losses(pred).collect()
    assert {(r["y_true"], r["stage"]) for r in losses} == {(c, s) for c in range(3) for s in (1, 2)}
    assert training.last_stage(pred).count() == 240


def test_final_model_is_saved_with_its_scaler(data, tmp_path, spark):
    model, scaler = training.fit_final(data, "mlp_4_layer", max_iter=3, overrides={"hidden": (8, 6, 5, 4)})
    training.save_model(model, scaler, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "scaler")).count() == 2
    assert training.score(model, scaler, data, ["id"]).count() == 240


def test_successive_halving_drops_candidates(data):
    candidates = [("logistic", {"reg_param": r}) for r in (0.0, 0.1, 1.0, 50.0)]
    log = training.successive_halving(data, candidates, min_iter=2, max_iter=18)
    rows = log.collect()
    assert Counter(r["rung"] for r in rows) == {0: 4, 1: 1}
    assert training.best_candidate(log) != 3


def flows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"d{i % 3}", f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", f"10.0.{i % 5}.{i % 250}",
             float(rng.normal(i % 4, 1)), "BENIGN" if i % 2 else ("rare" if i % 200 == 0 else "dos")) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_key long, source string, t string, src string, v double, label string")
    return df.selectExpr("* except (t)", "CAST(t AS TIMESTAMP_NTZ) AS ts")


NAMES = FlowColumns("row_key", "source", "label", "ts", ("src",))


def test_prepare_with_and_without_windows(spark):
    config = StudyConfig(sample_size=300, features=("src", "v"), anonymize=True)
    rows, dimension = prepare(flows(spark), config, NAMES)
    assert [r["label"] for r in dimension.orderBy("label_id").collect()] == ["BENIGN", "dos", "rare"]
    first = rows.first()
    assert len(first["x"]) == 10 * 5
    tabular, _ = prepare(flows(spark), config.with_changes(use_windows=False, anonymize=False), NAMES)
    assert len(tabular.first()["x"]) == 5
    assert tabular.select("id").distinct().count() == tabular.count()


def test_train_and_evaluate(spark):
    config = StudyConfig(sample_size=300, features=("src", "v"), use_windows=False, k_folds=3)
    row = train_and_evaluate(flows(spark), "logistic", config, NAMES, max_iter=5).first()
    assert len(row["class_names"]) == 3 and sum(map(sum, row["confusion"])) >= 300


def test_component_study(spark):
    df = flows(spark).selectExpr("*", "v * 2 + 1 AS w", "CAST(row_key % 11 AS DOUBLE) AS z", "1.0D AS flat")
    study = component_study(df, ["v", "w", "z", "flat"], cap=200)
    kept = {r["feature"] for r in study["distinctive"].collect()}
    assert "z" in kept and len(kept & {"v", "w"}) == 1 and "flat" not in kept
    assert study["class_differences"].count() == len(kept)
