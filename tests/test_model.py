from collections import Counter

import numpy as np
import pytest

from flowquarry.operators import model, training


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(i % 3 * 3, 1, 2)] + [1.0], None if i == 7 else ["dos", "BENIGN", "rare"][i % 3]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x array<double>, label string")


@pytest.mark.parametrize("model_type,settings", [("logistic", None), ("forest", {"num_trees": 3}), ("dense", {"hidden": (6,)})])
def test_a_loaded_pipeline_scores_as_before(spark, data, tmp_path, model_type, settings):
    fitted = model.fit_pipeline(data, model_type, max_iter=15, overrides=settings)
    model.save_pipeline(fitted, str(tmp_path / "m"))
    again = model.load_pipeline(str(tmp_path / "m"))
    unlabelled = data.drop("label")
    rows = lambda m: [tuple(r) for r in model.score_pipeline(m, unlabelled, ["id"]).orderBy("id").collect()]
    assert rows(again) == rows(fitted) and len(rows(again)) == 240
    truth = {r["id"]: r["label"] for r in data.collect() if r["label"]}
    right = sum(truth.get(r[0]) == r[3] for r in rows(again))
    assert right > 0.8 * len(truth)


def test_copies_stand_for_weights(spark):
    rows = spark.range(3_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 1 WHEN id % 100 = 1 THEN 2 ELSE 0 END AS label_id").repartition(5)
    n = Counter({r["label_id"]: r["count"] for r in rows.groupBy("label_id").count().collect()})
    drawn = training.with_copies(rows, 79, "id")
    copies = Counter(r["label_id"] for r in drawn.collect())
    for c in n:  # every class has about a third of all rows
        assert copies[c] == pytest.approx(1_000, rel=0.06)
    again = training.with_copies(rows.repartition(2), 79, "id")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, drawn.collect()))
    per_row = Counter(r["id"] for r in drawn.filter("label_id = 2").collect())
    weight = 3_000 / 3 / n[2]
    assert set(per_row.values()) <= {int(weight), int(weight) + 1} and len(per_row) == n[2]


def test_a_resumed_candidate_equals_one_run_by_stages(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(i % 3 * 3, 1, 2)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label_id int")
    train = training.training_rows(training.to_vector(df, "x").drop("x"), "dense", 1, "id").coalesce(1).cache()
    settings = {"hidden": (5,)}
    one, two = (training.Candidate("dense", settings) for _ in range(2))
    for n in (2, 6):
        one.train_to(train, 2, 3, 1, n)
    estimator = training.build_estimator("dense", 2, 3, 1, 2, settings)
    first = estimator.fit(train)
    longer = training.build_estimator("dense", 2, 3, 1, 4, settings).setInitialWeights(first.weights).fit(train)
    assert one.iterations == 6 and one.model.weights.toArray() == pytest.approx(longer.weights.toArray())
    two.train_to(train, 2, 3, 1, 2)
    assert two.model.weights.toArray() == pytest.approx(first.weights.toArray())


def test_models_are_measured_on_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(i % 2 * 3, 1, 2)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label_id int")
    pred = training.cross_validate(df, "logistic", k=2, max_iter=10, fit_rows=40)
    assert Counter(r["id"] for r in pred.collect()) == {i: 1 for i in range(400)}
    assert training.mean_accuracy(pred) > 0.9
