"""Training, cross-validation and search with MLlib classifiers.

Input tables hold a row key, an array column ``x`` and the class id ``label_id``.
The driver loops over folds and candidates; every pass over rows is MLlib's.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.config import hyperparameters
from flowquarry.operators.evaluation import accuracy, class_cross_entropy, mean_over_folds, with_predicted_class
from flowquarry.operators.positions import order_hash
from flowquarry.operators.preparation import (
    assign_folds,
    fold_scalers,
    scale_array,
    split_train_validation,
    train_scaler,
)
from flowquarry.operators.sampling import class_weights, sample_uniform
from flowquarry.operators.windows import to_vector
from flowquarry.session import scratch_path, settle

NETWORKS = ("dense", "mlp_4_layer")


def build_estimator(model_type: str, features: int, classes: int, seed: int, max_iter: int, overrides: dict | None = None):
    """MLlib estimator for a model type; networks take no row weights, see ``with_copies``."""
    hp = hyperparameters(model_type, overrides)
    common = {"featuresCol": "features", "labelCol": "label_id", "probabilityCol": "probability"}
    if model_type in NETWORKS:
        return MultilayerPerceptronClassifier(
            layers=[features, *hp["hidden"], classes], seed=seed, maxIter=max_iter, stepSize=hp["learning_rate"],
            solver=hp.get("solver", "l-bfgs"), blockSize=hp["batch_size"], **common)
    if model_type == "logistic":
        return LogisticRegression(
            family="multinomial", weightCol="weight", maxIter=max_iter, regParam=hp["reg_param"],
            elasticNetParam=hp.get("elastic_net", 0.0), standardization=False, **common)
    return RandomForestClassifier(
        weightCol="weight", numTrees=hp["num_trees"], maxDepth=hp["max_depth"], seed=seed, **common)


def fitted(estimator, rows: DataFrame) -> Model:
    """Model of the rows, without its training summary: that of a two-class regression holds the session, which no task can get."""
    model = estimator.fit(rows)
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        path = scratch_path(rows.sparkSession, "model")
        model.write().save(path)
        return LogisticRegressionModel.load(path)
    return model


def with_class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight of the row's class, computed on the training rows only."""
    weights = class_weights(train, "label_id").select(F.col("label").alias("label_id"), "weight")
    return train.join(F.broadcast(weights), "label_id")  # one row per class


def with_copies(train: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows repeated by the weight of their class, for learners that take no weights: its whole part, and one more for the
    rows whose hash lies below its fraction. The rows are the same under any partitioning; no class loses or gains more than
    the spread of the hash.
    """
    share = F.conv(F.substring(order_hash(seed, key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    copies = F.floor("weight") + F.when(share < F.col("weight") - F.floor("weight"), 1).otherwise(0)
    drawn = with_class_weights(train).withColumn("copies", copies.cast("int")).filter("copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def training_rows(train: DataFrame, model_type: str, seed: int, key: str, weighted: bool = True) -> DataFrame:
    """Rows to fit on, classes balanced: by a weight column, for networks by copies of rows."""
    if not weighted:
        return train.withColumn("weight", F.lit(1.0))
    return with_copies(train, seed, key) if model_type in NETWORKS else with_class_weights(train)


def predict(model: Model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(rows).select(
        *keep, F.col("label_id").cast("int").alias("y_true"), vector_to_array("probability").alias("proba"))
    return with_predicted_class(scored)


def _shape(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.max(F.size("x")), F.max("label_id")).first()
    return int(row[0]), int(row[1]) + 1


def cross_validate(
    df: DataFrame,
    model_type: str,
    k: int = 5,
    seed: int = 79,
    key: str = "id",
    max_iter: int = 20,
    stages: int = 1,
    overrides: dict | None = None,
    parallelism: int = 2,
    fit_rows: int | None = None,
) -> DataFrame:
    """Out-of-fold predictions (key, fold, stage, y_true, proba, y_pred) of all rows.

    Scaling and class weights come from the training rows of each fold. With ``fit_rows`` a model is fitted on at most so
    many of them, evenly from the classes, in the order of a hash of the key; every held-out row is scored all the same. With
    ``stages`` > 1 a network is trained in that many equal steps, each starting
    from the weights of the one before, and scored after each.
    """
    features, classes = _shape(df)
    folded = df if "fold" in df.columns else assign_folds(df, k, seed, key, "label_id")
    folded = settle(folded.select(key, "x", "label_id", "fold"), "folds")
    scalers = settle(fold_scalers(folded, "x", k), "scalers")

    def one_fold(f: int) -> DataFrame:
        scaler = scalers.filter(F.col("fold") == f).drop("fold")
        scaled = lambda rows: to_vector(scale_array(rows, scaler, "x"), "scaled").drop("x", "scaled")
        train = folded.filter((F.col("fold") != f) & (F.col("fold") >= 0))
        if fit_rows is not None:
            train = sample_uniform(train, max(1, fit_rows // classes), seed, key, ["label_id"])
        train = training_rows(scaled(train), model_type, seed, key)
        held = scaled(folded.filter(F.col("fold") == f))
        steps = stages if model_type in NETWORKS else 1
        estimator = build_estimator(model_type, features, classes, seed, max(1, max_iter // steps), overrides)
        out, model = None, None
        for stage in range(1, steps + 1):
            if isinstance(model, MultilayerPerceptronClassificationModel):
                estimator.setInitialWeights(model.weights)
            model = fitted(estimator, train)
            scored = predict(model, held, [key, "fold"]).withColumn("stage", F.lit(stage))
            out = scored if out is None else out.unionByName(scored)
        return settle(out, "predictions")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(one_fold, range(k)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def last_stage(pred: DataFrame) -> DataFrame:
    last = pred.agg(F.max("stage")).first()[0]
    return pred.filter(F.col("stage") == last)


def fold_accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def mean_accuracy(pred: DataFrame) -> float:
    """Mean over folds of the fold accuracy."""
    return float(fold_accuracy(last_stage(pred)).agg(F.avg("accuracy")).first()[0])


def stage_losses(pred: DataFrame) -> DataFrame:
    """(y_true, stage, cross_entropy, folds): validation loss per class and stage, averaged over folds."""
    return mean_over_folds(class_cross_entropy(pred, ("fold", "stage")), ("y_true", "stage"))


def fit_final(
    df: DataFrame, model_type: str, seed: int = 79, max_iter: int = 20, overrides: dict | None = None, key: str = "id"
) -> tuple[Model, DataFrame]:
    """Model trained on all rows, and the scaler that belongs to it."""
    features, classes = _shape(df)
    scaler = settle(train_scaler(df, "x"), "scaler")
    rows = training_rows(to_vector(scale_array(df, scaler, "x"), "scaled").drop("x", "scaled"), model_type, seed, key)
    return fitted(build_estimator(model_type, features, classes, seed, max_iter, overrides), rows), scaler


def score(model: Model, scaler: DataFrame, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return predict(model, to_vector(scale_array(df, scaler, "x"), "scaled").drop("x", "scaled"), keep)


def save_model(model: Model, scaler: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")


@dataclass
class Candidate:
    """A model type with settings, and what a search has fitted of it so far."""

    model_type: str
    settings: dict
    iterations: int = 0
    model: Model | None = None

    def train_to(self, train: DataFrame, features: int, classes: int, seed: int, iterations: int) -> None:
        """Brings the model to ``iterations`` in all. A network goes on from its weights; other learners start anew, and
        as they are deterministic end where a longer run of theirs would pass.
        """
        resumed = self.model_type in NETWORKS and self.model is not None
        estimator = build_estimator(
            self.model_type, features, classes, seed, iterations - self.iterations if resumed else iterations, self.settings)
        if resumed:
            estimator.setInitialWeights(self.model.weights)
        self.model, self.iterations = fitted(estimator, train), iterations


def successive_halving(
    df: DataFrame,
    candidates: Sequence[tuple[str, dict]],
    factor: int = 3,
    min_iter: int = 3,
    max_iter: int = 27,
    share: float = 0.2,
    seed: int = 79,
    key: str = "id",
    parallelism: int = 4,
) -> DataFrame:
    """(rung, candidate, model_type, settings, max_iter, accuracy, kept) of a search by validation accuracy.

    All candidates get ``min_iter`` iterations, the best 1/``factor`` go on with ``factor`` times as many in all, on one
    scaled split, until one is left or ``max_iter`` is reached. The candidates of a rung are fitted side by side, and one
    that goes on starts from the weights it has.
    """
    features, classes = _shape(df)
    split = settle(split_train_validation(df, share, seed, key, "label_id"), "split")
    scaler = settle(train_scaler(split.filter("NOT is_validation"), "x"), "scaler")
    rows = settle(to_vector(scale_array(split, scaler, "x"), "scaled").drop("x", "scaled"), "scaled")
    train, held = rows.filter("NOT is_validation"), rows.filter("is_validation")
    fits = {network: settle(training_rows(train, "dense" if network else "logistic", seed, key), "train-rows")
            for network in {t in NETWORKS for t, _ in candidates}}
    pool_of = [Candidate(model_type, dict(settings)) for model_type, settings in candidates]
    alive, rung, iterations, log = list(range(len(candidates))), 0, min_iter, []

    def measured(c: int) -> float:
        own = pool_of[c]
        own.train_to(fits[own.model_type in NETWORKS], features, classes, seed, iterations)
        return float(accuracy(predict(own.model, held, [key])).first()[0])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        while alive:
            scores = dict(zip(alive, pool.map(measured, alive)))
            ranked = sorted(alive, key=lambda c: (-scores[c], c))
            done = len(alive) == 1 or iterations * factor > max_iter
            kept = ranked[:1] if done else ranked[: max(1, len(ranked) // factor)]
            log += [(rung, c, candidates[c][0], str(sorted(candidates[c][1].items())), iterations, scores[c], c in kept)
                    for c in ranked]
            if done:
                break
            alive, rung, iterations = kept, rung + 1, iterations * factor
    return df.sparkSession.createDataFrame(
        log, "rung int, candidate int, model_type string, settings string, max_iter int, accuracy double, kept boolean")


def best_candidate(search: DataFrame) -> int:
    return int(search.orderBy(F.desc("rung"), F.desc("kept")).select("candidate").first()[0])


def grid_results(runs: DataFrame) -> DataFrame:
    """Results of a settings grid, best accuracy first."""
    return runs.orderBy(F.desc("accuracy"), *[c for c in runs.columns if c != "accuracy"])
