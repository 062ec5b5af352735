"""A trained classifier as one pipeline with its scaler and its labels: saved, loaded and scored as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.columns import quoted
from flowquarry.operators.evaluation import argmax
from flowquarry.operators.preparation import label_dimension, train_scaler
from flowquarry.operators.training import build_estimator, fitted, training_rows


class ScaleArray(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array of numbers to the vector of (value - mean) / sd."""

    mean = Param(Params._dummy(), "mean", "mean of each position", TypeConverters.toListFloat)
    sd = Param(Params._dummy(), "sd", "deviation of each position", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, mean=None, sd=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        scale = F.array(*[
            F.struct(F.lit(m).alias("mean"), F.lit(s).alias("sd")) for m, s in zip(self.getOrDefault(self.mean), self.getOrDefault(self.sd))])
        scaled = F.zip_with(quoted(self.getInputCol()), scale, lambda v, s: (v - s["mean"]) / s["sd"])
        return df.withColumn(self.getOutputCol(), array_to_vector(scaled))


class NameLabels(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector of class probabilities to ``proba``, the class id ``y_pred`` and the label's name."""

    labels = Param(Params._dummy(), "labels", "names of the class ids", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.getOrDefault(self.labels)])
        scored = df.withColumn("proba", vector_to_array(quoted(self.getInputCol()))).withColumn("y_pred", argmax())
        return scored.withColumn(self.getOutputCol(), F.get(names, F.col("y_pred")))


def fit_pipeline(
    df: DataFrame, model_type: str, label: str = "label", x: str = "x", key: str = "id", seed: int = 79, max_iter: int = 20,
    overrides: dict | None = None, weighted: bool = True,
) -> PipelineModel:
    """Scaler, classifier and label names, fitted on all rows that have a label; ``x`` is an array column.

    What reaches the driver is a mean and a deviation per feature, the labels and the model.
    """
    labelled = df.filter(quoted(label).isNotNull())
    names = [r["label"] for r in label_dimension(labelled.withColumn(label, quoted(label).cast("string")), label).orderBy("label_id").collect()]
    moments = train_scaler(labelled, x).orderBy("feature").collect()
    scaler = ScaleArray(inputCol=x, outputCol="features", mean=[r["mean"] for r in moments], sd=[r["sd"] for r in moments])
    ids = F.array(*[F.lit(n) for n in names])
    rows = scaler.transform(labelled).select(
        quoted(key).alias("id"), "features", (F.array_position(ids, quoted(label).cast("string")) - 1).cast("int").alias("label_id"))
    estimator = build_estimator(model_type, len(moments), len(names), seed, max_iter, overrides)
    model = fitted(estimator, training_rows(rows, model_type, seed, "id", weighted))
    return PipelineModel([scaler, model, NameLabels(inputCol="probability", outputCol="predicted", labels=names)])


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    """A saved pipeline; it needs neither the training rows nor their label table."""
    return PipelineModel.load(path)


def score_pipeline(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, proba, y_pred, predicted) of rows with the array column that the pipeline was fitted on; labels are not needed."""
    return model.transform(df).select(*[quoted(c) for c in keep], "proba", "y_pred", "predicted")
