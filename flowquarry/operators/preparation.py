"""Label encoding, folds, splits and leak-free scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators.columns import quoted
from flowquarry.operators.positions import attach, hash_positions, order_hash
from flowquarry.operators.sampling import label_counts


def label_dimension(df: DataFrame, label: str = "label") -> DataFrame:
    """(label_id, label): sorted distinct labels numbered from 0. The window sees one row per class."""
    names = df.select(quoted(label).alias("label")).distinct()
    return names.select((F.row_number().over(Window.partitionBy().orderBy("label")) - 1).alias("label_id"), "label")


def encode_labels(df: DataFrame, dimension: DataFrame, label: str = "label") -> DataFrame:
    return attach(df, dimension.select("label_id", F.col("label").alias(label)), [label])


def smallest_class(df: DataFrame, label: str) -> int:
    return label_counts(df, label).agg(F.min("n")).first()[0] or 0


def assign_folds(
    df: DataFrame, k: int, seed: int, key: str, label: str = "label", stratified: bool | None = None
) -> DataFrame:
    """Column ``fold`` in 0..k-1, class by class; over all rows when a class has fewer than k rows."""
    if stratified is None:
        stratified = smallest_class(df, label) >= k
    ordered = df.withColumn("_order", order_hash(seed, key))
    placed = hash_positions(ordered, [label] if stratified else [], ["_order", key], "_pos")
    return placed.withColumn("fold", F.pmod("_pos", F.lit(k)).cast("int")).drop("_order", "_pos")


def assign_block_folds(windows: DataFrame, k: int, windows_per_block: int, overlap: int) -> DataFrame:
    """Folds of whole runs of windows, for overlapping windows.

    Windows that share rows with a neighbouring block (the last ``overlap`` of
    each block) get fold -1 and are left out of training and validation.
    """
    block = F.floor(F.col("window_id") / windows_per_block)
    inside = F.pmod(F.col("window_id"), F.lit(windows_per_block))
    fold = F.when(inside >= windows_per_block - overlap, F.lit(-1)).otherwise(F.pmod(block, F.lit(k)))
    return windows.withColumn("fold", fold.cast("int"))


def split_train_validation(
    df: DataFrame, share: float, seed: int, key: str, label: str = "label", stratified: bool | None = None
) -> DataFrame:
    """Column ``is_validation``: round(share * n) rows of each class (of all rows if a class has only one)."""
    if stratified is None:
        stratified = smallest_class(df, label) >= 2
    ordered = df.withColumn("_order", order_hash(seed, key))
    placed = hash_positions(ordered, [label] if stratified else [], ["_order", key], "_pos", "_size")
    wanted = F.floor(F.col("_size") * share + 0.5)
    return placed.withColumn("is_validation", F.col("_pos") < wanted).drop("_order", "_pos", "_size")


def array_moments(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Per position of the array ``x`` (and per group): n, mean and sum of squared deviations.

    Partial aggregation leaves one row per (group, position) and task to shuffle.
    """
    long = df.select(*[quoted(c) for c in by], F.posexplode(x).alias("feature", "_v"))
    return long.groupBy(*by, "feature").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), (F.var_pop("_v") * F.count("_v")).alias("m2"))


def _standard_deviation(variance: Column) -> Column:
    # A constant feature is only centred.
    return F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0))


def fold_scalers(df: DataFrame, x: str, k: int, fold: str = "fold") -> DataFrame:
    """(fold, feature, n, mean, sd) of the rows outside each fold, from one pass over the data.

    The moments of the other folds are merged (n, mean, squared deviations), so
    neither raw squares are summed nor the rows copied k times.
    """
    parts = array_moments(df.filter(F.col(fold) >= 0), x, [fold])
    held_out = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda h: h != F.col(fold))
    others = parts.select(F.explode(held_out).alias("_held"), "feature", "n", "mean", "m2")
    merged = others.groupBy(F.col("_held").alias(fold), "feature").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", F.col("mean").alias("m"), "m2")).alias("_parts"))
    m2 = F.aggregate(
        "_parts", F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * F.pow(p["m"] - F.col("mean"), F.lit(2.0)))
    return merged.withColumn("sd", _standard_deviation(m2 / F.col("n"))).drop("_parts")


def train_scaler(train: DataFrame, x: str) -> DataFrame:
    """(feature, n, mean, variance, sd), population variance, over the given rows."""
    variance = F.col("m2") / F.col("n")
    return array_moments(train, x).select(
        "feature", "n", "mean", variance.alias("variance"), _standard_deviation(variance).alias("sd"))


def window_scaler(train: DataFrame, x: str) -> DataFrame:
    """Scaler per feature over all time steps of a window matrix."""
    steps = train.select(F.explode(x).alias("_step"))
    return train_scaler(steps, "_step")


def _as_arrays(scaler: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("feature", "mean", "sd")))
    return scaler.groupBy(*by).agg(ordered.alias("_scale"))


def scale_array(df: DataFrame, scaler: DataFrame, x: str, out: str = "scaled", by: Sequence[str] = ()) -> DataFrame:
    """(v - mean) / sd for each position of ``x``; ``by`` picks the scaler, e.g. of the row's fold.

    The scaler has one row per feature and group, so it is small by construction.
    """
    arrays = _as_arrays(scaler, by)
    joined = df.join(F.broadcast(arrays), list(by)) if by else df.withColumn("_scale", arrays.scalar())
    scaled = F.zip_with(quoted(x), "_scale", lambda v, s: (v - s["mean"]) / s["sd"])
    return joined.withColumn(out, scaled).drop("_scale")


def scale_windows(df: DataFrame, scaler: DataFrame, x: str, out: str = "scaled") -> DataFrame:
    joined = df.withColumn("_scale", _as_arrays(scaler).scalar())
    scaled = F.transform(
        quoted(x), lambda step: F.zip_with(step, F.col("_scale"), lambda v, s: (v - s["mean"]) / s["sd"]))
    return joined.withColumn(out, scaled).drop("_scale")
