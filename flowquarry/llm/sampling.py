"""A bounded, reproducible sample of labelled documents to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, classes: dict[str, Column], per_class: int, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(cls, text and the other columns of ``docs``) of at most ``per_class`` labelled rows of each class.

    Rows are taken in the order of a hash of their key, so the sample does not depend on partitioning.
    The keys, at most ``per_class`` times the number of classes, are broadcast; texts are not shuffled.
    Labels whose document is missing are lost from the sample; a document with two labels may be in twice.
    """
    named = labels.filter(F.col(key).isNotNull())
    parts = [
        named.filter(is_class).select(F.lit(name).alias("cls"), F.col(key).alias("_key")).distinct()
        .orderBy(F.xxhash64(F.col("_key").cast("string")), "_key").limit(per_class)
        for name, is_class in classes.items()]
    chosen = reduce(DataFrame.unionByName, parts)
    rest = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rest.join(F.broadcast(chosen), "_key").select("_key", "cls", "text")
