"""Model-ready tables, kept under a digest of everything that decides their rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowquarry.config import StudyConfig


def load_or_build(
    spark: SparkSession, root: str, config: StudyConfig, inputs: Sequence[str], build: Callable[[], tuple[DataFrame, DataFrame]]
) -> tuple[DataFrame, DataFrame]:
    """(rows, label dimension): read from the cache, or built, written and read back.

    The entry belongs to the settings and to the state of the input files, so a change of either builds a new one. The
    dimension is written last, so a half-written entry is built again.
    """
    path = f"{root}/{config.fingerprint(*inputs, input_digest(spark, inputs))}"
    try:
        return _read(spark, path)
    except AnalysisException:
        rows, labels = build()
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        labels.write.mode("overwrite").parquet(f"{path}/labels")
        return _read(spark, path)


def input_digest(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Names, sizes and times of all files below the inputs in one text; their contents are not read.

    An input that is no path stands for itself by its name, which the fingerprint holds anyway.
    """
    state = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    found = []
    for name in sorted(inputs):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        row = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum(state).alias("state")).first()
        found.append(f"{name}|{row['files']}|{row['bytes']}|{row['state']}")
    return "\n".join(found)


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    labels = spark.read.parquet(f"{path}/labels")
    return spark.read.parquet(f"{path}/rows"), labels
