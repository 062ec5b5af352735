"""Result tables as JSON and CSV, and reading the newest one back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.utils import AnalysisException


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns are written as JSON text."""
    nested = (ArrayType, MapType, StructType)
    cols = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The same table as ``summary.json`` and ``summary.csv``."""
    write_json(df, f"{path}/summary.json")
    write_csv(df, f"{path}/summary.csv")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        write_csv(table, f"{path}/{name}")


def read_summary(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The JSON summary of a folder, or the CSV one where there is no JSON."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(f"{path}/summary.json")
    except AnalysisException:
        return spark.read.option("header", True).option("inferSchema", schema is None).csv(
            f"{path}/summary.csv", schema=schema)


def read_latest_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Rows of the newest JSON report below ``path``: the file, or the folder that Spark has written, with the greatest path."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    files = reader.format("binaryFile").load(path)
    newest = files.agg(F.max(F.regexp_replace("path", r"/part-[^/]*$", ""))).first()[0]
    if newest is None:
        raise ValueError(f"no JSON files below {path}")
    return (spark.read if schema is None else spark.read.schema(schema)).json(newest)


def write_versioned_json(df: DataFrame, root: str, version: str) -> None:
    """One folder per version below ``root``, so that the newest is the greatest path."""
    write_json(df, f"{root}/{version}")
