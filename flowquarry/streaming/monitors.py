"""Live counts and rates over event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowquarry.config import BENIGN
from flowquarry.operators.columns import quoted
from flowquarry.operators.evaluation import detection_rates
from flowquarry.session import scratch_path
from flowquarry.streaming.state import read_state


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "ts") -> DataFrame:
    """File stream; the event time is a TIMESTAMP, as watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(df: DataFrame, duration: str, watermark: str, aggs: list[Column], keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    counted = df.withWatermark(ts, watermark).groupBy(F.window(ts, duration), *[quoted(k) for k in keys]).agg(*aggs)
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in counted.columns if c != "window"])


def label_counts_stream(df: DataFrame, duration: str, watermark: str, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    return windowed(df, duration, watermark, [F.count("*").alias("n")], keys)


def detection_stream(
    df: DataFrame, duration: str, watermark: str, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Confusion counts, detection and false-alarm rate of each window."""
    return detection_rates(confusion_stream(df, duration, watermark, label, predicted))


def confusion_stream(
    df: DataFrame, duration: str, watermark: str, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    attack, flagged = quoted(label) != BENIGN, quoted(predicted) != BENIGN
    counts = [F.count_if(~attack & ~flagged).alias("tn"), F.count_if(~attack & flagged).alias("fp"),
              F.count_if(attack & ~flagged).alias("fn"), F.count_if(attack & flagged).alias("tp")]
    return windowed(df, duration, watermark, counts)


def run_to_table(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all data that is there and returns the table it wrote.

    Append mode: a window is written once, when the watermark has passed its end.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def open_windows(spark: SparkSession, checkpoint: str, counts: Sequence[str]) -> DataFrame:
    """Windows that a stream of :func:`windowed` counts still holds open, from its state: bounds, keys and counts.

    ``counts`` names the aggregates in their order; counts are kept in the state as they are.
    """
    state = read_state(spark, checkpoint)
    keys = [f.name for f in state.schema["key"].dataType.fields if f.name != "window"]
    bounds = [F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end")]
    # the state calls every count the same, so they are renamed by place
    value = F.col("value").cast("struct<" + ",".join(f"`{c}`:bigint" for c in counts) + ">")
    return state.select(*bounds, *[F.col(f"key.`{k}`").alias(k) for k in keys], value.alias("value")).select(
        "window_start", "window_end", *[quoted(k) for k in keys], "value.*")


def run_bounded(
    stream: DataFrame, counts: Sequence[str], path: str, checkpoint: str | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda windows: windows,
) -> DataFrame:
    """All windows of a stream of counts over a source that has ended.

    The stream writes the windows that the watermark has passed; those still open when the data ends are read from its
    state, so no row is read twice. ``finish`` derives further columns of the counts.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    closed = run_to_table(stream, path, checkpoint)
    return finish(closed.unionByName(open_windows(spark, checkpoint, counts)))
