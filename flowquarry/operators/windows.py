"""Row-count windows over a time-ordered table, and event-time counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.config import WINDOW_PRESETS
from flowquarry.operators.columns import number, quoted
from flowquarry.operators.positions import ordered_positions

BLOCK_ROWS = 1024


def windows_from_positions(
    placed: DataFrame,
    size: int,
    step: int,
    payload: Sequence[str],
    group_cols: Sequence[str] = (),
    pos: str = "pos",
) -> DataFrame:
    """Windows of ``size`` rows at positions 0, step, 2*step, ...; full windows only.

    Rows are cut into blocks of about ``BLOCK_ROWS`` positions; the first
    ``size - step`` rows of a block also go to the block before it. A block is
    one bounded array, from which its windows are sliced: the data is shuffled
    once, and hardly any row twice, however much the windows overlap.
    """
    if step > size:
        return _apart(placed, size, step, payload, group_cols, pos)
    per_block = max(-(-size // step), BLOCK_ROWS // step, 1)
    span = per_block * step
    block = F.floor(F.col(pos) / span).cast("long")
    offset = F.col(pos) - block * span
    shared = (block > 0) & (offset < size - step)
    blocks = F.when(shared, F.array(block - 1, block)).otherwise(F.array(block))
    row = F.struct(F.col(pos).cast("long").alias("_pos"), *[quoted(c) for c in payload])
    grouped = (
        placed.select(*[quoted(c) for c in group_cols], F.explode(blocks).alias("_block"), row.alias("_row"))
        .groupBy(*group_cols, "_block")
        .agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
        .withColumn("_from", F.element_at("_rows", 1)["_pos"])
    )
    # Positions of a group follow each other, so a block's array is one run that starts at _from.
    first = F.greatest(F.col("_block") * per_block, F.ceil(F.col("_from") / step))
    last = F.least((F.col("_block") + 1) * per_block - 1, F.floor((F.col("_from") + F.size("_rows") - size) / step))
    bounded = grouped.withColumns({"_first": first.cast("long"), "_last": last.cast("long")})
    cut = bounded.filter("_first <= _last").withColumn("window_id", F.explode(F.sequence("_first", "_last")))
    return cut.select(
        *[quoted(c) for c in group_cols],
        "window_id",
        F.slice("_rows", (F.col("window_id") * step - F.col("_from") + 1).cast("int"), F.lit(size)).alias("rows"),
    )


def _apart(placed: DataFrame, size: int, step: int, payload: Sequence[str], group_cols: Sequence[str], pos: str) -> DataFrame:
    """Windows with gaps between them: rows in the gaps are dropped in the scan, and a window is an array of its own."""
    row = F.struct(F.col(pos).cast("long").alias("_pos"), *[quoted(c) for c in payload])
    kept = placed.filter(F.pmod(F.col(pos), F.lit(step)) < size)
    window = F.floor(F.col(pos) / step).cast("long").alias("window_id")
    cut = kept.select(*[quoted(c) for c in group_cols], window, row.alias("_row")).groupBy(*group_cols, "window_id").agg(
        F.sort_array(F.collect_list("_row")).alias("rows"))
    return cut.filter(F.size("rows") == size)


def _field(name: str) -> Callable[[Column], Column]:
    return lambda r: r[name]


def window_columns(cut: DataFrame, group_cols: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Matrix, label of the last row and kept arrays of windows cut from (_x, _label, kept columns)."""
    return cut.select(
        *[quoted(c) for c in group_cols],
        "window_id",
        F.transform("rows", lambda r: r["_x"]).alias("x"),
        F.element_at("rows", -1)["_label"].alias("label"),
        *[F.transform("rows", _field(c)).alias(c) for c in keep],
    )


def window_payload(
    df: DataFrame, order: Sequence[str], features: Sequence[str], label: str,
    group_cols: Sequence[str] = (), keep: Sequence[str] = (),
) -> DataFrame:
    """Only what the windows need: keys, one array of features and the label."""
    return df.select(
        *[quoted(c) for c in dict.fromkeys([*group_cols, *order, *keep])],
        F.array(*[number(df, c) for c in features]).alias("_x"),
        quoted(label).alias("_label"),
    )


def count_windows(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    size: int = 10,
    step: int = 5,
    group_cols: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(window_id, x, label): feature matrix in time order and the label of the window's last row.

    ``order`` must be unique (time, then a key). ``keep`` adds an array per named
    column with its values along the window.
    """
    payload = window_payload(df, order, features, label, group_cols, keep)
    placed = ordered_positions(payload, order, group_cols)
    cut = windows_from_positions(placed, size, step, ["_x", "_label", *keep], group_cols)
    return window_columns(cut, group_cols, keep)


def preset_windows(df: DataFrame, preset: str, **kwargs) -> DataFrame:
    size, step = WINDOW_PRESETS[preset]
    return count_windows(df, size=size, step=step, **kwargs)


def flatten_windows(windows: DataFrame, x: str = "x", out: str = "flat") -> DataFrame:
    """Matrix (time x feature) to one array, for models without a time axis."""
    return windows.withColumn(out, F.flatten(x))


def to_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(quoted(array)))


def time_window_counts(
    df: DataFrame, duration: str, ts: str = "ts", keys: Sequence[str] = ("label",), watermark: str | None = None
) -> DataFrame:
    """Rows per event-time window and keys; the same plan for tables and, with a watermark, streams."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, duration), *[quoted(k) for k in keys])
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
    )
