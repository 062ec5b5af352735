"""Exact positions, quotas and running totals without a one-task window.

A plain ``row_number`` over a label or over nothing sorts a whole class in one
task. The operators here split each group into many slices of the wanted order,
count the slices first (a small aggregate) and add the counts of the earlier
slices to a position found inside the slice.

* hash order: a slice is a prefix of the md5 order key. The slices of a group
  are of even size whatever the data, so a hot group spreads over all tasks.
* natural order: a slice is a range partition of (group, order), settled once
  because the range bounds come from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.session import settle, settle_measured

SLICE_DIGITS = 4  # 65,536 slices per group
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def order_hash(seed: int, *keys: str | Column) -> Column:
    """Reproducible pseudo-random order key: the same rows under any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def row_digest(df: DataFrame) -> Column:
    """Key for tables without one; equal rows share it and are interchangeable."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))


def _group_key(group_cols: Sequence[str]) -> Column:
    # A struct compares NULL fields as equal, so rows with a NULL group are kept by the joins.
    return F.struct(*[F.col(f"`{c}`") for c in group_cols]) if group_cols else F.struct(F.lit(0).alias("all"))


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of one row per key; its measured size picks the join.

    Below ``BROADCAST_BYTES`` the table is broadcast and ``df`` is not shuffled.
    Above it the keys are salted, so a key that holds a large share of ``df``
    still spreads over ``SALTS`` tasks.
    """
    dim, size = settle_measured(dim, "dim")
    return join_measured(df, dim, size, on, how)


def join_measured(df: DataFrame, dim: DataFrame, size: int, on: Sequence[str], how: str = "inner") -> DataFrame:
    """As ``attach``, for a table that is settled and measured already, so that several joins can share it."""
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(dim), list(on), how)
    return salted_join(df, dim, on, how)


def salted_join(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hash_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[str],
    pos: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group, in the order ``order``.

    ``order[0]`` must hold an md5 hex string; the rest breaks ties. One small
    aggregate and one shuffle on (group, slice), which the join and the window share.
    """
    sliced = df.withColumn("_g", _group_key(group_cols)).withColumn("_slice", F.substring(order[0], 1, SLICE_DIGITS))
    counts = sliced.groupBy("_g", "_slice").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_g", "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_group_rows"),
    )
    inside = Window.partitionBy("_g", "_slice").orderBy(*order)
    out = sliced.join(offsets, ["_g", "_slice"]).withColumn(
        pos, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
    if size:
        out = out.withColumn(size, F.col("_group_rows").cast("long"))
    return out.drop("_g", "_slice", "_before", "_group_rows")


def first_by_hash(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[str],
    quota: int | DataFrame,
) -> DataFrame:
    """The first ``quota`` rows of each group in hash order (all rows of smaller groups).

    ``quota`` is one number, or a table of the group columns and ``quota``.
    """
    keyed = df.withColumn("_g", _group_key(group_cols))
    limits = keyed.groupBy("_g").agg(F.count("*").alias("n"))
    if isinstance(quota, int):
        limits = limits.withColumn("quota", F.lit(quota))
    else:
        limits = limits.join(quota.select(_group_key(group_cols).alias("_g"), F.col("quota")), "_g")
    return bottom_rows(keyed, limits, order, "_g").drop("_g")


def _prefix_at(share: Column) -> Column:
    """Text that a share of all md5 digests lies below; beyond all digests for the whole share."""
    place = F.ceil(share * F.lit(float(1 << 52))).cast("long")
    return F.when(share >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(place), 13, "0")))


def bottom_rows(df: DataFrame, limits: DataFrame, order: Sequence[str], on: str, group: str | None = None) -> DataFrame:
    """The first ``quota`` rows of each group by ``order``, of which ``order[0]`` is an md5 hex string.

    ``limits`` has a row per value of the column ``on`` with ``n`` and ``quota`` of its group, and the group if it is
    not the value itself. Digests are even, so a group's first rows lie below a share of (quota + slack) / n of all
    digests: the rest is dropped in the scan. Rows below (quota - slack) / n are in the sample; only the band between,
    whose size is the slack, is ranked. Counts of what was kept say whether the slack did for every group, otherwise it
    is widened; so the rows are exact, and no task ranks a whole group or quota.
    """
    group = group or on
    limits, size = settle_measured(limits.filter("quota > 0"), "limits")
    prefix, slack = F.substring(order[0], 1, 13), 8.0
    while True:
        margin = F.sqrt(F.col("quota").cast("double")) * slack + 4 * slack
        cuts = limits.withColumns({
            "_sure": _prefix_at(F.greatest(F.col("quota") - margin, F.lit(0.0)) / F.col("n")),
            "_last": _prefix_at((F.col("quota") + margin) / F.col("n"))})
        near = join_measured(df, cuts.drop("n", "quota"), size, [on]).filter(prefix < F.col("_last"))
        kept = settle(near.withColumn("_sure", prefix < F.col("_sure")).drop("_last"), "bottom-rows")
        found = kept.groupBy(group).agg(F.count_if("_sure").alias("_below"), F.count("*").alias("_found"))
        groups = limits.groupBy(group).agg(F.max("n").alias("n"), F.max("quota").alias("quota"))
        state, state_size = settle_measured(groups.join(found, group, "left").fillna(0, ["_below", "_found"]), "bottom-state")
        if state.filter("_below > quota OR _found < least(quota, n)").isEmpty():
            break
        slack *= 4
    first = Window.partitionBy(group).orderBy(*order)
    band = join_measured(kept.filter("NOT _sure"), state.select(group, "quota", "_below"), state_size, [group])
    ranked = band.withColumn("_rank", F.row_number().over(first)).filter("_rank <= quota - _below")
    names = [c for c in kept.columns if c != "_sure"]
    return kept.filter("_sure").select(*[F.col(f"`{c}`") for c in names]).unionByName(ranked.select(*[F.col(f"`{c}`") for c in names]))


def _ranged(df: DataFrame, group_cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Settled table, range-partitioned and sorted by (group, order), with row and range numbers."""
    keys = [F.col(f"`{c}`") for c in (*group_cols, *order)]
    ranged = settle(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()),
        "ranged")
    return ranged.withColumns({"_g": _group_key(group_cols), "_range": F.shiftright("_row", 33)})


def _earlier_ranges(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per (group, range): first row number and the totals of the group's earlier ranges."""
    totals = ranged.groupBy("_g", "_range").agg(
        F.min("_row").alias("_first"), *[c.alias(f"_sum_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_g", "_range", "_first",
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )


def ordered_positions(
    df: DataFrame, order: Sequence[str], group_cols: Sequence[str] = (), pos: str = "pos"
) -> DataFrame:
    """0-based position in the natural order ``order`` (which must be unique per group).

    One range shuffle; the position inside a range comes from its row numbers, so
    no second shuffle is needed.
    """
    ranged = _ranged(df, group_cols, order)
    offsets = _earlier_ranges(ranged, {"n": F.count("*")})
    return (
        attach(ranged, offsets, ["_g", "_range"])
        .withColumn(pos, (F.col("_before_n") + F.col("_row") - F.col("_first")).cast("long"))
        .drop("_g", "_range", "_row", "_first", "_before_n")
    )


def running_totals(
    df: DataFrame, order: Sequence[str], sums: Sequence[str], group_cols: Sequence[str] = (), prefix: str = "upto_"
) -> DataFrame:
    """Running sum of each column of ``sums`` in the order ``order``, the row itself included.

    Meant for tables that are already aggregated to one row per order value.
    """
    ranged = _ranged(df, group_cols, order)
    offsets = _earlier_ranges(ranged, {s: F.sum(s) for s in sums})
    inside = Window.partitionBy("_g", "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = attach(ranged, offsets, ["_g", "_range"])
    out = out.withColumns({f"{prefix}{s}": F.col(f"_before_{s}") + F.sum(s).over(inside) for s in sums})
    return out.drop("_g", "_range", "_row", "_first", *[f"_before_{s}" for s in sums])
