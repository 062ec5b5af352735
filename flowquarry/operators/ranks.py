"""Exact ranks, quantiles and running totals from a sketch and one further pass, without a sort of the table.

A mergeable quantile sketch cuts every group into cells. Cells are numbered by a search in the group's cuts, so a value
table is ordered inside its cells only, and what lies before a cell follows from one small row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256
ACCURACY = 2_000  # a sketch's ranks are off by at most 1 / ACCURACY of the rows
SMALL_GROUP = 10_000  # rows up to which a group's values are all kept


def cell_cuts(rows: DataFrame, by: Sequence[str], value: str, also: dict[str, Column]) -> DataFrame:
    """(by, _cuts, also): values that cut each group into about ``CELLS`` even cells, and further aggregates, from one scan."""
    at = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    cuts = F.array_distinct(F.percentile_approx(value, at, F.lit(ACCURACY))).alias("_cuts")
    return rows.groupBy(*by).agg(cuts, *[c.alias(n) for n, c in also.items()])


def cell_of(value: Column, cuts: Column) -> Column:
    """How many of the ascending ``cuts`` are smaller than ``value``."""
    steps = F.array(*[F.lit(1 << k) for k in range(CELLS.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def running_in_cells(counts: DataFrame, cuts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``counts`` (a row per group and value) with ``_cell``, running sums ``in_<sum>`` inside the cell and the columns of ``cuts``.

    ``cuts`` has one row of at most ``CELLS`` values per group and is broadcast; a cell is a small share of a group, so
    no task orders a whole group.
    """
    placed = counts.join(F.broadcast(cuts), list(by)).withColumn("_cell", cell_of(F.col(value), F.col("_cuts"))).drop("_cuts")
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({f"in_{s}": F.sum(s).over(inside) for s in sums})


def before_cells(cells: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``cells`` (a row per group and cell) with ``before_<sum>``, the totals of the group's earlier cells."""
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums})


def quantile_brackets(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(by, n, _low, _high): for each quantile, values between which its two neighbouring rows lie for sure.

    Brackets are six ranks in ``ACCURACY`` wide; of a group of up to ``SMALL_GROUP`` rows they hold everything.
    """
    margin = 3 / ACCURACY
    ends = [F.array(*[F.lit(min(max(q + s * margin, 0.0), 1.0)) for q in quantiles]) for s in (-1, 1)]
    found = rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.percentile_approx(value, F.concat(*ends), F.lit(ACCURACY)).alias("_ends"))
    small = F.col("n") <= SMALL_GROUP
    k = len(quantiles)
    wide = lambda sign: F.array(*[F.lit(sign * float("inf"))] * k)
    return found.select(
        *by, "n", F.when(small, wide(-1)).otherwise(F.slice("_ends", 1, k)).alias("_low"),
        F.when(small, wide(1)).otherwise(F.slice("_ends", k + 1, k)).alias("_high"))


def strata(rows: DataFrame, brackets: DataFrame, by: Sequence[str], value: str, n_brackets: int) -> DataFrame:
    """(by, n, least, most, rows, first, last): the values of a group in order, those inside a bracket one by one, those between as one row.

    ``least`` and ``most`` are the smallest and largest value of a row, ``first`` and ``last`` their ranks from 0.
    ``brackets`` has the arrays _low and _high, a row per group, and is broadcast. Tasks add up before the shuffle, and
    what moves is the bracketed values.
    """
    held = rows.join(F.broadcast(brackets), list(by))
    ends = [(F.get("_low", F.lit(i)), F.get("_high", F.lit(i))) for i in range(n_brackets)]
    inside = reduce(Column.__or__, [F.col(value).between(low, high) for low, high in ends])
    passed = reduce(Column.__add__, [(F.col(value) > high).cast("int") for _, high in ends])
    # between two brackets, how many brackets lie below tells the stretch
    cells = held.groupBy(*by, "n", F.when(~inside, passed).alias("_passed"), F.when(inside, F.col(value)).alias("_value")).agg(
        F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy("least").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("rows") + 1).drop("_passed", "_value")


def value_at(rank: Column) -> Column:
    """Aggregate over ``strata``: the value at a rank, which has to lie in a bracket."""
    holds = (F.col("first") <= rank) & (rank <= F.col("last"))
    single = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")))
    return F.max(F.when(holds, single))


def quantile_at(q: float) -> list[Column]:
    """Aggregates ``_lo<q>`` and ``_hi<q>`` over ``strata``: the values whose interpolation is the quantile."""
    at = (F.col("n") - 1) * q
    return [value_at(F.floor(at)).alias(f"_lo{int(q * 100)}"), value_at(F.ceil(at)).alias(f"_hi{int(q * 100)}")]


def interpolated(q: float) -> Column:
    at, name = (F.col("n") - 1) * q, int(q * 100)
    return F.col(f"_lo{name}") + (F.col(f"_hi{name}") - F.col(f"_lo{name}")) * (at - F.floor(at))
