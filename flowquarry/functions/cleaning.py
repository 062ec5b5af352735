"""Numeric cleaning of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def finite_or_zero(c: str | Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    c = _col(c)
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def parse_double(c: str | Column) -> Column:
    """Text to double, NULL when it is no number (type suffixes such as ``1d`` are no numbers)."""
    c = _col(c).cast("string")
    return F.when(~c.rlike("[0-9.][dDfF]\\s*$"), c.try_cast("double"))


def to_number(c: str | Column) -> Column:
    """Text to a finite double, 0 for whatever cannot be read."""
    return finite_or_zero(parse_double(c))
