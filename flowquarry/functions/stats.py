"""Tail probabilities and scores as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SERIES_TERMS = 100


def kolmogorov_tail(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic ``d``.

    2 * sum over k of (-1)^(k-1) * exp(-2 k^2 L^2) with L = d * sqrt(n1 n2 / (n1 + n2)).
    """
    scaled = d * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * scaled * scaled))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) * 2
    # Below 0.2 the series has not settled after its terms and the tail is 1 to 10 digits.
    return F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def _chi2_tail(x: float, dof: int) -> float:
    if not dof or dof < 1 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2
    tail, term_dof = (math.erfc(math.sqrt(half)), 1) if dof % 2 else (math.exp(-half), 2)
    while term_dof < dof:
        tail += math.exp(term_dof / 2 * math.log(half) - half - math.lgamma(term_dof / 2 + 1))
        term_dof += 2
    return min(1.0, tail)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(chi-square with ``dof`` degrees > x); called on one row per feature."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) else _chi2_tail(float(a), int(k)) for a, k in zip(x, dof)])


def importance(spread: Column, unique_ratio: Column, p_value: Column, effect: Column) -> Column:
    """(min(spread, 3) + min(2 * unique ratio, 2) + 4 * (1 - p) * effect) / 7; a missing test adds nothing."""
    tested = (F.lit(1.0) - F.coalesce(p_value, F.lit(1.0))) * F.coalesce(effect, F.lit(0.0))
    return (F.least(spread, F.lit(3.0)) + F.least(unique_ratio * 2, F.lit(2.0)) + tested * 4) / 7


def standard_normal(hex_digest: Column) -> Column:
    """Box-Muller value from 26 hex digits of a digest: reproducible under any partitioning."""
    scale = float(2**52)
    u1 = (F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") + 1) / (scale + 1)
    u2 = F.conv(F.substring(hex_digest, 14, 13), 16, 10).cast("double") / scale
    return F.sqrt(F.log(u1) * -2) * F.cos(u2 * (2 * math.pi))
