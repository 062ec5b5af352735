"""Column-level checks and projections of a flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowquarry.config import BENIGN
from flowquarry.functions.cleaning import finite_or_zero, parse_double, to_number

# Columns that are never treated as features.
STUDY_EXCLUDED = ("id", "Flow ID", "attack_label", "Timestamp", "Label", "Src IP", "Dst IP")

# Column classes by key words in the name; the first match wins.
COLUMN_CLASSES = (
    ("identifier", ("id", "flow id")),
    ("network", ("ip",)),
    ("time", ("timestamp", "time", "duration", "iat")),
    ("flag", ("flag",)),
    ("size", ("length", "size", "bytes", "packet")),
    ("rate", ("/s", "rate", "ratio")),
    ("statistic", ("mean", "std", "max", "min", "avg")),
    ("protocol", ("protocol", "port")),
    ("label", ("label", "category")),
)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def readable(df: DataFrame, name: str) -> Column:
    """The column as a double, NULL where its text is no number."""
    return quoted(name).cast("double") if _is_number(df, name) else parse_double(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as a finite double; only text columns are parsed."""
    return finite_or_zero(quoted(name).cast("double")) if _is_number(df, name) else to_number(name)


def clean_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to finite doubles in place, 0 for what cannot be read."""
    return df.withColumns({c: number(df, c) for c in cols})


def split_by_label(df: DataFrame, label: str, benign: str = BENIGN) -> tuple[DataFrame, DataFrame]:
    """(benign rows, attack rows); rows without a label are in neither."""
    return df.filter(quoted(label) == benign), df.filter(quoted(label) != benign)


def with_attack_flag(df: DataFrame, label: str, flag: str = "is_attack", benign: str = BENIGN) -> DataFrame:
    return df.withColumn(flag, quoted(label) != benign)


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the table has, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def project_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[quoted(c) for c in keep], *[quoted(c) for c in present(df, wanted)])


def feature_array(df: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "x") -> DataFrame:
    """Tabular mode: one array of doubles per row next to the kept columns."""
    return df.select(*[quoted(c) for c in keep], F.array(*[number(df, c) for c in features]).alias(out))


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, non-null share, share of rows and of non-null values that read as numbers, sample variance.

    One pass over the table; the result has one row per column.
    """
    cols = list(cols or df.columns)
    narrow = df.select(
        *[quoted(c).isNotNull().alias(f"_p{i}") for i, c in enumerate(cols)],
        *[readable(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    cells = [x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"_p{i}"), F.col(f"_v{i}"))]
    long = narrow.select(F.stack(F.lit(len(cols)), *cells).alias("column", "_present", "_value"))
    return long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if("_present").alias("present"), F.count("_value").alias("numeric"),
        F.var_samp(finite_or_zero(F.col("_value"))).alias("variance"),
    ).withColumns({
        "present_share": F.try_divide("present", "rows"),
        "numeric_share": F.try_divide("numeric", "rows"),
        "numeric_share_of_present": F.try_divide("numeric", "present"),
    })


def column_overview(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: whether over 80 % of its non-null values read as numbers, and its distinct non-null values."""
    cols = list(cols or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    numeric = F.coalesce(F.sum(F.when(parse_double("value").isNotNull(), F.col("n"))), F.lit(0))
    return values.groupBy("column").agg(
        (F.coalesce(F.try_divide(numeric, present), F.lit(0.0)) > 0.8).alias("is_numeric"),
        F.count("value").alias("unique_count"))


def numeric_columns(profile: DataFrame, min_share: float = 0.7, of_present: bool = False) -> DataFrame:
    """Columns whose share of readable numbers is above ``min_share``."""
    share = "numeric_share_of_present" if of_present else "numeric_share"
    return profile.filter(F.col(share) > min_share)


def dense_columns(profile: DataFrame, min_share: float = 0.7) -> DataFrame:
    """Columns with at least int(rows * min_share) non-null values."""
    return profile.filter(F.col("present") >= F.floor(F.col("rows") * min_share))


def varying_columns(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("variance") > 0)


def model_columns(df: DataFrame, cols: Sequence[str] | None = None, numeric_share: float = 0.8) -> list[str]:
    """Columns fit for a component analysis: numeric, dense enough and not constant."""
    cols = [c for c in (cols or df.columns) if c not in STUDY_EXCLUDED]
    if not cols:
        return []
    kept = varying_columns(dense_columns(numeric_columns(column_profile(df, cols), numeric_share)))
    chosen = {r["column"] for r in kept.select("column").collect()}
    return [c for c in cols if c in chosen]


def classify_columns(columns: DataFrame, name: str = "column") -> DataFrame:
    """Adds ``column_class`` by key words in the column name."""
    lowered = F.lower(F.col(name))
    chosen = None
    for cls, words in COLUMN_CLASSES:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        chosen = F.when(hit, cls) if chosen is None else chosen.when(hit, cls)
    return columns.withColumn("column_class", chosen.otherwise("other"))


def compare_columns(profile: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted against present columns: ``used``, ``unused`` (present only) or ``missing`` (wanted only)."""
    have = profile.select("column", "present").withColumn("have", F.lit(True))
    want = wanted.select("column").withColumn("want", F.lit(True))
    both = have.join(want, "column", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unused").otherwise("used")
    return both.select("column", status.alias("status"), F.coalesce("present", F.lit(0)).alias("present"))


def long_form(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), nulls: bool = False
) -> DataFrame:
    """One row per (row, feature): kept columns, ``feature`` and ``value``.

    ``value`` is a finite double, or NULL where it cannot be read if ``nulls`` is
    set. Aggregating this by feature is several times faster than one aggregate
    per column, whose generated code outgrows the compiler on wide tables.
    """
    read = readable if nulls else number
    kept = [f"_k{i}" for i in range(len(keep))]
    narrow = df.select(
        *[quoted(c).alias(k) for c, k in zip(keep, kept)], *[read(df, f).alias(f) for f in features])
    long = narrow.unpivot(kept, [f"`{f}`" for f in features], "feature", "value")
    return long.withColumnsRenamed(dict(zip(kept, keep)))
