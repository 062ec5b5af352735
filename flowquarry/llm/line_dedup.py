"""Boilerplate lines: lines found on many distinct sites are removed.

How far a line has spread is estimated by a HyperLogLog sketch of the sites per line hash; sketches are built
in the map tasks and merged by the aggregation. Lines whose estimate is so near the threshold that the sketch
could be wrong get an exact distinct count; the others are decided by the sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.session import settle

MIN_SITES = 10
SKETCH_LOG2 = 10
ERRORS = 4.0  # standard errors around the threshold that count as near


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines on ``min_sites`` sites or more, from a table (h1, h2, site)."""
    near = max(1.0, ERRORS * 1.04 / math.sqrt(1 << SKETCH_LOG2) * min_sites)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sketch"))
    guessed = settle(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - near), "spread")
    sure = guessed.filter(F.col("sites") > min_sites + near).select("h1", "h2")
    unsure = guessed.filter(F.col("sites") <= min_sites + near).select("h1", "h2")
    exact = lines.join(unsure, ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    return settle(sure.union(exact.filter(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")


def drop_boilerplate(docs: DataFrame, text: str = "text", key: str = "doc_id", site: str = "source",
                     min_sites: int = MIN_SITES, min_chars: int | None = None) -> DataFrame:
    """(key, n_lines, n_removed, kept_text) for every row of ``docs``.

    Lines end at a line feed and are compared without blanks around them; empty ones stay, and if ``min_chars`` is given
    all of fewer characters. A NULL site is a site of its own; a NULL text is one empty line. Repeated rows count a site once and get
    equal results, a NULL key is a key like others. Very long texts are read whole, line by line. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_text_hash"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{site}`").cast("string")), F.lit("n")).alias("site"), _lines(text).alias("_lines"))
    lines = rows.select("_key", "_text_hash", "site", F.posexplode("_lines").alias("pos", "line")).withColumn("line", F.trim("line")).filter(
        F.length("line") >= max(1, min_chars or 1)).select(
        "_key", "_text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    lines = settle(lines, "lines")
    boilerplate = spread_lines(lines.select("h1", "h2", "site"), min_sites)
    gone = settle(lines.join(boilerplate, ["h1", "h2"]).groupBy("_key", "_text_hash").agg(F.collect_set("pos").alias("_gone")), "removed-lines")
    same = F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a._text_hash") == F.col("b._text_hash"))
    all_lines = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(all_lines, F.coalesce("_gone", F.array().cast("array<int>"))), lambda i: F.get("_lines", i))
    return rows.alias("a").join(gone.alias("b"), same, "left").select(
        F.col("a._key").alias(key), F.size("_lines").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))
