"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and
numbered, which names each block by an integer; then adjacent pairs of names are named
the same way, level by level, until one name is left of each text. Texts of the same
number of levels have the same last name exactly when they are equal.

Only the first level moves text, once, combined in the map tasks first: blocks meet by
a digest and are compared in full there. A digest that two different blocks share would
be seen and the level done again with another salt, so names never rest on a hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.session import settle

BLOCK_BYTES = 8192
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    """White space runs as one space; NULL as empty."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), WHITE_SPACE, " ")


def _blocks(df: DataFrame, block_bytes: int, salt: int) -> DataFrame:
    """(.., n_blocks, pos, block, digest) of a table with ``_bytes``; an empty text is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                      lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    rest = [c for c in df.columns if c != "_bytes"]
    return df.withColumn("n_blocks", n).select(*rest, "n_blocks", F.posexplode(cut).alias("pos", "block")).withColumn(
        "digest", F.unhex(F.md5(F.concat(F.lit(str(salt)).cast("binary"), F.col("block")))))


def _numbered(distinct: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Distinct keys with an integer name each, sorted inside their partitions and written once."""
    return settle(distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def block_names(docs: DataFrame, text: str, key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_row, key, n_blocks, text_sha256, pos, name): the named blocks of every row."""
    rows = block_source(docs, text, key)
    salt = 0
    while True:
        occurrences = settle(_blocks(rows, block_bytes, salt).drop("block"), "blocks")
        distinct = _blocks(rows.select("_bytes"), block_bytes, salt).groupBy("digest", "block").agg(F.count("*").alias("n"))
        names = _numbered(distinct, ["block"], ["digest"])
        if names.groupBy("digest").count().filter("count > 1").isEmpty():
            return occurrences.join(names, "digest").drop("digest")
        salt += 1


def block_source(docs: DataFrame, text: str, key: str) -> DataFrame:
    clean = docs.select(F.col(f"`{key}`").alias("key"), normalised(text).alias("_text"))
    return clean.select(
        F.monotonically_increasing_id().alias("_row"), "key", F.sha2("_text", 256).alias("text_sha256"),
        F.col("_text").cast("binary").alias("_bytes"))


def text_names(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_row, key, text_sha256, levels, name): one identity (levels, name) per row, equal for equal texts only."""
    current = settle(block_names(docs, text, key, block_bytes), "level")
    ident = ["_row", "key", "text_sha256"]
    done = [current.filter("n_blocks = 1").select(*ident, F.lit(0).alias("levels"), "name")]
    current = current.filter("n_blocks > 1")
    left = current.agg(F.max("n_blocks").alias("n")).first().n or 1
    level = 0
    while left > 1:
        level, left = level + 1, (left + 1) // 2
        pairs = current.groupBy("_row", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.first("key").alias("key"), F.first("text_sha256").alias("text_sha256"),
            F.first(((F.col("n_blocks") + 1) / 2).cast("int")).alias("n_blocks"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"))
        names = _numbered(pairs.select("first", "second").distinct(), ["first", "second"], ["first", "second"])
        current = settle(pairs.join(names, ["first", "second"]).drop("first", "second"), "level")
        done.append(current.filter("n_blocks = 1").select(*ident, F.lit(level).alias("levels"), "name"))
        current = current.filter("n_blocks > 1")
    return reduce(DataFrame.unionByName, done)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row.

    Of rows with equal normalised texts the one with the smallest key stays; a NULL key comes last, and of
    rows that repeat a key and text one stays. A NULL text is an empty one. An empty table gives no rows;
    columns besides key and text are not read, so their names cannot clash.
    """
    names = text_names(docs, text, key, block_bytes)
    best = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "_row")).alias("best")
    # written first: a join of two plain exchanges can split a large group
    groups = settle(names.groupBy("levels", "name").agg(best, F.count("*").alias("group_size")), "groups")
    return names.join(groups, ["levels", "name"]).select(
        F.col("key").alias(key), F.col("best.key").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("best._row")).alias("kept"), "text_sha256")
