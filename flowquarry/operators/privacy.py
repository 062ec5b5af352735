"""Anonymising address columns, keeping and using the mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.addresses import anonymize_long, ip_to_long, key_digest, long_to_ip
from flowquarry.operators.columns import quoted
from flowquarry.operators.positions import attach, join_measured
from flowquarry.session import settle_measured


def _anonymized(df: DataFrame, ip: str, out: str, key: bytes) -> DataFrame:
    numbered = df.withColumn("_n", ip_to_long(quoted(ip)))
    changed = F.when(F.col("_n") == 0, quoted(ip)).otherwise(long_to_ip(F.col("_anon")))
    return numbered.withColumn("_anon", anonymize_long("_n", key)).withColumn(out, changed).drop("_n", "_anon")


def canonical_ip(ip: str | Column) -> Column:
    """One spelling per address, without leading zeros; what is no address stays as it is."""
    ip = F.col(f"`{ip}`") if isinstance(ip, str) else ip
    return F.when(ip_to_long(ip) > 0, long_to_ip(ip_to_long(ip))).otherwise(ip)


def ip_mapping(df: DataFrame, ip_cols: Sequence[str], key: bytes) -> DataFrame:
    """(ip, anon_ip) for every distinct address of the columns, in its one spelling; unreadable ones and 0.0.0.0 map to themselves."""
    ips = df.select(F.explode(F.array(*[quoted(c) for c in ip_cols])).alias("ip")).filter("ip IS NOT NULL")
    ips = ips.select(canonical_ip("ip").alias("ip")).distinct()
    # Few bytes but 32 digests per address: dealt to all cores, not coalesced by size.
    return _anonymized(ips.repartition(df.sparkSession.sparkContext.defaultParallelism), "ip", "anon_ip", key)


def anonymize(df: DataFrame, ip_cols: Sequence[str], key: bytes) -> DataFrame:
    """Replace each address column; columns keep their order.

    Each distinct address is computed once. The mapping is written and measured once; all columns look their
    addresses up in it, by a broadcast if it is small and by a salted join beyond.
    """
    order = [quoted(c) for c in df.columns]
    mapping, size = settle_measured(ip_mapping(df, ip_cols, key), "ips")
    lookup = mapping.select(F.col("ip").alias("_ip"), F.col("anon_ip").alias("_new"))
    for c in ip_cols:
        df = join_measured(df.withColumn("_ip", canonical_ip(c)), lookup, size, ["_ip"], "left").withColumn(c, F.col("_new")).drop("_new", "_ip")
    return df.select(*order)


def deanonymize(df: DataFrame, ip_col: str, mapping: DataFrame, out: str) -> DataFrame:
    """Original address by the mapping, in its one spelling; the value itself when it is not mapped.

    Rows keep their number: of addresses with the same output, which only 0.0.0.0 and texts that are no addresses can
    share with another, since they map to themselves, the one that was changed counts.
    """
    own = F.struct((F.col("ip") == F.col("anon_ip")).alias("same"), "ip")
    reverse = mapping.groupBy(F.col("anon_ip").alias("_ip")).agg(F.min(own).alias("_old")).select("_ip", F.col("_old.ip").alias("_old"))
    order = [quoted(c) for c in df.columns if c != out]
    found = attach(df.withColumn("_ip", quoted(ip_col)), reverse, ["_ip"], "left")
    return found.select(*order, F.coalesce("_old", quoted(ip_col)).alias(out))


def with_octets(df: DataFrame, ip_cols: Sequence[str], to_octets) -> DataFrame:
    """Adds ``<column>_Octet_1..4`` by ``to_octets(column) -> four columns``."""
    added: dict[str, Column] = {}
    for c in ip_cols:
        for i, octet in enumerate(to_octets(quoted(c)), start=1):
            added[f"{c}_Octet_{i}"] = octet
    return df.withColumns(added)


def mapping_stats(mapping: DataFrame, key: bytes) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("total_ips"),
        F.count_if(F.col("ip") != F.col("anon_ip")).alias("changed_ips"),
    ).withColumn("key_hash", F.lit(key_digest(key)[:16]))


def save_mapping(mapping: DataFrame, path: str, key: bytes) -> None:
    mapping.withColumn("key_hash", F.lit(key_digest(key))).write.mode("overwrite").parquet(path)


def load_mapping(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """Mapping written with the same key; rows of another key are refused."""
    stored = spark.read.parquet(path)
    wrong = stored.filter(F.col("key_hash") != key_digest(key)).limit(1).count()
    if wrong:
        raise ValueError("mapping was written with another key")
    return stored.drop("key_hash")
