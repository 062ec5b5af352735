"""Octets, 32-bit values and anonymised addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowquarry.functions.addresses import ip_to_long, key_digest, long_to_ip, octets, seed_key
from flowquarry.operators import privacy
from flowquarry.plans.adapters import flows
from flowquarry.plans.registry import FLOWS, query, with_sql
from flowquarry.session import scratch_path, settle

SEED = 79
KEY = seed_key(SEED)

# Broken addresses as raw files hold them: three parts, an octet over 255, text, the zero address, missing.
BROKEN = """CASE WHEN k = 0 THEN '10.0.0' WHEN k = 1 THEN '10.0.300.' || CAST(user_id AS {text})
  WHEN k = 2 THEN 'a.b.c.d' WHEN k = 3 THEN '0.0.0.0' WHEN k = 4 THEN NULL ELSE src_ip END"""
BROKEN_FLOWS = FLOWS + ",\nbroken AS (SELECT *, " + BROKEN.format(text="VARCHAR") + " AS ip FROM flows)"

NUMBER = """CASE WHEN len(string_split({ip}, '.')) = 4
  AND list_bool_and(list_transform(string_split({ip}, '.'),
        lambda p: COALESCE(TRY_CAST(p AS BIGINT) BETWEEN 0 AND 255, FALSE)))
  THEN CAST(list_sum(list_transform(range(4), lambda i:
        TRY_CAST(string_split({ip}, '.')[i + 1] AS BIGINT) << CAST(24 - 8 * i AS BIGINT))) AS BIGINT) ELSE 0 END"""
DOTTED = "({n} >> 24) || '.' || (({n} >> 16) & 255) || '.' || (({n} >> 8) & 255) || '.' || ({n} & 255)"
ANON = f"""CAST(list_sum(list_transform(range(32), lambda i:
    (xor((n >> (31 - i)) & 1,
         (CAST('0x' || substr(sha256(unhex('{KEY.hex()}' || printf('%08x', (n >> (32 - i)) << (32 - i)))), 1, 8) AS BIGINT)
          >> (31 - i)) & 1)) << (31 - i))) AS BIGINT)"""
MAPPING = f"""ips AS (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows),
numbered AS (SELECT ip, {NUMBER.format(ip="ip")} AS n FROM ips),
changed AS (SELECT ip, n, {ANON} AS a FROM numbered),
mapping AS (SELECT ip, CASE WHEN n = 0 THEN ip ELSE {DOTTED.format(n="a")} END AS anon_ip FROM changed)"""


def _octet(ip: str, i: int) -> str:
    return f"COALESCE(CAST(trunc(TRY_CAST(string_split({ip}, '.')[{i}] AS DOUBLE)) AS INTEGER), 0)"


@query("ip_octets", with_sql([FLOWS], "SELECT row_key, " + ", ".join(
    f'{_octet(ip, i)} AS "{ip}_Octet_{i}"' for ip in ("src_ip", "dst_ip") for i in range(1, 5)) + " FROM flows"))
def ip_octets(spark, sf_dir):
    wide = privacy.with_octets(flows(spark, sf_dir), ["src_ip", "dst_ip"], octets)
    return wide.select("row_key", *[c for c in wide.columns if "_Octet_" in c])


@query("ip_octets_broken", with_sql([BROKEN_FLOWS], "SELECT row_key, " + ", ".join(
    [f"{_octet('ip', i)} AS o{i}" for i in range(1, 5)]
    + [f"CASE WHEN len(string_split(ip, '.')) = 4 THEN {_octet('ip', i)} ELSE 0 END AS strict{i}" for i in range(1, 5)])
    + " FROM broken"))
def ip_octets_broken(spark, sf_dir):
    broken = flows(spark, sf_dir).withColumn("ip", F.expr(BROKEN.format(text="STRING")))
    loose, strict = octets(F.col("ip")), octets(F.col("ip"), strict=True)
    return broken.select(
        "row_key", *[c.alias(f"o{i}") for i, c in enumerate(loose, 1)],
        *[c.alias(f"strict{i}") for i, c in enumerate(strict, 1)])


@query("ip_to_int_roundtrip", with_sql([BROKEN_FLOWS], f"""
SELECT row_key, n, {DOTTED.format(n="n")} AS back FROM (SELECT row_key, {NUMBER.format(ip="ip")} AS n FROM broken)"""))
def ip_to_int_roundtrip(spark, sf_dir):
    broken = flows(spark, sf_dir).withColumn("ip", F.expr(BROKEN.format(text="STRING")))
    numbered = broken.select("row_key", ip_to_long(F.col("ip")).alias("n"))
    return numbered.withColumn("back", long_to_ip(F.col("n")))


@query("ip_mapping", with_sql([FLOWS, MAPPING], "SELECT ip, anon_ip FROM mapping"))
def ip_mapping(spark, sf_dir):
    return privacy.ip_mapping(flows(spark, sf_dir), ["src_ip", "dst_ip"], KEY)


@query("ip_anonymize", with_sql([FLOWS, MAPPING], """
SELECT row_key, s.anon_ip AS src_ip, d.anon_ip AS dst_ip FROM flows
JOIN mapping s ON s.ip = src_ip JOIN mapping d ON d.ip = dst_ip"""))
def ip_anonymize(spark, sf_dir):
    return privacy.anonymize(flows(spark, sf_dir), ["src_ip", "dst_ip"], KEY).select("row_key", "src_ip", "dst_ip")


@query("ip_deanonymize", with_sql([FLOWS], """
SELECT row_key, src_ip AS restored FROM flows"""))
def ip_deanonymize(spark, sf_dir):
    df = flows(spark, sf_dir).select("row_key", "src_ip")
    mapping = settle(privacy.ip_mapping(df, ["src_ip"], KEY))
    hidden = privacy.anonymize(df, ["src_ip"], KEY)
    return privacy.deanonymize(hidden, "src_ip", mapping, "restored").select("row_key", "restored")


ALIASES = "CASE WHEN k % 3 = 0 THEN replace(src_ip, '.', '.0') WHEN k = 1 THEN '0.0.0.0' WHEN k = 2 THEN 'no address' ELSE src_ip END"


@query("ip_alias_roundtrip", with_sql([FLOWS], """
SELECT row_key, CASE WHEN k = 1 THEN '0.0.0.0' WHEN k = 2 THEN 'no address' ELSE src_ip END AS restored FROM flows"""))
def ip_alias_roundtrip(spark, sf_dir):
    """Addresses in several spellings, the zero address and texts come back as one row each, in one spelling."""
    df = flows(spark, sf_dir).select("row_key", F.expr(ALIASES).alias("ip"))
    mapping = settle(privacy.ip_mapping(df, ["ip"], KEY))
    return privacy.deanonymize(privacy.anonymize(df, ["ip"], KEY), "ip", mapping, "restored").select("row_key", "restored")


@query("ip_stats", with_sql([FLOWS, MAPPING], f"""
SELECT count(*) AS total_ips, count(*) FILTER (ip <> anon_ip) AS changed_ips,
       '{key_digest(KEY)[:16]}' AS key_hash FROM mapping"""))
def ip_stats(spark, sf_dir):
    path = scratch_path(spark, "ip-map")
    privacy.save_mapping(privacy.ip_mapping(flows(spark, sf_dir), ["src_ip", "dst_ip"], KEY), path, KEY)
    return privacy.mapping_stats(privacy.load_mapping(spark, path, KEY), KEY)
