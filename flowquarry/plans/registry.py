"""Registry of queries over the given tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounds result columns, as sums of doubles differ in the last bits with their order."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def with_sql(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# The adapters of plans/adapters.py in SQL.
FLOWS = """flows AS (
  SELECT event_id AS row_key, ts, strftime(ts, '%Y-%m-%d') AS source,
         '10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS src_ip,
         '192.168.' || ((event_id // 256) % 256) || '.' || (event_id % 256) AS dst_ip,
         value, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, props,
         CASE WHEN event_type = 'view' THEN 'BENIGN'
              WHEN event_type = 'error' AND value > 200 THEN 'rare' ELSE event_type END AS label
  FROM events)"""

LINES = """lines AS (
  SELECT *, CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag END AS label,
         l_returnflag <> 'N' AS is_attack
  FROM lineitem)"""

LINE_FEATURE_NAMES = (
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey")

LINE_LONG = "line_long AS (\n" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, label, is_attack FROM lines" for c in LINE_FEATURE_NAMES) + ")"

VECTORS = """vectors AS (
  SELECT vec_id AS id, label AS label_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
coords AS (
  SELECT id, label_id, unnest(x) AS v, unnest(range(len(x))) AS pos FROM vectors)"""

PREDICTIONS = VECTORS + """,
means AS MATERIALIZED (SELECT label_id AS c, pos, round(avg(v), 9) AS m FROM coords GROUP BY label_id, pos),
distances AS MATERIALIZED (
  SELECT id, label_id AS y_true, c, round(sum((v - m) * (v - m)) / 64, 9) AS d FROM coords JOIN means USING (pos) GROUP BY id, label_id, c),
powers AS MATERIALIZED (SELECT id, y_true, list(d ORDER BY c) AS d, list(exp(-d) ORDER BY c) AS p FROM distances GROUP BY id, y_true),
predictions AS MATERIALIZED (
  SELECT id, y_true, list_transform(p, lambda v: round(v / list_sum(p), 9)) AS proba,
         CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS y_pred FROM powers)"""

UPDATES = VECTORS + """,
updates AS (
  SELECT 1 AS round, label_id AS client, pos, 0.0::DOUBLE AS w0, avg(v) AS w1 FROM coords GROUP BY label_id, pos)"""


def hash_order(seed: int, *keys: str) -> str:
    """SQL for the seeded order key."""
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || {k}" for k in keys) + ")"
