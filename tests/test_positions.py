import hashlib

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import positions
from flowquarry.operators.positions import (
    attach,
    first_by_hash,
    hash_positions,
    order_hash,
    ordered_positions,
    row_digest,
    running_totals,
)

# A hot group with a third of the rows, and rows without a group.
ROWS = [("hot" if i % 3 == 0 else None if i % 17 == 1 else f"g{i % 5}", i) for i in range(600)]


def frame(spark, partitions=4):
    df = spark.createDataFrame(ROWS, "g string, i int").repartition(partitions)
    return df.withColumn("h", order_hash(79, "i"))


def by_hash(i):
    return hashlib.md5(f"79|{i}".encode()).hexdigest()


def groups():
    out = {}
    for g, i in ROWS:
        out.setdefault(g, []).append(i)
    return {g: sorted(v, key=by_hash) for g, v in out.items()}


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_hash_positions_number_every_group(spark, partitions):
    rows = hash_positions(frame(spark, partitions), ["g"], ["h", "i"], size="n").collect()
    assert len(rows) == len(ROWS)
    expected = {i: (p, len(v)) for v in groups().values() for p, i in enumerate(v)}
    assert {r["i"]: (r["pos"], r["n"]) for r in rows} == expected


@pytest.mark.parametrize("quota", [0, 1, 7, 100, 10_000])
def test_first_by_hash_takes_the_quota_of_each_group(spark, quota):
    rows = first_by_hash(frame(spark), ["g"], ["h", "i"], quota).collect()
    assert sorted(r["i"] for r in rows) == sorted(i for v in groups().values() for i in v[:quota])


def test_first_by_hash_with_a_quota_per_group(spark):
    quotas = spark.createDataFrame([("hot", 11), ("g1", 0), (None, 2)], "g string, quota int")
    rows = first_by_hash(frame(spark), ["g"], ["h", "i"], quotas).collect()
    wanted = groups()
    assert sorted(r["i"] for r in rows) == sorted(wanted["hot"][:11] + wanted[None][:2])


@pytest.mark.parametrize("partitions", [1, 17])
def test_ordered_positions_follow_the_order(spark, partitions):
    df = frame(spark, partitions).withColumn("t", F.col("i") % 2)  # many equal times
    rows = ordered_positions(df, ["t", "i"]).collect()
    expected = {i: p for p, (_, i) in enumerate(sorted((i % 2, i) for _, i in ROWS))}
    assert {r["i"]: r["pos"] for r in rows} == expected
    assert set(rows[0].asDict()) == {"g", "i", "h", "t", "pos"}


def test_ordered_positions_per_group(spark):
    rows = ordered_positions(frame(spark), ["i"], ["g"]).collect()
    expected = {i: p for v in groups().values() for p, i in enumerate(sorted(v))}
    assert {r["i"]: r["pos"] for r in rows} == expected


def test_running_totals(spark):
    rows = running_totals(frame(spark).withColumn("c", F.lit(2)), ["i"], ["c"], ["g"]).collect()
    expected = {i: 2 * (p + 1) for v in groups().values() for p, i in enumerate(sorted(v))}
    assert {r["i"]: r["upto_c"] for r in rows} == expected


def test_attach_gives_the_same_rows_beyond_the_broadcast_size(spark, monkeypatch):
    dim = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, v int")
    wide = sorted((r["i"], r["v"]) for r in attach(frame(spark), dim, ["g"]).collect())
    left = sorted((r["i"], r["v"] or 0) for r in attach(frame(spark), dim, ["g"], "left").collect())
    monkeypatch.setattr(positions, "BROADCAST_BYTES", 0)
    assert sorted((r["i"], r["v"]) for r in attach(frame(spark), dim, ["g"]).collect()) == wide
    assert sorted((r["i"], r["v"] or 0) for r in attach(frame(spark), dim, ["g"], "left").collect()) == left
    assert len(left) == len(ROWS)
    salted = attach(frame(spark), dim, ["g"])._jdf.queryExecution().toString()
    assert "_salt" in salted


def test_row_digest_tells_null_from_absent(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    digests = [r[0] for r in df.select(row_digest(df)).collect()]
    assert digests[0] == digests[2] != digests[1]
