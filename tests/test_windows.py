import pytest
from pyspark.sql import functions as F

from flowquarry.operators import windows


def frame(spark, n, groups=1):
    rows = [(f"s{i % groups}", (i * 7919) % 101, i, float(i), f"l{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "source string, ts int, key int, v double, label string")


def brute(rows, size, step):
    rows = sorted(rows, key=lambda r: (r["ts"], r["key"]))
    return {
        (start // step): ([r["key"] for r in rows[start:start + size]], rows[start + size - 1]["label"])
        for start in range(0, len(rows) - size + 1, step)}


@pytest.mark.parametrize("n, size, step", [
    (9, 10, 5), (10, 10, 5), (11, 10, 5), (2600, 10, 5), (2600, 50, 10), (2600, 10, 10), (2100, 3, 7), (1500, 700, 3)])
def test_count_windows_equal_brute_force(spark, n, size, step):
    df = frame(spark, n)
    got = windows.count_windows(df, ["ts", "key"], ["v"], "label", size, step, keep=["key"]).collect()
    assert {r["window_id"]: (r["key"], r["label"]) for r in got} == brute(df.collect(), size, step)
    assert len(got) == max(0, (n - size) // step + 1)
    assert all([k for k, in r["x"]] == [float(k) for k in r["key"]] for r in got)


def test_windows_per_group(spark):
    df = frame(spark, 500, groups=3)
    got = windows.count_windows(df, ["ts", "key"], ["v"], "label", 10, 5, ["source"], keep=["key"]).collect()
    rows = df.collect()
    for s in ("s0", "s1", "s2"):
        assert {r["window_id"]: (r["key"], r["label"]) for r in got if r["source"] == s} == brute(
            [r for r in rows if r["source"] == s], 10, 5)


def test_flatten_and_vector(spark):
    flat = windows.flatten_windows(windows.count_windows(frame(spark, 12), ["ts", "key"], ["v", "key"], "label", 4, 4))
    row = windows.to_vector(flat, "flat").orderBy("window_id").first()
    assert len(row["flat"]) == 8 and row["features"].size == 8


def test_time_window_counts(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:04' AS ts, 'a' AS label UNION ALL "
                   "SELECT timestamp_ntz'2024-01-01 00:00:05', 'a' UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:09', 'a'")
    got = windows.time_window_counts(df, "5 seconds").select(F.second("window_start"), "n").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (5, 2)]
