import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import windows
from flowquarry.streaming import count_windows, monitors
from flowquarry.streaming.state import read_state, state_session

SCHEMA = "ts timestamp, key int, source string, v double, label string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(first, n, minutes=1, groups=2):
    return [(START + dt.timedelta(minutes=minutes * i), i, f"s{i % groups}", float(i), "BENIGN" if i % 2 else "dos")
            for i in range(first, first + n)]


def write(spark, data, folder, name):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return monitors.read_parquet_stream(spark, f"{folder}/batch*", spark.createDataFrame([], SCHEMA).schema)


SETTINGS = dict(order=["ts", "key"], features=["v"], label="label", size=5, step=2, group_cols=["source"], keep=["key"])


def as_set(df):
    return {(r["source"], r["window_id"], tuple(r["key"]), tuple(map(tuple, r["x"])), r["label"]) for r in df.collect()}


def test_windows_over_several_batches_equal_one_batch(spark, tmp_path):
    """Rows come out of order, within the watermark, in batches that lack some sources."""
    session = state_session(spark)
    whole, out, state = rows(0, 150, groups=3), str(tmp_path / "out"), str(tmp_path / "state")
    pick = random.Random(3)
    late = {r[1]: r[1] + pick.choice([0, 0, 0, 9]) for r in whole}  # arrival: up to nine minutes late
    for i, (a, b) in enumerate(((0, 40), (40, 41), (41, 100), (100, 200))):
        arrived = [r for r in whole if a <= late[r[1]] < b]
        pick.shuffle(arrived)
        write(spark, arrived, tmp_path, f"batch{i}")
        got = count_windows.run_count_windows(stream(session, tmp_path), out, state, watermark="10 minutes", ended=i == 3, **SETTINGS)
    table = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/batch*")
    expected = windows.count_windows(table, **SETTINGS)
    assert as_set(got) == as_set(expected) and got.count() == expected.count() == 3 * 23


def test_windows_wait_for_the_watermark(spark, tmp_path):
    session = state_session(spark)
    write(spark, rows(0, 60, groups=1), tmp_path, "batch0")
    got = count_windows.run_count_windows(
        stream(session, tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), watermark="10 minutes", **SETTINGS)
    # the watermark is 00:49, so rows 0 to 49 are placed
    assert sorted(r["window_id"] for r in got.collect()) == list(range(23))
    state = read_state(spark, str(tmp_path / "state"), "waiting")
    assert state.count() == 10


def test_steps_longer_than_windows(spark, tmp_path):
    session, settings = state_session(spark), {**SETTINGS, "size": 3, "step": 7}
    for i in range(3):
        write(spark, rows(i * 20, 20, groups=2), tmp_path, f"batch{i}")
        got = count_windows.run_count_windows(
            stream(session, tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), watermark="1 minute", ended=i == 2, **settings)
    table = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/batch*")
    assert as_set(got) == as_set(windows.count_windows(table, **settings)) and got.count() > 0


def test_large_groups_wait_in_packs(spark, tmp_path):
    """One group of many rows, in two files and mixed order, with NULLs; its state grows with packs, not with rows."""
    session = state_session(spark)
    whole = [(START + dt.timedelta(seconds=i), None if i % 7 == 0 and i > 20_000 else i, "s0", None if i % 5 == 0 else i / 4, None if i % 3 == 0 else "dos")
             for i in range(20_500)]
    random.Random(5).shuffle(whole)
    for i in range(2):
        write(spark, whole[i::2], tmp_path, f"batch{i}")
    settings = {**SETTINGS, "order": ["ts"]}
    got = count_windows.run_count_windows(
        stream(session, tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), watermark="10 minutes", ended=True, **settings)
    assert read_state(session, str(tmp_path / "state"), "waiting").count() <= 11  # 600 rows of ten minutes wait
    expected = windows.count_windows(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/batch*"), **settings)
    assert as_set(got) == as_set(expected) and got.count() == expected.count() == 10_248


def test_rows_behind_placed_ones_are_dropped(spark, tmp_path):
    session, settings = state_session(spark), dict(watermark="10 minutes", **SETTINGS)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write(spark, rows(0, 60, groups=1), tmp_path, "batch0")
    count_windows.run_count_windows(stream(session, tmp_path), out, state, **settings)
    late = [(START + dt.timedelta(seconds=30), 999, "s0", 1.0, "dos")]
    write(spark, late + rows(60, 20, groups=1), tmp_path, "batch1")
    got = count_windows.run_count_windows(stream(session, tmp_path), out, state, ended=True, **settings)
    expected = windows.count_windows(spark.createDataFrame(rows(0, 80, groups=1), SCHEMA), **SETTINGS)
    assert as_set(got) == as_set(expected) and got.count() == expected.count()


def test_packs_keep_groups_and_windows_apart(monkeypatch):
    monkeypatch.setattr(count_windows, "CUT_ROWS", 40)
    given = pa.table({"a": ["x", None, "x", "y"] * 25, "b": [1, 1, 2, None] * 25, "_order_0": pa.array(range(100), pa.int64())})
    packs = pa.Table.from_batches(count_windows._pack(2)(iter(given.to_batches(max_chunksize=30))))
    found = {(r["a"], r["b"]): (r["_first"], count_windows._unpacked([r["_pack"]])["_order_0"].to_pylist()) for r in packs.to_pylist()}
    assert found == {key: (i, list(range(i, 100, 4))) for i, key in enumerate([("x", 1), (None, 1), ("x", 2), ("y", None)])}
    run = pa.table({"_x": [[float(i)] for i in range(103)], "_label": [str(i) for i in range(103)]})
    runs = pa.record_batch({"g": ["a"], "_window": pa.array([7], pa.int64()), "_pack": [count_windows._packed(run)]})
    cut = [r for batch in count_windows._cut(1, 10, 5, [])(iter([runs])) for r in batch.to_pylist()]
    assert cut == [{"g": "a", "window_id": 7 + w, "x": [[float(i)] for i in range(5 * w, 5 * w + 10)], "label": str(5 * w + 9)} for w in range(19)]


def test_a_session_without_rocksdb_is_refused(spark, tmp_path):
    write(spark, rows(0, 5), tmp_path, "batch0")
    with pytest.raises(ValueError, match="RocksDB"):
        count_windows.count_windows_stream(stream(spark, tmp_path), "1 minute", **SETTINGS)


def test_label_counts_and_late_rows(spark, tmp_path):
    write(spark, rows(0, 60), tmp_path, "batch0")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    counts = lambda: monitors.run_to_table(
        monitors.label_counts_stream(stream(spark, tmp_path), "10 minutes", "5 minutes"), out, state)
    first = {(r["window_start"].minute, r["label"]): r["n"] for r in counts().collect()}
    # The watermark is 00:54: five windows are closed.
    assert first == {(m, label): 5 for m in (0, 10, 20, 30, 40) for label in ("BENIGN", "dos")}
    late = [(START, 999, "s0", 1.0, "dos")]
    write(spark, late + rows(60, 10), tmp_path, "batch1")
    second = {(r["window_start"].hour, r["window_start"].minute, r["label"]): r["n"] for r in counts().collect()}
    assert second[(0, 0, "dos")] == 5 and second[(0, 50, "dos")] == 5 and len(second) == 12


def test_detection_stream(spark, tmp_path):
    write(spark, rows(0, 40), tmp_path, "batch0")
    flagged = stream(spark, tmp_path).withColumn("predicted", F.when(F.col("key") % 4 == 0, "dos").otherwise("BENIGN"))
    got = monitors.run_to_table(
        monitors.detection_stream(flagged, "20 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r["tp"], r["fn"], r["tn"], r["fp"], r["detection_rate"]) for r in got] == [(5, 5, 10, 0, 0.5)]


def test_a_source_that_has_ended_leaves_no_window_open(spark, tmp_path):
    write(spark, rows(0, 60), tmp_path, "batch0")
    got = monitors.run_bounded(
        monitors.label_counts_stream(stream(spark, tmp_path), "10 minutes", "5 minutes"), ["n"], str(tmp_path / "out"), str(tmp_path / "state"))
    plan = got._jdf.queryExecution().toString()
    assert "batch0" not in plan  # the source is not read again
    assert {(r["window_start"].minute, r["label"]): r["n"] for r in got.collect()} == {
        (m, label): 5 for m in range(0, 60, 10) for label in ("BENIGN", "dos")}
