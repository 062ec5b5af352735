from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import sampling

SCHEMA = "row_key long, source string, label string"


def flows(spark, partitions=4):
    rows = [(i, f"day{i % 4}", "BENIGN" if i % 2 else ("odd" if i % 100 == 0 else "flood")) for i in range(2000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def test_class_tables(spark):
    df = flows(spark)
    assert {r["label"]: r["n"] for r in sampling.label_counts(df).collect()} == {"BENIGN": 1000, "odd": 20, "flood": 980}
    dist = {r["label"]: (r["total"], r["files"]) for r in sampling.label_distribution(df).collect()}
    assert dist == {"BENIGN": (1000, 2), "odd": (20, 1), "flood": (980, 2)}
    audit = [(r["label"], r["percent"]) for r in sampling.class_audit(df).collect()]
    assert audit == [("BENIGN", 50.0), ("flood", 49.0), ("odd", 1.0)]
    weights = {r["label"]: r["weight"] for r in sampling.class_weights(df).collect()}
    assert weights["odd"] == pytest.approx(2000 / (3 * 20))


@pytest.mark.parametrize("partitions", [1, 13])
def test_balance_keeps_rare_rows_and_is_the_same_under_any_partitioning(spark, partitions):
    sample = sampling.balance(flows(spark, partitions), 400, 0.5, 79).collect()
    counts = Counter(r["label"] for r in sample)
    assert counts == {"BENIGN": 200, "odd": 20, "flood": 180}  # 2 attack sources, 100 each; all 20 rare rows
    other = sampling.balance(flows(spark, 5), 400, 0.5, 79).collect()
    assert {r["row_key"] for r in sample} == {r["row_key"] for r in other}


def test_balance_needs_both_sides(spark):
    with pytest.raises(ValueError):
        sampling.balance(flows(spark).filter("label = 'BENIGN'"), 100, 0.5, 79)


def test_rare_rows_beyond_the_quota_leave_no_space(spark):
    rows = [(i, "a", "rare") for i in range(7)] + [(100 + i, "b", "common") for i in range(50)]
    rows += [(200 + i, "a", "common") for i in range(50)]
    got = sampling.sample_attacks(spark.createDataFrame(rows, SCHEMA), 20, 79, "row_key").collect()
    # quota 10 per source, threshold 8: 7 rare rows are kept and 3 common ones fill source a.
    assert Counter((r["source"], r["label"]) for r in got) == {("a", "rare"): 7, ("a", "common"): 3, ("b", "common"): 10}


def test_equal_attack_rows_are_kept_once(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "x")]
    got = sampling.sample_attacks(spark.createDataFrame(rows, SCHEMA), 100, 79, "row_key").collect()
    assert sorted(r["row_key"] for r in got) == [1, 2]


def test_oversample_reaches_the_required_count_with_existing_rows(spark):
    df = spark.createDataFrame([(1, "s", "a"), (2, "s", "a"), *[(i, "s", "b") for i in range(10, 20)]], SCHEMA)
    got = sampling.oversample(df, 7, 79, "row_key").collect()
    assert Counter(r["label"] for r in got) == {"a": 7, "b": 10}
    assert {r["row_key"] for r in got if r["label"] == "a"} <= {1, 2}
    assert len({(r["row_key"], r["copy"]) for r in got}) == len(got)


def test_label_quota_sample(spark):
    got = sampling.sample_labels(flows(spark), 30, 79, "row_key").collect()
    # BENIGN and flood occur in 2 sources each: 15 per source; odd in one: min(30, 20).
    assert Counter((r["label"], r["source"]) for r in got) == {
        ("BENIGN", "day1"): 15, ("BENIGN", "day3"): 15, ("flood", "day0"): 15, ("flood", "day2"): 15, ("odd", "day0"): 20}


def test_head_rows(spark):
    got = sampling.head_rows(flows(spark), 3, ["source"], ["row_key"]).collect()
    assert sorted(r["row_key"] for r in got) == sorted([0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11])


@pytest.mark.parametrize("clients", [1, 3, 7])
def test_client_parts_are_near_equal_and_cover_all(spark, clients):
    df = flows(spark).filter("row_key < 101")
    sizes = Counter(r["client"] for r in sampling.client_parts(df, clients, 79, "row_key").collect())
    assert [sizes[c] for c in range(clients)] == [101 // clients + (c < 101 % clients) for c in range(clients)]


def test_label_ordered_clients_hold_contiguous_labels(spark):
    rows = sampling.client_parts(flows(spark), 4, 79, "row_key", "label").collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["client"], set()).add(r["label"])
    assert spans == {0: {"BENIGN"}, 1: {"BENIGN"}, 2: {"flood"}, 3: {"flood", "odd"}}


def test_shuffle_is_a_permutation(spark):
    got = sampling.shuffled(flows(spark).filter(F.col("row_key") < 50), 79, "row_key").collect()
    assert sorted(r["shuffle_pos"] for r in got) == list(range(50))
