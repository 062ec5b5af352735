import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import hard_negatives as module
from flowquarry.llm.hard_negatives import Anchors, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label long, score long, rank string, _vector int, _id string"


def brute_force(rows, n_positives=5, n_negatives=5):
    """What the query returns, from all pairs of an anchor and a row."""
    kept = []
    for k, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 19 for x in v):
            continue
        kept.append((k, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = Counter()
    for k, v, label in {(k, tuple(v), label) for k, v, label in kept if k is not None and k % 100 == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i, own) for i, w, own in kept if i != k), key=lambda s: s[:2])
        positives = [s for s in scored if s[2] == label][:n_positives]
        for top, p, _ in positives:
            fits = [s for s in scored if s[2] != label and 80 * -top <= 100 * -s[0] <= 100 * -top][:n_negatives]
            for rank, (score, i, _) in enumerate(fits, 1):
                out[k, None if p == math.inf else p, rank, None if i == math.inf else i, -top, -score] += 1
    return out


def _rows(seed, n, width=8, labels=3, spread=1.0):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i * 25, [spread * pick.gauss(0, 0.5) + c for c in centres[i % labels]], i % labels) for i in range(n)]


def _found(spark, rows, **settings):
    table = spark.createDataFrame([(k, v, c, 1, "r", 2, "i") for k, v, c in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hard_negatives(table, F.col("vec_id") % 100 == 0, **settings).collect())


AWKWARD = [
    (None, [1.0] * 8, 0), (None, [1.0] * 8, 1), (100, [1.0] * 8, None), (200, None, 1), (300, [1.0, None] * 4, 1), (400, [math.nan] * 8, 1),
    (500, [math.inf] * 8, 1), (600, [0.0] * 8, 1), (601, [0.0] * 8, 2), (700, [], 1), (800, [1.0, 2.0], 2), (900, [1.0] * 20, 0),
    (1000, [1e6] * 8, 0), (1100, [-1.0] * 8, 0), (1200, [500_000.0] * 8, 1), (1201, [-500_000.0] * 8, 1), (1202, [400_000.0] * 8, 2),
]


@pytest.mark.parametrize("wave", [8_192, 3])
def test_equals_brute_force(spark, monkeypatch, wave):
    monkeypatch.setattr(module, "WAVE", wave)
    several = 0
    for rows in (_rows(1, 200), _rows(2, 60, spread=0.1) + AWKWARD, _rows(3, 40) * 3, [(i * 50, [1.0, 2.0], i % 2) for i in range(40)]):
        found = _found(spark, rows)
        assert found == brute_force(rows)
        several += bool(found)
    assert several > 2


def test_other_sizes(spark):
    rows = _rows(5, 80)
    assert _found(spark, rows, positives=2, negatives=9) == brute_force(rows, 2, 9)


def test_lists_lose_nothing_and_spare_work(monkeypatch):
    monkeypatch.setattr(module, "BUCKET_ROWS", 64)
    pick = np.random.default_rng(7)
    centres = pick.normal(0, 300, (40, 16))
    labels = np.arange(2_000) % 40
    vectors = (centres[labels] + pick.normal(0, 25, (2_000, 16))).astype(np.int64)
    batch = pa.RecordBatch.from_pydict({
        "_id": pa.array(np.arange(2_000)), "_label": pa.array(labels), "_vector": pa.array(vectors.tolist(), pa.list_(pa.int64()))})
    anchors = Anchors(np.arange(10), labels[:10], vectors[:10])
    looked, scores = 0, module.Bucket.scores

    def counted(self, rows, anchor):
        nonlocal looked
        looked += len(self.ids) if rows is None else len(rows)
        return scores(self, rows, anchor)

    monkeypatch.setattr(module.Bucket, "scores", counted)
    out = next(module._positives(SimpleNamespace(value=anchors), 5)(iter([batch]))).to_pydict()
    for i in range(10):
        all_scores = vectors @ vectors[i]
        own = [j for j in np.lexsort((np.arange(2_000), -all_scores)) if labels[j] == labels[i] and j != i][:5]
        assert [k for a, k in zip(out["anchor"], out["id"]) if a == i] == own
    assert looked < 0.6 * 10 * 2_000  # the others were ruled out by their lists or lengths


def test_no_rows(spark):
    assert not _found(spark, []) and not _found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) and not _found(spark, [(100, [1.0], 1)])
