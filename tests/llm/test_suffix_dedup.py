import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowquarry.llm import suffix_dedup
from flowquarry.llm.suffix_dedup import LENGTH, adjacent_prefixes, repeated_passages, smaller_than_next, suffix_order
from tests.llm.data import awkward_texts, frame, prose


def brute_force(rows):
    late, first = suffix_dedup.NO_KEY, {}
    raw = [(late if k is None else k, k, (t or "").encode()) for k, t in rows]
    for order, _, t in raw:
        for i in range(len(t) - LENGTH + 1):
            s = t[i:i + LENGTH]
            first[s] = min(order, first.get(s, late))
    out = Counter()
    for order, k, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if first[t[i:i + LENGTH]] < order:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[(k, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def _found(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("batch_bytes", [1 << 12, 8 << 20])
def test_awkward_texts(spark, batch_bytes):
    rows = awkward_texts()
    assert _found(repeated_passages(frame(spark, rows), batch_bytes=batch_bytes)) == brute_force(rows)


def test_long_texts_in_units(spark):
    rows = [(2, prose(61, 60_000)), (1, prose(61, 60_000)[150_001:400_000]), (3, prose(62, 70_000) + prose(61, 200)), (4, "z" * 700_000)]
    assert len(rows[0][1]) > suffix_dedup.UNIT_BYTES
    assert _found(repeated_passages(frame(spark, rows))) == brute_force(rows)


def test_spans_are_the_removed_bytes(spark):
    rows = awkward_texts()
    for r in repeated_passages(frame(spark, rows)).collect():
        assert r.n_spans == len(r.starts) and r.n_removed == sum(e - s for s, e in zip(r.starts, r.ends))


def test_empty_table(spark):
    assert repeated_passages(frame(spark, [])).collect() == []


def test_suffix_order_and_prefixes():
    pick = random.Random(7)
    for trial in range(120):
        data = bytes(pick.choice(b"\0aab\xff") for _ in range(pick.randint(1, 150))) if trial % 2 else (b"abracadabra" * 20)[:trial + 1]
        array = np.frombuffer(data, dtype=np.uint8)
        order = suffix_order(array, depth=1000)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        assert smaller_than_next(array).tolist() == [data[i:] < data[i + 1:] for i in range(len(data))]
        common = adjacent_prefixes(array, order)
        for a, b, n in zip(order, order[1:], common[1:]):
            x, y = data[a:a + LENGTH], data[b:b + LENGTH]
            assert n == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
