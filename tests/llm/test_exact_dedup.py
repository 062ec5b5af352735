import hashlib
import re
from collections import Counter

from flowquarry.llm.exact_dedup import exact_groups
from tests.llm.data import awkward_texts, frame


def _expected(rows):
    clean = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for k, t in rows]
    least, size = {}, Counter(c for _, c in clean)
    for k, c in clean:
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return Counter((k, least.get(c), size[c], hashlib.sha256(c.encode()).hexdigest()) for k, c in clean), len(size)


def test_groups_equal_brute_force(spark):
    rows = awkward_texts()
    expected, distinct = _expected(rows)
    # small blocks: many levels; large ones: a single one
    for block_bytes in (7, 64, 1 << 20):
        found = exact_groups(frame(spark, rows), block_bytes=block_bytes).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
        assert sum(r.kept for r in found) == distinct
        assert all(r.keep_id == r.doc_id for r in found if r.kept)


def test_empty_table(spark):
    assert exact_groups(frame(spark, [])).collect() == []
