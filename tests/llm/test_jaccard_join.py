import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowquarry.llm import jaccard_join
from flowquarry.llm.arrays import shingle_set, word_codes
from flowquarry.llm.components import connected_components
from flowquarry.llm.jaccard_join import drop_near_duplicates, near_duplicates, near_pairs, overlaps, signature
from tests.llm.data import WORDS, awkward_texts, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    """(key, set size, smallest reachable key, links) of every row."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    smallest = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return Counter((k, len(sets[i]), smallest[find(i)] if sets[i] else k, links[i]) for i, (k, _) in enumerate(rows))


def near_copies(n, seed=5):
    """Chains and stars of near copies around the threshold, over a small vocabulary."""
    pick, rows = random.Random(seed), []
    seeds = [[pick.choice(WORDS) for _ in range(pick.choice([6, 20, 60]))] for _ in range(8)]
    for i in range(n):
        words = list(pick.choice(seeds))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            words[pick.randrange(len(words))] = pick.choice(WORDS)
        rows.append((i, " ".join(words)))
    return rows


def _found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


def test_awkward_texts(spark):
    rows = awkward_texts()
    assert _found(near_duplicates(frame(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_copies(spark, monkeypatch, small_blocks):
    rows = near_copies(160)
    if small_blocks:  # lists and clusters of several blocks, as in large groups
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)
        monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 6)
    assert _found(near_duplicates(frame(spark, rows))) == brute_force(rows)


def test_one_row_of_each_component_stays(spark):
    rows = near_copies(80) + [(500, None), (501, ""), (3, near_copies(80)[3][1])]
    components = {c for _, n, c, _ in brute_force(rows) if n}
    left = drop_near_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    kept = Counter(r.doc_id for r in left.collect())
    assert kept == Counter([*components, 500, 501])


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    assert drop_near_duplicates(frame(spark, [])).collect() == []


def test_word_codes_over_pieces(monkeypatch):
    from flowquarry.llm import arrays
    text = (" ".join(WORDS * 30) + "  " + "y" * 300 + "\n").encode()
    whole = word_codes(text)
    monkeypatch.setattr(arrays, "PIECE_BYTES", 64)
    assert (word_codes(text) == whole).all()
    assert len(np.unique(whole)) == len({w for w in text.split()})
    assert len(shingle_set(b"one two")) == 1 and len(shingle_set(None)) == 0


def test_overlaps_by_matrix():
    pick = np.random.default_rng(1)
    sets = [np.unique(pick.integers(0, 300, 80, dtype=np.uint64)) for _ in range(12)]
    assert (overlaps(sets, 5) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:5]]).all()


def test_signatures_never_rule_out_a_link():
    pick = np.random.default_rng(2)
    for n in (3, 40, 900, 1100, 2100, 5000):
        base = np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone, new in ((0, 0), (n // 8, 0), (n // 14, n // 14), (0, n // 3)):
            other = np.unique(np.concatenate([base[gone:], pick.integers(0, 1 << 63, new, dtype=np.uint64)]))
            common = len(np.intersect1d(base, other))
            sizes = np.array([len(base), len(other)])
            found = near_pairs(sizes, [signature(base), signature(other)], np.array([True, True]), 2, 75)
            if 100 * common >= 75 * (sizes.sum() - common):
                assert len(found[0]) == 1
        far = np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64))
        if n > 40:
            assert len(near_pairs(np.array([n, n]), [signature(base), signature(far)], np.array([True, True]), 2, 75)[0]) == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 95), (97, 95), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 97: 90}
