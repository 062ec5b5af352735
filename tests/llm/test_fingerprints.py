import math
from collections import Counter
from hashlib import sha256

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from flowquarry.llm import fingerprints as module
from flowquarry.llm.fingerprints import fingerprint_stability, fingerprints
from tests.llm.data import awkward_texts, frame, prose

SMALL = "/root/testdata/sf0.001"
SIGN, ALL = 1 << 63, (1 << 64) - 1


def _hash(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def _signed(h: int) -> int:
    return h - (1 << 64) if h & SIGN else h


def _codes(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w] or [text]
    return sorted({_hash(w.encode()) >> 2 for w in words})


def _lexicon(texts):
    seen = Counter(c for t in texts for c in _codes(t))
    return {c for c, n in seen.items() if max(2, len(texts) / 2000) <= n <= 0.4 * len(texts)}


def _fingerprint(text, known):
    codes = _codes(text)
    terms = [c for c in codes if c in known]
    terms = terms if len(terms) >= 8 else codes
    level = max(0, math.ceil(math.log(len(terms) / 64.0) / math.log(4.0)))
    hashes = []
    for at in range(level, level + 3):
        subsets = [[] for _ in range(16)]
        for t in terms:
            if t & (4 ** at - 1) == 0:
                subsets[_hash(at.to_bytes(4, "little"), _hash(t.to_bytes(8, "little"))) & 15].append(t)
        for own in subsets:
            h = 42
            for t in own:
                h = _hash(t.to_bytes(8, "little"), h)
            hashes.append(f"{h:016x}"[:8] if own else "-")
    return level, hashes


def _likeness(a, b):
    if a == b:
        return 1.0
    of = lambda f: {(f[0] + i // 16, i % 16): h for i, h in enumerate(f[1])}
    x, y = of(a), of(b)
    pairs = [(x[k], y[k]) for k in x.keys() & y.keys() if x[k] != "-" or y[k] != "-"]
    return sum(p == q for p, q in pairs) / max(len(pairs), 1)


def brute_force(rows):
    order = sorted(((k is None, -(k or 0), _signed(_hash((t or "").encode())), (t or "").encode(), k) for k, t in rows))
    texts = [r[3].decode() for r in order]
    known, out = _lexicon(texts), Counter()
    prints = [_fingerprint(t, known) for t in texts]
    for i, text in enumerate(texts):
        after = (i + 1) % len(texts)
        third = len(text) // 3
        edited = text[:len(text) - third] + texts[after][:third]
        own, changed = prints[i], _fingerprint(edited, known)
        out[(order[i][4], len(text), sha256(edited.encode()).hexdigest(), f"{own[0]} " + " ".join(own[1]), f"{changed[0]} " + " ".join(changed[1]),
             _likeness(own, changed), _likeness(own, prints[after]))] += 1
    return out


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _found(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


@pytest.mark.parametrize("bytes_in_bucket", [32 << 20, 2_000])
def test_equals_brute_force(spark, monkeypatch, bytes_in_bucket):
    monkeypatch.setattr(module, "BUCKET_BYTES", bytes_in_bucket)
    hot = [(7, prose(i, 40)) for i in range(60)]  # one key with many texts is cut by their hash
    for rows in (awkward_texts() + hot, [(3, "only one text here")], [(1, "two"), (9, "texts")], [(None, "x y"), (None, None)]):
        assert _found(fingerprint_stability(frame(spark, rows))) == brute_force(rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = _found(fingerprint_stability(docs))
    assert found == brute_force(rows)
    values = [(r[5], r[6]) for r in found]
    assert sum(a > b for a, b in values) > 0.9 * len(values)


def test_a_large_lexicon_is_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_TERMS", 0)
    rows = awkward_texts()
    assert _found(fingerprint_stability(frame(spark, rows))) == brute_force(rows)


def test_fingerprints_of_rows(spark):
    rows = awkward_texts()
    known = _lexicon([t or "" for _, t in rows])
    found = Counter(tuple(r) for r in fingerprints(frame(spark, rows)).collect())
    prints = [(k, _fingerprint(t or "", known)) for k, t in rows]
    assert found == Counter((k, f"{p[0]} " + " ".join(p[1])) for k, p in prints)


def test_no_rows(spark):
    assert fingerprint_stability(frame(spark, [])).collect() == [] and fingerprints(frame(spark, [])).collect() == []


def test_plan_is_native(spark):
    plan = fingerprint_stability(frame(spark, awkward_texts()).filter(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "InArrow", "InPandas"))
