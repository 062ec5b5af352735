import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from flowquarry.llm import periodic_runs as module
from flowquarry.llm.periodic_runs import periodic_runs, runs_of, without_repeats
from flowquarry.llm.queries import op13_periodic_runs, with_planted_runs
from tests.llm.data import awkward_texts, frame

SMALL = "/root/testdata/sf0.001"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(w):
    """(start, length, period) of every run, by comparing the words under every period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_runs_equal_brute_force(monkeypatch):
    pick = random.Random(1)
    for case in range(600):
        monkeypatch.setattr(module, "BATCH_WORDS", pick.choice([1, 40, 1 << 17]))
        texts = []
        for _ in range(pick.randint(1, 6)):
            kinds, n = pick.choice([1, 2, 2, 3, 10]), pick.choice([0, 1, 3, 8, 20, 60])
            w = [b"%d" % pick.randrange(kinds) for _ in range(n)]
            if w and pick.random() < 0.5:
                a = pick.randrange(n)
                p = 1 + (n - a) // pick.randint(3, 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        found = list(runs_of(texts))
        assert [[tuple(map(int, r)) for r in runs] for runs in found] == [brute_force(w) for w in texts]
        assert [without_repeats(w, r) for w, r in zip(texts, found)] == [collapsed(w, brute_force(w)) for w in texts]


def test_other_limits():
    w = [b"a", b"b"] * 3 + [b"c"] * 3
    assert [tuple(map(int, r)) for r in next(runs_of([w], least_words=2, least_periods=2))] == [(0, 6, 2), (6, 3, 1)]


def test_long_texts():
    once, twice = [b"w"] * 50_000, [b"a", b"b", b"c"] * 20_000
    one, two = runs_of([once, twice])
    assert one.tolist() == [[0, 50_000, 1]] and two.tolist() == [[0, 60_000, 3]]


def test_rows_and_awkward_texts(spark):
    rows = awkward_texts() + [(60, "la " * 9), (60, "la " * 9), (61, "x\x0by " * 5 + "z"), (62, "A a " * 8), (None, "no " * 7)]
    found = periodic_runs(frame(spark, rows)).collect()
    expected = Counter()
    for k, t in rows:
        w = _words(t)
        runs = brute_force(w) if len(w) < 1_000 else []
        expected[k, len(w), tuple(runs), " ".join(collapsed(w, runs))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed_text) for r in found) == expected
    assert periodic_runs(frame(spark, [])).collect() == []


def _digests(k, t):
    w = planted(k, _words(t))
    runs = brute_force(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (k, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha256(lines.encode()).hexdigest(), sha256(" ".join(collapsed(w, runs)).encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    small = [(k, t) for k, t in docs if len(_words(t)) < 3_000]
    found = {r.doc_id: r for r in op13_periodic_runs(spark, SMALL).collect()}
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert len(found) == len(docs) and len(small) > 0.9 * len(docs)
    rows = [tuple(found[k][n] for n in names) for k, _ in small]
    assert rows == [_digests(k, t) for k, t in small] and sum(r[1] > 0 for r in rows) > 10


def test_planting(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(200)] + [(-7, "a b c d"), (None, "a b c"), (3, None), (5, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, tuple(_words(r.text))) for r in with_planted_runs(docs).collect())
    assert found == Counter((k, tuple(planted(k, _words(t)))) for k, t in rows)
