import base64
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from flowquarry.llm import warc
from flowquarry.llm.warc import archive_round_trip, capture_index, loser_tree, parse_records, read_captures, sha1_base32, url_key, write_archive

PAGES = [
    (1, "http://A.example.com/x?q=1", "<p>one</p>"), (2, "https://b.example.com:8080/y", "<p>one</p>"), (7, "http://a.example.com/x?q=1", "<p>two</p>\r\n\r\nWARC/1.1\r\n\r\n"),
    (3, None, None), (4, "bad [url", ""), (5, "http://a.example.com/\r\nX: y z", "ü" * 4000), (6, "http://a.example.com/", "ü" * 4000),
    (9, "http://a.example.com/", "y" * 200_000), (None, "http://c.example.org", "<p>one</p>"), (8, "http://c.example.org", "alone"),
] + [(100 + i, "http://hot.example.com/", "same") for i in range(40)]


def _pages(spark, rows):
    full = [(k, u, h, "mine", "x") for k, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, run string, record_type string").repartition(3)


def _expected(rows):
    last = {}
    for k, _, h in rows:
        if k is not None:
            last[h or ""] = max(k, last.get(h or "", k))
    out = []
    for k, _, h in rows:
        raw = (h or "").encode()
        again = last.get(h or "") is not None and last[h or ""] != k
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    return Counter(out)


def test_round_trip(spark):
    found = archive_round_trip(_pages(spark, PAGES)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == _expected(PAGES)
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in found]
    assert keys == sorted(keys)


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "archive"
    write_archive(_pages(spark, PAGES), str(path), records_per_file=7)
    files = sorted(path.glob("part-*"))
    assert len(files) >= len(PAGES) // 7
    seen = Counter()
    for f in files:
        content = f.read_bytes()
        for position, length, headers, block in parse_records(content):
            assert content[position:position + length].endswith(block) and content[position + length:position + length + 4] == b"\r\n\r\n"
            assert "X" not in headers
            seen[headers["WARC-Type"]] += 1
    assert seen == Counter(r[3] for r in _expected(PAGES).elements())
    captures = {(r.page_id, r.run, r.position, r.length) for r in read_captures(spark, str(path)).collect()}
    index = {(r.page_id, r.run, r.position, r.length) for r in capture_index(read_captures(spark, str(path))).collect()}
    assert captures == index and len(index) == len(PAGES)


def test_files_of_large_pages_hold_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORD_BYTES", 1_000)
    rows = [(i, "http://a.example.com/", chr(97 + i % 26) * size) for i, size in enumerate([10] * 40 + [1_500] * 20 + [60_000] * 5 + [1_000, 0, 1_001])]
    path = tmp_path / "archive"
    write_archive(_pages(spark, rows), str(path), records_per_file=8)
    assert max(f.stat().st_size for f in path.rglob("part-*")) < 8 * (1_000 + 600) + 60_000
    found = capture_index(read_captures(spark, str(path))).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == _expected(rows)


def test_empty_table(spark):
    assert archive_round_trip(_pages(spark, [])).collect() == []


def test_loser_tree():
    pick = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((pick.randint(0, 20), i) for _ in range(pick.randint(0, 9))) for i in range(k)]
        merged = list(loser_tree(runs, key=lambda x: x[0]))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: x[0])  # ties: earlier runs first


def test_url_key():
    assert url_key("https://Blog.Example.com:81/a/b?c=d#e") == "com,example,blog:81)/a/b?c=d"
    assert url_key("http://example.com") == "com,example)/" and url_key("") == ")/"


def test_base32(spark):
    values = ["", "a", "ü\n"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", sha1_base32(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in rows} == {v: base64.b32encode(hashlib.sha1(v.encode()).digest()).decode() for v in values}
