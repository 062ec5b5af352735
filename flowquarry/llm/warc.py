"""Web archives: records written once per payload, and a merged index of what was captured when.

Writing. Of pages with equal payloads the one with the largest id becomes a response record, the others
revisit it. A record is header, blank line, block and two line ends; the text sink writes them one after
the other, so a part file is a plain WARC file. A block is an HTTP head and, for responses, the payload.

Reading. A task walks through a file by the records' Content-Length and reports a capture per record: where
it lies, its URL key, time, payload size and digest.

Index. The captures of a file, sorted there, are a run. The runs are dealt out by ranges of (URL key, time, id),
and each range merges its pieces of the runs by a tournament of losers, so the ranges one after the other are
the capture histories of all URLs in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.session import scratch_path, settle

RECORD_END = "\r\n\r\n"
RECORDS_PER_FILE = 1_000
RECORD_BYTES = 1 << 20  # files of larger records hold the fewer of them, so that none grows beyond what a reader takes
MIN_BYTES = 0  # payloads of fewer bytes are always responses
# Digits of the two base-32 notations.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(_key, _digest, refers_to) of the pages whose payload a page with a larger id has.

    Payloads are told apart by SHA-256, since different ones of the same length and SHA-1 are known.
    """
    whole = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    digests = pages.select(
        F.col(f"`{key}`").cast("long").alias("_key"), F.sha2(whole, 256).alias("_digest"), F.octet_length(whole).alias("_bytes"))
    digests = settle(digests.filter(F.col("_bytes") >= min_bytes), "digests")
    last = digests.groupBy("_digest", "_bytes").agg(F.max("_key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return settle(
        digests.join(settle(last, "last"), ["_digest", "_bytes"]).filter(F.col("refers_to").isNotNull() & ~F.col("_key").eqNullSafe(F.col("refers_to")))
        .select("_key", "_digest", "refers_to").distinct(), "revisits")


def _header(value: Column) -> Column:
    """Text that cannot end a header line."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(value, class): one WARC record per page as text, without its end, and the class of its size.

    A NULL payload is empty; a NULL url has no target line; a NULL key is written as ``none``. The capture time is
    derived from the key, as the pages have none. Pages that repeat key and payload are written each.
    """
    whole = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), whole.alias("payload"),
        sha1_base32(whole).alias("digest"), F.sha2(whole, 256).alias("identity"), F.octet_length(whole).alias("bytes"))
    again = revisits(pages, key, payload, min_bytes)
    same = rows["key"].eqNullSafe(again["_key"]) & (rows["identity"] == again["_digest"])
    rows = rows.join(again, same, "left")
    urn = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("none")), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.pmod("key", F.lit(100_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("key")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), _header(F.col("url")))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Date: "), time, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return rows.select(F.concat(lines, block).alias("value"), _size_class(F.col("payload")).alias("class"))


def _size_class(payload: Column) -> Column:
    """0 up to RECORD_BYTES, and one more for each doubling."""
    size = F.greatest(F.octet_length(payload), F.lit(1)).cast("double")
    return F.greatest(F.ceil(F.log2(size / RECORD_BYTES)), F.lit(0)).cast("int")


def write_archive(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, key: str = "page_id", url: str = "url",
                  payload: str = "html") -> None:
    """Write the pages as WARC files of at most ``records_per_file`` records and about as many MB, which bounds what a reader holds.

    Pages are written by classes of size; ordinary ones need a single class.
    """
    column = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    classes = sorted(r[0] for r in pages.select(_size_class(column).alias("c")).distinct().collect()) or [0]  # about 30 at most
    lines = records(pages, key, url, payload)
    for c in classes:
        own = lines if len(classes) == 1 else lines.filter(F.col("class") == c)
        own.select("value").write.mode("append").option("lineSep", RECORD_END).option(
            "maxRecordsPerFile", max(records_per_file >> c, 1)).text(path if c == 0 else f"{path}/large-{c}")


def url_key(url: str) -> str:
    """Host names reversed, then the rest, so that the pages of a site sort together."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    port = f":{parts.netloc.rpartition(':')[2]}" if parts.netloc.rpartition(":")[2].isdigit() and ":" in parts.netloc else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


CAPTURE = ("run string, url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, position long, length long")


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(position, length, headers, block) of the records of a file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, end + 4 + size - at, headers, content[end + 4:end + 4 + size]
        at = end + 4 + size + len(RECORD_END)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            run, found = batch["path"][row].as_py().rpartition("/")[2], []
            for position, length, headers, block in parse_records(batch["content"][row].as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":  # what was read counts, not what the header says
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                found.append((url_key(headers.get("WARC-Target-URI", "")), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), headers["WARC-Type"],
                              size, digest, _page(headers.get("WARC-Refers-To")), position, length))
            found.sort(key=lambda c: (c[0], c[1], c[2] is not None, c[2] or 0))  # a run
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([run] * len(found), pa.string()), *[pa.array([c[i] for c in found], k) for i, k in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CAPTURE.split(", ")])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all files below ``path``; each file's are sorted and form a run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_captures, CAPTURE)


def loser_tree(runs: Sequence[Sequence], key: Callable) -> Iterator:
    """Items of sorted runs in order, log2(k) comparisons each; of equal items those of earlier runs come first.

    An inner node keeps the loser of its match; the winner moves up. After the overall winner is taken, only the
    matches on the way up from its leaf are played again.
    """
    k = len(runs)
    if not k:
        return
    heads = [0] * k

    def value(i: int) -> tuple:
        return (0, key(runs[i][heads[i]]), i) if heads[i] < len(runs[i]) else (1,)  # an exhausted run loses

    values = [value(i) for i in range(k)]
    winners, losers = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if values[a] <= values[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while values[best][0] == 0:
        yield runs[best][heads[best]]
        heads[best] += 1
        values[best] = value(best)
        node = (best + k) // 2
        while node:
            if values[losers[node]] < values[best]:
                losers[node], best = best, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, which come run after run, in order of (url_key, captured, page_id)."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    names = table["run"].to_pylist()
    keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [(p is not None, p or 0) for p in table["page_id"].to_pylist()]))
    cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    order = list(loser_tree([range(a, b) for a, b in zip(cuts, cuts[1:])], key=keys.__getitem__))
    yield from table.take(pa.array(order)).to_batches(max_chunksize=10_000)


def capture_index(captures: DataFrame) -> DataFrame:
    """The captures of all runs in order of (url_key, captured, page_id), range after range.

    Keys hold the page id, so the captures of one hot URL are dealt over several ranges. Times and ids that
    repeat come in the order of their runs.
    """
    order = ["url_key", "captured", "page_id"]
    runs = settle(captures, "runs")
    return runs.repartitionByRange(*order).sortWithinPartitions("run", *order).mapInArrow(_merge, CAPTURE)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as an archive in the scratch folder, read it back and return its merged index.

    An empty table gives no captures. Columns besides key, url and payload are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "archive")
    write_archive(pages, path, key=key, url=url, payload=payload)
    return capture_index(read_captures(spark, path))
