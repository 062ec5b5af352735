"""Token ids in directly addressable codes: any token can be read without decoding its neighbours.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those ids that have one, and so on. A bitmap per
level marks the ids that go on in the next level; a rank directory counts the marks
before each block of 512 bits, so the place of an id's next chunk is one directory entry
plus a count inside one block.

A store is a folder of Parquet files. A row is a segment of consecutive documents: the
chunk levels, bitmaps and directories as binary columns, and the documents' ids and
token counts. Segments follow each other by (``part``, ``segment``), and ``start`` is the
number of tokens before a segment, so that token k of the corpus lies in the segment
with ``start <= k < start + n_tokens``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.batches import begin
from flowquarry.llm.tokenizing import word_ids
from flowquarry.session import scratch_path, settle

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 16
TEXTS_AT_ONCE = 1 << 19  # bytes tokenized in one go: their words fit into a processor's cache
ROWS_AT_ONCE = 512  # documents that Spark hands to a worker at once
BYTES_AT_ONCE = 1 << 22  # and their bytes, beyond the last one of them
POSITIONS_AT_ONCE = 1 << 16  # ids read at once
SEGMENTS_AT_ONCE = 16  # segments handed to a worker at once
PAGE = 1 << 16  # bytes of a page, which is compressed by itself: a segment's column or little more
ROW_GROUP = 1 << 24  # bytes of a store's row group, which a task holds as it writes and as it reads

SEGMENT_SCHEMA = (
    "part int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "levels array<binary>, marks array<binary>, ranks array<binary>")


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Bounds the Arrow batches of the jobs inside: by default one holds 10,000 rows, however long their texts are."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES_AT_ONCE)}
    before = {k: spark.conf.get(k, None) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunk levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    levels, marks, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> CHUNK_BITS
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        marks.append(bits + bytes(-len(bits) % (RANK_BITS // 8)))  # whole blocks
        per_block = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.int64) if len(goes_on) else np.zeros(0, np.int64)
        ranks.append((np.cumsum(per_block) - per_block).astype("<u4").tobytes())
        if not goes_on.any():
            return levels, marks, ranks
        rest = rest[goes_on]


def _marks_before(bits: bytes, ranks: bytes, at: np.ndarray) -> np.ndarray:
    """Marks before each position: the directory's entry of its block, and the bits of that one block before it."""
    words = np.frombuffer(bits, "<u8").reshape(-1, RANK_BITS // 64)
    block, inside = at // RANK_BITS, at % RANK_BITS
    # of each word of the block all bits, none, or those below the position
    left = np.clip(inside[:, None] - 64 * np.arange(RANK_BITS // 64), 0, 64).astype(np.uint64)
    kept = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
    return np.frombuffer(ranks, "<u4")[block].astype(np.int64) + np.bitwise_count(words[block] & kept).sum(axis=1, dtype=np.int64)


def dac_access(levels: list[bytes], marks: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The ids at the positions ``at``, each by its own chunks, the bits of one block per level and a directory entry."""
    at = np.asarray(at, dtype=np.int64)
    out = np.zeros(len(at), dtype=np.uint32)
    which = np.arange(len(at))
    for level, (chunk, bits, rank) in enumerate(zip(levels, marks, ranks)):
        out[which] |= np.frombuffer(chunk, np.uint8)[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
        goes_on = (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        at, which = at[goes_on], which[goes_on]
        if not len(at):
            break
        at = _marks_before(bits, rank, at)
    return out


def dac_read(levels: list[bytes], marks: list[bytes], ranks: list[bytes], start: int, n: int) -> np.ndarray:
    """The ``n`` ids from position ``start`` on: on each level one stretch, whose place is one lookup in the directory."""
    out, which = np.zeros(n, dtype=np.uint32), np.arange(n)
    for level, (chunk, bits, rank) in enumerate(zip(levels, marks, ranks)):
        if not len(which):
            break
        end = start + len(which)
        out[which] |= np.frombuffer(chunk, np.uint8)[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
        own = np.unpackbits(np.frombuffer(bits, np.uint8)[start >> 3:(end + 7) >> 3], bitorder="little")
        which = which[own[start & 7:(start & 7) + len(which)] == 1]
        start = int(_marks_before(bits, rank, np.array([start]))[0])
    return out


def dac_decode(levels: list[bytes], marks: list[bytes], ranks: list[bytes]) -> np.ndarray:
    """All ids of a segment in order, front to back."""
    rest = np.zeros(0, np.uint32)
    for chunk, bits in zip(reversed(levels), reversed(marks)):
        chunk = np.frombuffer(chunk, np.uint8)
        ids = chunk.astype(np.uint32)
        if len(rest):
            ids[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(chunk), bitorder="little") == 1] |= rest << np.uint32(CHUNK_BITS)
        rest = ids
    return rest


def _segments(tokenizer: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        words, part, number = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        docs, coded, held = [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), dtype="<u4")
            levels, marks, ranks = dac_encode(ids)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
                "n_tokens": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "doc_tokens": pa.array([[len(c) // 4 for c in coded]], pa.list_(pa.int64())),
                "levels": pa.array([levels], pa.list_(pa.binary())), "marks": pa.array([marks], pa.list_(pa.binary())),
                "ranks": pa.array([ranks], pa.list_(pa.binary()))})

        for batch in batches:
            sizes = np.diff(np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))]))
            first = 0
            while first < len(batch):
                last = first + 1 + int(np.searchsorted(np.cumsum(sizes[first + 1:]), TEXTS_AT_ONCE - sizes[first], side="right"))
                piece = batch.slice(first, last - first)
                for doc, ids in zip(piece["doc_id"].to_pylist(), words.texts(piece["text"].cast(pa.binary()).to_pylist())):
                    docs.append(doc)
                    coded.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SEGMENT_TOKENS:
                        yield segment()
                        number, docs, coded, held = number + 1, [], [], 0
                first = last
        if docs:
            yield segment()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write the store in ascending doc_id order.

    The texts are dealt out by ranges of doc_id and encoded where they are written, since text is
    smaller than ids. A NULL text is empty and has the end id only; a NULL doc_id comes first; equal
    doc_ids are kept, ordered by text. Other columns are not read. An empty table gives an empty store.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    segments = ordered.mapInArrow(_segments(tokenizer, end_id), SEGMENT_SCHEMA)
    with _small_batches(docs.sparkSession, ROWS_AT_ONCE):
        segments.write.option("compression", "zstd").option("parquet.page.size", PAGE).option("parquet.block.size", ROW_GROUP).parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments with ``start``, the number of tokens before each."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    heads = segments.select("part", "segment", "n_tokens")
    # a row per part, of which there are as many as shuffle partitions
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "segment", (F.col("_part_start") + F.col("_inside")).alias("start"))
    return segments.join(starts, ["part", "segment"])


def _checksums(parts: list[list[bytes]], sizes: np.ndarray) -> list[int]:
    """crc32 of the ids of each document of a segment; short documents are read together."""
    out, start, group = [], 0, 0
    ends = np.cumsum(sizes)
    while group < len(sizes):
        last = max(int(np.searchsorted(ends, start + POSITIONS_AT_ONCE, side="right")), group + 1)
        raw = memoryview(dac_read(*parts, start, int(ends[last - 1]) - start).astype("<u4").tobytes())
        for size, end in zip(sizes[group:last].tolist(), (ends[group:last] - start).tolist()):
            out.append(zlib.crc32(raw[4 * (end - size):4 * end]))
        start, group = int(ends[last - 1]), last
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("token documents")
    for batch in batches:
        for row in range(len(batch)):
            one = batch.slice(row, 1)
            parts = [[c.as_buffer() for c in one[name][0].values] for name in ("levels", "marks", "ranks")]
            sizes = np.asarray(one["doc_tokens"][0].as_py(), dtype=np.int64)
            ends = np.cumsum(sizes)
            crcs = _checksums(parts, sizes)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(sizes), one["part"][0].as_py(), np.int32)),
                "segment": pa.array(np.full(len(sizes), one["segment"][0].as_py(), np.int32)),
                "doc_id": one["doc_ids"].flatten(), "offset": pa.array(ends - sizes), "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array(crcs, pa.int64())})


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """A row per document as read back: doc_id, start, n_tokens (end id included), ids_crc32."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    decoded = segments.drop("n_tokens").mapInArrow(
        _documents, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    with _small_batches(spark, SEGMENTS_AT_ONCE):
        docs = settle(decoded, "token-documents")
    starts = read_segments(spark, path).select("part", "segment", "start")
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token_id) of corpus positions (a LONG column ``position``), by random access into their segments.

    Positions outside the corpus and NULLs are left out; repeated ones are answered once each.
    """
    segments = read_segments(spark, path).select("start", "n_tokens", "levels", "marks", "ranks")
    # a segment meets the positions of the few stretches of SEGMENT_TOKENS tokens that it reaches into
    spans = segments.filter("n_tokens > 0").select(
        F.col("start").alias("at"), (F.col("start") + F.col("n_tokens")).alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SEGMENT_TOKENS))).alias("stretch"))
    wanted = positions.select("position", F.floor(F.col("position") / SEGMENT_TOKENS).alias("stretch")).filter("position IS NOT NULL")
    found = wanted.join(spans, "stretch").filter("position >= at AND position < end").select("at", "position")

    def access(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        at = left["position"].to_numpy()
        if not len(right) or not len(at):
            return pa.table({"position": pa.array([], pa.int64()), "token_id": pa.array([], pa.int64())})
        parts = [right[c][0].as_py() for c in ("levels", "marks", "ranks")]
        return pa.table({"position": at, "token_id": dac_access(*parts, at - key[0].as_py()).astype(np.int64)})

    return found.groupBy("at").cogroup(segments.filter("n_tokens > 0").groupBy("start")).applyInArrow(access, "position long, token_id long")


def store_digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new store in the scratch folder and return its documents as read back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_token_store(docs, path, tokenizer, end_id)
    return read_token_store(docs.sparkSession, path)
