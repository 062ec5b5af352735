"""Row-count windows over a stream, per group, in event time.

Rows travel and wait in packs: the reading tasks put the rows of a group that lie in one task together as Arrow data, and
the state of the group holds packs until the watermark has passed their rows. An event-time timer then takes these rows in
order, gives them the group's next positions, sends on the runs of rows from which full windows are cut, and keeps the rows
that the next window shares. No row is a Python object on the way. A batch reads and writes the state of those groups only
that have new rows or a timer that is due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowquarry.operators.columns import number, quoted
from flowquarry.operators.positions import attach, ordered_positions
from flowquarry.operators.windows import window_columns, windows_from_positions
from flowquarry.session import scratch_path, settle
from flowquarry.streaming.state import PROVIDER_CONF, ROCKSDB, read_state

PACK_BYTES = 8 << 20  # of rows that a reading task puts into packs at once
RUN_ROWS = 16_384  # positions that a run of rows starts windows at
CUT_ROWS = 65_536  # rows of the windows in one batch of results
MINUTE = 60_000_000
IPC = pa.ipc.IpcWriteOptions(compression="lz4")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=IPC) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(packs: Iterable) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks()


def _runs(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order that brings equal codes together, and the bounds of each code's run in it."""
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=codes.min(initial=0) - 1))
    return order, list(zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]))


def _pack(n_groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (group columns, row columns) to (group columns, first time, pack)."""
    def by_group(rows: pa.Table) -> pa.RecordBatch:
        codes = np.zeros(len(rows), np.int64)
        for g in range(n_groups):
            values = rows.column(g).combine_chunks().dictionary_encode("encode")
            codes = np.unique(codes * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
        order, runs = _runs(codes)
        rows = rows.take(order).combine_chunks()
        keys = rows.select(range(n_groups)).take([a for a, _ in runs])
        held = rows.select(range(n_groups, rows.num_columns))
        packs = [held.slice(a, b - a) for a, b in runs]
        columns = [pa.array([pc.min(p.column(0)).as_py() for p in packs], pa.int64()), pa.array([_packed(p) for p in packs], pa.binary())]
        names = [*keys.column_names, "_first", "_pack"]
        return pa.RecordBatch.from_arrays([*[_whole(c) for c in keys.columns], *columns], names=names)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield by_group(pa.Table.from_batches(held))
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield by_group(pa.Table.from_batches(held))

    return pack


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


class WindowPlacer(StatefulProcessor):
    """State of one group: packs of ``waiting`` rows by their numbers, how many ``packs`` were numbered, and as ``placed`` the
    next position, the time up to which rows have been placed, and a pack of the last rows that windows still need. It puts
    out the runs of rows to cut windows from."""

    def __init__(self, n_order: int, size: int, step: int, groups: Sequence[str]):
        self.n_order, self.size, self.step, self.groups = n_order, size, step, list(groups)

    def init(self, handle) -> None:
        self.handle = handle
        # a list would be one value, read again for every pack that is added
        self.waiting = handle.getMapState("waiting", "number long", "rows binary")
        self.packs = handle.getValueState("packs", "n long")
        self.placed = handle.getValueState("placed", "next long, time long, tail binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, number = None, self.packs.get()[0] if self.packs.exists() else 0
        for frame in rows:
            # by place: Spark may rename the columns on the way; a time is missing where a pack has none
            for time, pack in zip(frame.iloc[:, -2].tolist(), frame.iloc[:, -1].tolist()):
                self.waiting.updateValue((number,), (bytes(pack),))
                number += 1
                if time == time and time is not None:
                    first = int(time) if first is None else min(first, int(time))
        self.packs.update((number,))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packs = [rows for _, (rows,) in self.waiting.iterator()]
        if not packs:
            return
        waiting = _unpacked(packs)
        done, before, tail = self.placed.get() if self.placed.exists() else (0, None, None)
        due = pc.fill_null(pc.less_equal(waiting["_order_0"], passed), False)
        later = waiting.filter(pc.invert(due))
        first = pc.min(later["_order_0"]).as_py()
        if first is not None:
            self.handle.registerTimer(first // 1000)
        if len(later) == len(waiting):
            return
        self.waiting.clear()
        kept = _by_minute(later)
        for number, rows in enumerate(kept):
            self.waiting.updateValue((number,), (_packed(rows),))
        self.packs.update((len(kept),))
        ready = waiting.filter(due)
        if before is not None:  # rows that came too late for their place
            ready = ready.filter(pc.greater(ready["_order_0"], before))
        order = [(f"_order_{i}", "ascending") for i in range(self.n_order)]
        ready = ready.take(pc.sort_indices(ready, sort_keys=order, null_placement="at_start"))
        rows = _unpacked([tail, _packed(ready)]) if tail else ready.combine_chunks()
        start, end = done - (len(rows) - len(ready)), done + len(ready)
        first, last = -(-max(start, 0) // self.step), (end - self.size) // self.step
        # the next window not yet full is the first whose last row is at or past the next position
        open_from = max(-(-(end - self.size + 1) // self.step), 0) * self.step
        tail = rows.slice(max(open_from - start, 0))
        self.placed.update((end, passed, _packed(tail) if len(tail) else None))
        per_run = max(RUN_ROWS // self.step, 1)
        for window in range(first, last + 1, per_run):
            n = min(per_run, last + 1 - window)
            run = rows.slice(window * self.step - start, (n - 1) * self.step + self.size)
            yield pd.DataFrame({**{g: [k] for g, k in zip(self.groups, key)}, "_window": [window], "_pack": [_packed(run)]})

    def close(self) -> None:
        pass


def _by_minute(rows: pa.Table) -> list[pa.Table]:
    """The rows of each minute, so that no pack grows with the delay of the watermark."""
    if not len(rows):
        return []
    minutes = pc.fill_null(rows["_order_0"], 0).to_numpy() // MINUTE
    order, runs = _runs(minutes)
    rows = rows.take(order)
    return [rows.slice(a, b - a) for a, b in runs]


def _repeated(batch: pa.RecordBatch, n_columns: int, at: int, times: int) -> list[pa.Array]:
    """The values of row ``at`` in the first columns, which stand before the packs, for as many rows."""
    places = np.full(times, at)
    return [c.take(places) for c in batch.columns[:n_columns]]


def _cut(n_groups: int, size: int, step: int, keep: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of rows (group columns, first window, pack) to windows."""
    def cut(batches):
        for batch in batches:
            names = [*batch.schema.names[:n_groups], "window_id", "x", "label", *keep]
            for at in range(batch.num_rows):
                rows = _unpacked([batch.column(n_groups + 1)[at].as_buffer()])
                window, n = batch.column(n_groups)[at].as_py(), (len(rows) - size) // step + 1
                for a in range(0, n, max(CUT_ROWS // size, 1)):
                    ids = np.arange(a, min(a + max(CUT_ROWS // size, 1), n))
                    places = ids[:, None] * step + np.arange(size)
                    bounds = pa.array(np.arange(len(ids) + 1) * size, pa.int32())
                    taken = rows.take(places.ravel())
                    lists = {c: pa.ListArray.from_arrays(bounds, _whole(taken[c])) for c in ["_x", *["_keep_" + c for c in keep]]}
                    yield pa.RecordBatch.from_arrays([
                        *_repeated(batch, n_groups, at, len(ids)), pa.array(window + ids, pa.int64()), lists["_x"], _whole(rows["_label"].take(places[:, -1])),
                        *[lists["_keep_" + c] for c in keep]], names=names)

    return cut


def _spread(n_groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs (group columns, whether a tail, pack) to their rows."""
    def spread(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows = _unpacked([batch.column(n_groups + 1)[at].as_buffer()])
                yield pa.RecordBatch.from_arrays(
                    [*_repeated(batch, n_groups + 1, at, len(rows)), *[_whole(c) for c in rows.columns]],
                    names=[*batch.schema.names[:n_groups + 1], *rows.column_names])

    return spread


def _payload(stream: DataFrame, order: Sequence[str], features: Sequence[str], label: str, groups: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Group columns, and the row as its pack holds it: order columns (the time as microseconds), features, label, kept columns."""
    times = [F.unix_micros(order[0]).alias("_order_0"), *[quoted(c).alias(f"_order_{i}") for i, c in enumerate(order[1:], 1)]]
    return stream.select(
        *[quoted(g) for g in groups], *times, F.array(*[number(stream, c) for c in features]).alias("_x"),
        quoted(label).alias("_label"), *[quoted(c).alias("_keep_" + c) for c in keep])


def count_windows_stream(
    stream: DataFrame, watermark: str, order: Sequence[str], features: Sequence[str], label: str,
    size: int, step: int, group_cols: Sequence[str], keep: Sequence[str] = (),
) -> DataFrame:
    """Stream of (group columns, window_id, x, label, kept columns) of all windows whose rows the watermark has passed.

    ``order`` starts with the event time, a TIMESTAMP, and must be unique per group. Rows later than ``watermark`` are
    dropped once their group has been placed past them.
    """
    spark, groups = stream.sparkSession, list(group_cols)
    if spark.conf.get(PROVIDER_CONF, None) != ROCKSDB:
        raise ValueError("map state and timers need RocksDB: read the stream in a session of state_session()")
    payload = _payload(stream.withWatermark(order[0], watermark), order, features, label, groups, keep)
    keys = [payload.schema[g] for g in groups]
    pack = T.StructField("_pack", T.BinaryType())
    packs = payload.mapInArrow(_pack(len(groups)), T.StructType([*keys, T.StructField("_first", T.LongType()), pack]))
    runs = packs.groupBy(*[quoted(g) for g in groups]).transformWithStateInPandas(
        statefulProcessor=WindowPlacer(len(order), size, step, groups), outputStructType=T.StructType([*keys, T.StructField("_window", T.LongType()), pack]),
        outputMode="Append", timeMode="EventTime")
    return runs.mapInArrow(_cut(len(groups), size, step, keep), T.StructType([
        *keys, T.StructField("window_id", T.LongType()),
        T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("label", payload.schema["_label"].dataType),
        *[T.StructField(c, T.ArrayType(payload.schema["_keep_" + c].dataType)) for c in keep]]))


def open_windows(
    stream: DataFrame, checkpoint: str, order: Sequence[str], features: Sequence[str], label: str,
    size: int, step: int, group_cols: Sequence[str], keep: Sequence[str] = (),
) -> DataFrame:
    """The windows that ``stream`` would still cut if its source ended here, from its state alone."""
    spark, groups = stream.sparkSession, list(group_cols)
    # the single group column of a key struct comes back under the name of the column
    key = [F.col(f"key.`{g}`").alias(g) for g in groups]
    waiting = read_state(spark, checkpoint, "waiting").select(*key, F.lit(False).alias("_from_tail"), F.col("user_map_value.rows").alias("_pack"))
    placed = read_state(spark, checkpoint, "placed")
    tail = placed.filter("value.tail IS NOT NULL").select(*key, F.lit(True).alias("_from_tail"), F.col("value.tail").alias("_pack"))
    next_place = placed.select(*key, F.col("value.next").alias("_next"))
    row = _payload(stream, order, features, label, groups, keep).schema
    kind = T.StructType([*row.fields[:len(groups)], T.StructField("_from_tail", T.BooleanType()), *row.fields[len(groups):]])
    # tail rows end right before the next position; waiting ones follow in order
    held = settle(tail.unionByName(waiting).mapInArrow(_spread(len(groups)), kind), "stream-state")
    placed = ordered_positions(held, [f"_order_{i}" for i in range(len(order))], groups, "_rank")
    tails = held.groupBy(*groups).agg(F.count_if("_from_tail").alias("_tail"))
    starts = tails.join(next_place, groups, "left").select(*groups, (F.coalesce("_next", F.lit(0)) - F.col("_tail")).alias("_start"))
    placed = attach(placed, starts, groups).withColumn("pos", F.col("_start") + F.col("_rank"))
    placed = placed.withColumnsRenamed({"_keep_" + c: c for c in keep})
    return window_columns(windows_from_positions(placed, size, step, ["_x", "_label", *keep], groups), groups, keep)


def run_count_windows(stream: DataFrame, out_path: str, checkpoint: str | None = None, ended: bool = False, **settings) -> DataFrame:
    """Processes all available data and returns the windows cut so far; if the source has ``ended``, also those of the rows that wait."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "count-windows")
    windows = count_windows_stream(stream, **settings)
    query = (
        windows.writeStream.format("parquet").outputMode("append").option("path", out_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    cut = spark.read.schema(windows.schema).parquet(out_path)
    if not ended:
        return cut
    rest = open_windows(stream, checkpoint, **{k: v for k, v in settings.items() if k != "watermark"})
    return cut.unionByName(rest)
