"""Texts handed to Python in pieces, so that a task's memory does not grow with what Spark sends at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_ROWS = 256

_kept: list[Callable[[], object]] = []
_work = ""


def keep(drop: Callable[[], object]) -> None:
    """Registers how to drop something that a worker process keeps between tasks."""
    _kept.append(drop)


def begin(work: str) -> None:
    """Called by a task before it starts: if its worker process did other work before, what that has left is given back."""
    global _work
    if work != _work:
        _work = work
        for drop in _kept:
            drop()
        give_back()


def give_back() -> None:
    """Returns memory that is free inside this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batch, rows: int = PIECE_ROWS) -> Iterator:
    """Consecutive slices of an array or record batch; an empty one is its own slice."""
    for at in range(0, max(len(batch), 1), rows):
        yield batch.slice(at, rows)


def text_function(work: str, kind: T.DataType | str, make: Callable[[], Callable[[list[str]], pa.Array]]) -> Callable[[Column], Column]:
    """Column function over texts: ``make()`` gives, once a task, a function from a few texts to an array of results.

    It is called nondeterministic, as a filter on its result would otherwise be pushed below it and run it a second time.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin(work)
        function = make()
        for batch in batches:
            done = [function(piece.to_pylist()) for piece in pieces(batch)]
            yield pa.concat_arrays(done)
            del batch, done
        del function
        give_back()

    return lambda texts: F.arrow_udf(run, kind).asNondeterministic()(texts)


def text_of(row: Column, text: str) -> Column:
    """The text field of a struct, empty for NULL."""
    return F.coalesce(row.getField(text).cast("string"), F.lit(""))
