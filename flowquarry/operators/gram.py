"""Sums of products of all column pairs, block by block: no table of columns x columns passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.columns import number
from flowquarry.session import settle

BLOCK = 64  # columns of a block
GROUP_CELLS = 1 << 22  # cells that a task adds up at once (32 MB); wider tables are read once per group of blocks
TASKS = 64  # partial sums per cell that are shuffled, at most


def _block_pairs(d: int, block: int) -> list[tuple[int, int]]:
    blocks = -(-d // block)
    return [(i, j) for i in range(blocks) for j in range(i, blocks)]


def _partial(pairs: Sequence[tuple[int, int]], block: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) - centre
            for i, j in pairs:
                product = x[:, i * block:(i + 1) * block].T @ x[:, j * block:(j + 1) * block]
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        for (i, j), cells in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([cells.ravel()], pa.list_(pa.float64()))], ["bi", "bj", "cells"])

    return run


def _added(d: int, block: int):
    """Sums of the partial blocks of a partition, which holds all of a pair of blocks, as cells i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        total = np.zeros(0)

        def cells() -> pa.RecordBatch:
            wide = min(block, d - held[1] * block)
            i, j = np.divmod(np.arange(len(total)), wide)
            i, j = i + held[0] * block, j + held[1] * block
            upper = i <= j
            return pa.RecordBatch.from_pydict({
                "i": i[upper].astype(np.int32), "j": j[upper].astype(np.int32), "value": total[upper]})

        for batch in batches:  # sorted by pair of blocks
            for bi, bj, values in zip(batch["bi"].to_pylist(), batch["bj"].to_pylist(), batch["cells"]):
                part = values.values.to_numpy(zero_copy_only=False)
                if held == (bi, bj):
                    total = total + part
                else:
                    if held is not None:
                        yield cells()
                    held, total = (bi, bj), part
        if held is not None:
            yield cells()

    return run


def centred_products(df: DataFrame, features: Sequence[str], means: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(i, j, value) for i <= j: sum over the rows of (x_i - mean_i) (x_j - mean_j).

    Tasks add up blocks of columns before the shuffle; a cell moves once per task.
    """
    d = len(features)
    # few partitions, since each sends every cell; they are as wide as the table's own otherwise
    rows = df.select(F.array(*[number(df, f) for f in features]).alias("x")).coalesce(TASKS)
    pairs = _block_pairs(d, block)
    per_group = max(GROUP_CELLS // (block * block), 1)
    centre = np.asarray(means, dtype=float)
    parts = reduce(DataFrame.unionByName, [
        rows.mapInArrow(_partial(pairs[g:g + per_group], block, centre), "bi int, bj int, cells array<double>") for g in range(0, len(pairs), per_group)])
    return parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_added(d, block), "i int, j int, value double")


def pair_correlations(df: DataFrame, features: Sequence[str], means: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(i, j, feature1, feature2, r) for i <= j; r is NaN with a constant column, 1 on the diagonal of others."""
    products = settle(centred_products(df, features, means, block), "products")
    spread = products.filter("i = j").select(F.col("i").alias("k"), "value")  # a row per column
    left, right = (spread.select(F.col("k").alias(k), F.col("value").alias(v)) for k, v in (("i", "vi"), ("j", "vj")))
    joined = products.join(F.broadcast(left), "i").join(F.broadcast(right), "j")
    r = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.when(F.col("i") == F.col("j"), 1.0).otherwise(
        F.col("value") / F.sqrt("vi") / F.sqrt("vj"))).otherwise(F.lit(float("nan")))
    names = F.array(*[F.lit(f) for f in features])
    return joined.select("i", "j", F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"), r.alias("r"))
