"""Sums of products of columns, added up in blocks.

Every task adds up the products of its own rows and sends square blocks of the result; blocks of one place are added
where they meet, first in a few groups and then at once. Neither rows nor the whole matrix reach the driver, and a
block is never in a task twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 256
# Partial blocks are added in so many groups first, so that no task reads one block of every task.
GROUPS = 32
_BLOCK = "low int, high int, part int, block binary"


def gram_cells(df: DataFrame, size: int, values: Column, indices: Column | None = None) -> DataFrame:
    """(i, j, value) with i <= j: the sum over the rows of x[i] * x[j].

    ``values`` is an array of ``size`` doubles, or of those at ``indices`` where the others are 0. A task holds size * size
    numbers. Cells of no rows are missing.
    """
    slim = df.select(values.alias("values"), *([] if indices is None else [indices.alias("indices")]))

    sparse = indices is not None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                numbers = part.column(0).flatten().to_numpy(zero_copy_only=False)
                if not sparse:
                    x = numbers.reshape(-1, size)
                else:
                    x = np.zeros((part.num_rows, size))
                    of = np.repeat(np.arange(part.num_rows), part.column(0).value_lengths().to_numpy(zero_copy_only=False))
                    x[of, part.column(1).flatten().to_numpy(zero_copy_only=False)] = numbers
                total += x.T @ x
        if rows:
            part_id = TaskContext.get().partitionId()
            for low in range(0, size, SIDE):
                for high in range(low, size, SIDE):
                    yield _record(low, high, part_id, total[low : low + SIDE, high : high + SIDE])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, part_id = None, None, 0
        for batch in batches:
            for low, high, part, block in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                if (low, high) != place and place is not None:
                    yield _record(*place, part_id, total)
                    total = None
                found = np.frombuffer(block, float).reshape(min(SIDE, size - low), min(SIDE, size - high))
                total = found.copy() if total is None else total + found
                place, part_id = (low, high), part % GROUPS
        if place is not None:
            yield _record(*place, part_id, total)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, block in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                found = np.frombuffer(block, float).reshape(min(SIDE, size - low), min(SIDE, size - high))
                i, j = np.indices(found.shape)
                kept = (i + low) <= (j + high)
                columns = [pa.array((i + low)[kept], pa.int32()), pa.array((j + high)[kept], pa.int32()), pa.array(found[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "value"])

    partial = slim.mapInArrow(multiply, _BLOCK)
    # A group's blocks of one place come together and in a fixed order, so sums agree from run to run.
    grouped = partial.repartition("low", "high", F.col("part") % GROUPS).sortWithinPartitions(F.col("part") % GROUPS, "low", "high", "part")
    summed = grouped.mapInArrow(add, _BLOCK).repartition("low", "high").sortWithinPartitions("low", "high", "part").mapInArrow(add, _BLOCK)
    return summed.mapInArrow(cells, "i int, j int, value double")


def _record(low: int, high: int, part: int, block: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["low", "high", "part", "block"])


def all_pairs(df: DataFrame, size: int) -> DataFrame:
    """(i, j) of every pair of ``size`` numbers, made by the executors."""
    return df.sparkSession.range(size * size).select(F.expr(f"CAST(id div {size} AS INT)").alias("i"), F.expr(f"CAST(id % {size} AS INT)").alias("j"))
