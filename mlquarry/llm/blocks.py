"""Sums of large count arrays that tasks make, without ever gathering the tasks' arrays in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "block int, part int, data binary"
PARTS = 32


def emit(total: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's array that are not zero, as rows of SCHEMA."""
    part = TaskContext.get().partitionId() % PARTS
    for i, block in enumerate(np.split(total.reshape(-1), blocks)):
        if block.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([block.astype("<i8").tobytes()])], names=["block", "part", "data"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            values = np.frombuffer(data, "<i8")
            total[block] = total[block] + values if block in total else values
    for block, values in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([values.tobytes()])], names=["block", "part", "data"])


def summed(rows: DataFrame, blocks: int, size: int) -> np.ndarray:
    """The sum of all tasks' arrays, of size numbers: first within PARTS parts of the tasks, then over the parts.

    Each task holds one array at most, and the driver gets one.
    """
    once = rows.repartition("block", "part").mapInArrow(_add, SCHEMA)
    found = once.repartition("block").mapInArrow(_add, SCHEMA).toArrow()
    out = np.zeros((blocks, size // blocks), np.int64)
    for block, data in zip(found["block"].to_pylist(), found["data"].to_pylist(), strict=True):
        out[block] = np.frombuffer(data, "<i8")
    return out.reshape(-1)
