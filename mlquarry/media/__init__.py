"""Images, signals and frames as arrays: numpy kernels, and a way to run them over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mapped(df: DataFrame, col: str, kernel: Callable[[np.ndarray], np.ndarray | float], shape: tuple[int, ...] | None = None, out: str = "out") -> DataFrame:
    """df with kernel(array) for each array of col, reshaped first if shape is given; flat arrays come out, or doubles if
    the kernel gives numbers. A null stays null."""
    at = df.columns.index(col)
    scalar = np.ndim(kernel(np.zeros(shape or (8,)))) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v in batch.column(at).to_pylist():
                if v is None:
                    found.append(None)
                    continue
                x = np.array(v, float)
                y = kernel(x.reshape(shape) if shape else x)
                found.append(float(y) if scalar else np.asarray(y, float).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64() if scalar else pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, df.select(*df.columns, F.lit(None).cast("double" if scalar else "array<double>").alias(out)).schema)
