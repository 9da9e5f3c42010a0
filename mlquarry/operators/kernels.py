"""Sums of kernel values over training rows, which are held in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbors
from .neighbors import _vectors


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int) -> np.ndarray:
    if kernel == "linear":
        return a @ b.T
    if kernel == "poly":
        return (a @ b.T + 1) ** degree
    if kernel == "rbf":
        out = a @ b.T  # in place from here: of the passes over all pairs each counts
        out *= 2
        out -= (a**2).sum(axis=1)[:, None]
        out -= (b**2).sum(axis=1)
        np.minimum(out, 0, out=out)
        out *= gamma
        return np.exp(out, out=out)
    raise ValueError(f"unknown kernel {kernel!r}")


def summed(queries: DataFrame, train: DataFrame, id_col: str, target: str, kernel: str, gamma: float, degree: int, weight: float, bias: float) -> DataFrame:
    """See linear.kernel_decision. The training set is the support of the model, kept as it is: queries meet it in the grid
    of neighbors.scanned, so neither passes the driver."""
    kind = queries.schema[id_col].dataType.simpleString()
    rows = train.select(F.col(id_col).alias("__row"), "v", F.col(target).cast("double").alias("__t"))
    if rows.isEmpty():
        return queries.select(id_col, F.lit(float(bias)).alias("decision"))
    found = _linear(queries, rows, id_col, kind) if kernel == "linear" else _gridded(queries, rows, id_col, kind, kernel, gamma, degree)
    return found.select(id_col, (weight * F.col("part") + bias).alias("decision"))


def _linear(queries: DataFrame, rows: DataFrame, id_col: str, kind: str) -> DataFrame:
    """The sum of products with all rows is the product with their weighted sum, which is taken once."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1).to_numpy(zero_copy_only=False) @ _vectors(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["w"])

    shares = np.array([r.w for r in rows.select("v", "__t").mapInArrow(added, "w array<double>").collect()])  # one for each task
    total = shares.sum(axis=0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _vectors(batch.column(1)) @ total if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=[id_col, "part"])

    return queries.select(id_col, "v").mapInArrow(scored, f"{id_col} {kind}, part double").groupBy(id_col).agg(F.sum("part").alias("part"))


def _gridded(queries: DataFrame, rows: DataFrame, id_col: str, kind: str, kernel: str, gamma: float, degree: int) -> DataFrame:
    cells = neighbors.CELLS // 8  # which stay in the processor's cache

    def shares(x: np.ndarray, columns: list) -> tuple:
        y = columns[0].to_numpy(zero_copy_only=False)

        def step(ids: pa.Array, q: np.ndarray) -> Iterator[tuple]:
            made, wide = np.zeros(len(q)), max(1, cells // len(q))
            for at in range(0, len(x), wide):
                made += kernel_matrix(q, x[at : at + wide], kernel, gamma, degree) @ y[at : at + wide]
            yield ids, made

        return step, list

    found = neighbors.scanned(queries, rows, id_col, ["__t"], f"{id_col} {kind}, part double", shares, "__row", refuse=True)
    return found.groupBy(id_col).agg(F.sum("part").alias("part"))
