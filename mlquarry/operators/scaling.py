"""Scalers, row normalisers and type conversion for numeric columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Transformer, literal, number


class _Affine(Transformer):
    """(x - shift) / scale + offset for each column, with its inverse."""

    def affine(self, col: str) -> tuple[float, float, float]:
        raise NotImplementedError

    def columns(self) -> dict[str, Column]:
        out = {}
        for c in self.cols:
            shift, scale, offset = self.affine(c)
            out[c] = (number(c) - literal(shift)) / literal(scale) + literal(offset)
        return out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.check()
        out = {}
        for c in self.cols:
            shift, scale, offset = self.affine(c)
            out[c] = (number(c) - literal(offset)) * literal(scale) + literal(shift)
        return df.withColumns(out)


class StandardScaler(_Affine):
    """(x - mean) / population standard deviation; a constant column is only shifted."""

    def statistics(self) -> dict[str, Column]:
        return self.per_column(mean=F.avg, std=F.stddev_pop)

    def affine(self, col: str) -> tuple[float, float, float]:
        return self.get("mean", col), self.get("std", col) or 1.0, 0.0


class MinMaxScaler(_Affine):
    """Onto feature_range; a constant column becomes its lower end."""

    def __init__(self, cols: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0)):
        super().__init__(cols)
        self.low, self.high = feature_range

    def statistics(self) -> dict[str, Column]:
        return self.per_column(min=F.min, max=F.max)

    def affine(self, col: str) -> tuple[float, float, float]:
        low, high = self.get("min", col), self.get("max", col)
        if low is None:
            return None, 1.0, self.low
        return low, ((high - low) or 1.0) / ((self.high - self.low) or 1.0), self.low


class RobustScaler(_Affine):
    """(x - median) / (upper - lower quantile), quantiles exact with linear interpolation; a zero range counts as 1."""

    def __init__(self, cols: Sequence[str], quantile_range: tuple[float, float] = (25.0, 75.0)):
        super().__init__(cols)
        self.range = [q / 100 for q in quantile_range]

    def quantiles(self) -> dict[str, tuple]:
        return self.per_column(q=lambda c: (c, [0.5, *self.range]))

    def affine(self, col: str) -> tuple[float, float, float]:
        middle, low, high = self.get("q", col) or (None, 0.0, 0.0)
        return middle, (high - low) or 1.0, 0.0


class Normalizer(Transformer):
    """Each row divided by its norm over the columns: l1, l2 or max; a row of zeros stays."""

    params: dict = {}

    def __init__(self, cols: Sequence[str], norm: str = "l2"):
        super().__init__(cols)
        if norm not in ("l1", "l2", "max"):
            raise ValueError(f"unknown norm {norm!r}")
        self.norm = norm

    def columns(self) -> dict[str, Column]:
        values = [number(c) for c in self.cols]
        if self.norm == "max":
            size = F.greatest(*[F.abs(v) for v in values]) if len(values) > 1 else F.abs(values[0])
        elif self.norm == "l1":
            size = reduce(lambda a, b: a + b, [F.abs(v) for v in values])
        else:
            size = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in values]))
        size = F.when(size == 0, F.lit(1.0)).otherwise(size)
        return {c: v / size for c, v in zip(self.cols, values, strict=True)}


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, power: float) -> Column:
    return F.ln(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power


def _powered(logs: np.ndarray, powers: np.ndarray) -> Iterator[np.ndarray]:
    """(exp(power * log) - 1) / power for evenly spaced powers (the log for 0), by one product each."""
    with np.errstate(over="ignore", invalid="ignore"):
        now, step = np.exp(powers[0] * logs), np.exp((powers[1] - powers[0]) * logs)
        for k, p in enumerate(powers):
            if k:
                now = now * step if np.isfinite(now).all() and now.all() else np.exp(p * logs)
            yield logs if abs(p) < 1e-12 else (now - 1) / p


def power_statistics(values: DataFrame, grid: Sequence[np.ndarray], method: str) -> list[tuple[int, float, np.ndarray]]:
    """For each column the number of values, the sum of the logarithms of slopes at power 1 and the population variance at
    each of its evenly spaced powers. Tasks merge moments of their batches, the driver those of tasks."""

    def merged(one: tuple, two: tuple) -> tuple:
        n, j, mean, square = (np.asarray(v) for v in one)
        m, i, other, more = (np.asarray(v) for v in two)
        with np.errstate(over="ignore", invalid="ignore"):
            shift = other - mean
            return n + m, j + i, mean + shift * (m / (n + m)), square + more + shift**2 * (n * m / (n + m))

    def moments(x: np.ndarray, powers: np.ndarray) -> tuple:
        below = x < 0 if method == "yeo-johnson" else np.zeros(len(x), bool)
        up = np.log1p(x[~below]) if method == "yeo-johnson" else np.log(x)
        down = np.log1p(-x[below])
        mean, square = np.empty(len(powers)), np.empty(len(powers))
        lower = _powered(down, 2 - powers)
        for k, t in enumerate(_powered(up, powers)):
            if len(down):
                t = np.concatenate((t, -next(lower)))
            with np.errstate(over="ignore", invalid="ignore"):
                mean[k] = t.mean()
                t = t - mean[k]
                square[k] = t @ t
        return len(x), up.sum() - down.sum(), mean, square

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for i, powers in enumerate(grid):
                x = batch.column(i).drop_null().to_numpy()
                if len(x):
                    made = moments(x, powers)
                    found[i] = merged(found[i], made) if i in found else made
        rows = [(i, *v) for i, v in found.items()]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c].tolist() if isinstance(r[c], np.ndarray) else r[c] for r in rows], k) for c, k in enumerate(kinds)], names=list("injms"))

    out: dict[int, tuple] = {}
    for r in values.mapInArrow(kernel, "i int, n long, j double, m array<double>, s array<double>").collect():  # a row for each task and column
        out[r.i] = merged(out[r.i], tuple(r)[1:]) if r.i in out else tuple(r)[1:]
    return [(int(v[0]), float(v[1]), np.asarray(v[3]) / v[0]) if (v := out.get(i)) else (0, 0.0, np.zeros(len(powers))) for i, powers in enumerate(grid)]


class PowerTransformer(Transformer):
    """Yeo-Johnson or Box-Cox with the power of the largest likelihood: a grid of powers a scan, refined twice."""

    def __init__(self, cols: Sequence[str], method: str = "yeo-johnson"):
        super().__init__(cols)
        if method not in ("yeo-johnson", "box-cox"):
            raise ValueError(f"unknown method {method!r}")
        self.method = method
        self.function = yeo_johnson if method == "yeo-johnson" else box_cox

    def fit(self, df: DataFrame) -> PowerTransformer:
        if self.method == "box-cox":
            least = df.agg(*[F.min(number(c)).alias(f"m{i}") for i, c in enumerate(self.cols)]).first()
            if any(v is not None and v <= 0 for v in least):
                raise ValueError("box-cox takes positive values only")
        centre, width = {c: 0.0 for c in self.cols}, 5.0
        values = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(self.cols)])
        for _ in range(4):
            grid = [np.linspace(centre[c] - width, centre[c] + width, 21) for c in self.cols]
            for c, powers, (n, j, var) in zip(self.cols, grid, power_statistics(values, grid, self.method), strict=True):
                likely = np.where(np.isfinite(var), -n / 2 * np.log(np.maximum(var, 1e-300)) + (powers - 1) * j, -np.inf)
                centre[c] = float(powers[int(np.argmax(likely))])
            width /= 10
        self.params = centre
        return self

    def columns(self) -> dict[str, Column]:
        return {c: self.function(number(c), self.params[c]) for c in self.cols}


class TypeConverter(Transformer):
    """Columns cast to a type; values that do not fit raise, or become missing if lenient."""

    params: dict = {}
    TYPES = {"float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "bool": "boolean", "str": "string", "object": "string"}

    def __init__(self, cols: Sequence[str], dtype: str = "float32", lenient: bool = False):
        super().__init__(cols)
        self.kind, self.lenient = self.TYPES.get(dtype, dtype), lenient

    def columns(self) -> dict[str, Column]:
        return {c: F.col(c).try_cast(self.kind) if self.lenient else F.col(c).cast(self.kind) for c in self.cols}
