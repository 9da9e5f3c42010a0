"""Tensor algebra on array columns, and matrix products of long-form (i, j, v) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(a: Column, b, f) -> Column:
    """Element by element for two arrays, or with a scalar."""
    return F.zip_with(a, b, f) if isinstance(b, Column) else F.transform(a, lambda x: f(x, F.lit(b)))


def add(a: Column, b) -> Column:
    return _pair(a, b, lambda x, y: x + y)


def subtract(a: Column, b) -> Column:
    return _pair(a, b, lambda x, y: x - y)


def multiply(a: Column, b) -> Column:
    return _pair(a, b, lambda x, y: x * y)


def divide(a: Column, b) -> Column:
    """null where the divisor is 0."""
    return _pair(a, b, F.try_divide)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def power(a: Column, p: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(float(p))))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def log(a: Column) -> Column:
    return F.transform(a, lambda x: F.ln(x + 1e-15))


def exp(a: Column) -> Column:
    return F.transform(a, F.exp)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def reshape(a: Column, columns: int) -> Column:
    """An array as rows of so many columns."""
    rows = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / columns).cast("int") - 1, F.lit(0)))
    return F.when(F.size(a) > 0, F.transform(rows, lambda i: F.slice(a, i * columns + 1, F.lit(columns)))).otherwise(F.array())


def flatten(a: Column) -> Column:
    return F.flatten(a)


def transpose(a: Column) -> Column:
    """Rows and columns of an array of arrays exchanged."""
    places = F.sequence(F.lit(1), F.size(F.element_at(a, 1)))
    return F.transform(places, lambda j: F.transform(a, lambda row: F.element_at(row, j)))


def concatenate(*arrays: Column) -> Column:
    return F.concat(*arrays)


def stack(*arrays: Column) -> Column:
    return F.array(*arrays)


def item(a: Column, index: int) -> Column:
    """Element by position from 0; negative ones count from the end."""
    return F.element_at(a, index + 1 if index >= 0 else index)


def assigned(a: Column, index: int, value) -> Column:
    """The array with one element replaced."""
    return F.transform(a, lambda x, i: F.when(i == index, F.lit(value)).otherwise(x))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two long-form matrices."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def reduced(a: DataFrame, axis: int | None, how: str = "sum") -> DataFrame:
    """A long-form matrix summed or averaged over an axis (0 over rows, 1 over columns), or over all."""
    f = {"sum": F.sum, "mean": F.avg}[how]("v").alias("v")
    return a.agg(f) if axis is None else a.groupBy("j" if axis == 0 else "i").agg(f)
