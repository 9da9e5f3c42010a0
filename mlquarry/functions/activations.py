"""Activation functions as column expressions; softmax over an array column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, negative_slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * negative_slope)


def sigmoid(x: Column) -> Column:
    """The logistic function; the exponent is kept within 100."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(100.0)), F.lit(-100.0))))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def linear(x: Column) -> Column:
    return x


def softmax(values: Column) -> Column:
    """Shares of exp(value - largest) in an array of doubles."""
    powers = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


NAMED = {"relu": relu, "leaky_relu": leaky_relu, "sigmoid": sigmoid, "tanh": tanh, "gelu": gelu, "softplus": softplus, "linear": linear, "softmax": softmax}


def get_activation(name: str):
    """The function of a name; ValueError for an unknown one."""
    if name not in NAMED:
        raise ValueError(f"unknown activation {name!r}")
    return NAMED[name]
