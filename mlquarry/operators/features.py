"""Constructing and selecting feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Transformer, number


class PolynomialFeatures(Transformer):
    """All monomials up to a degree, a bias first, in order of degree and then of columns.

    interaction_only keeps the columns themselves and the monomials of more than one of them. New columns are named as
    get_feature_names() says; the columns themselves stay as they are.
    """

    params: dict = {}

    def __init__(self, cols: Sequence[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = True):
        super().__init__(cols)
        self.degree, self.interaction_only, self.include_bias = degree, interaction_only, include_bias

    def terms(self) -> list[tuple[int, ...]]:
        out = [()] if self.include_bias else []
        for d in range(1, self.degree + 1):
            for t in combinations_with_replacement(range(len(self.cols)), d):
                if d == 1 or not self.interaction_only or len(set(t)) > 1:
                    out.append(t)
        return out

    def get_feature_names(self) -> list[str]:
        return [" ".join(self.cols[i] for i in t) or "1" for t in self.terms()]

    def columns(self) -> dict[str, Column]:
        product = lambda t: reduce(lambda a, b: a * b, [number(self.cols[i]) for i in t], F.lit(1.0))
        return {n: product(t) for n, t in zip(self.get_feature_names(), self.terms(), strict=True)}


class FeatureInteractions(Transformer):
    """Every pair of columns multiplied, added, subtracted or divided (the divisor + 1e-10), named as "a*b"."""

    params: dict = {}
    SIGNS = {"multiply": "*", "add": "+", "subtract": "-", "divide": "/"}

    def __init__(self, cols: Sequence[str], interaction_type: str = "multiply"):
        super().__init__(cols)
        if interaction_type not in self.SIGNS:
            raise ValueError(f"unknown interaction {interaction_type!r}")
        self.kind = interaction_type

    def get_feature_names(self) -> list[str]:
        return [*self.cols, *[f"{a}{self.SIGNS[self.kind]}{b}" for a, b in combinations(self.cols, 2)]]

    def columns(self) -> dict[str, Column]:
        apply = {"multiply": lambda a, b: a * b, "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "divide": lambda a, b: F.try_divide(a, b + F.lit(1e-10))}[self.kind]
        return {f"{a}{self.SIGNS[self.kind]}{b}": apply(number(a), number(b)) for a, b in combinations(self.cols, 2)}


class _Selector(Transformer):
    """Drops those of its columns that it does not keep."""

    kept: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        self.check()
        return df.drop(*[c for c in self.cols if c not in self.kept])


class VarianceThreshold(_Selector):
    """Keeps columns whose population variance is above the threshold."""

    def __init__(self, cols: Sequence[str], threshold: float = 0.0):
        super().__init__(cols)
        self.threshold = threshold

    def statistics(self) -> dict[str, Column]:
        return self.per_column(var=F.var_pop)

    def accept(self, row) -> None:
        super().accept(row)
        self.kept = [c for c in self.cols if (self.get("var", c) or 0.0) > self.threshold]


class CorrelationSelector(_Selector):
    """With a target, keeps columns whose correlation with it is threshold or more in size; without one, drops a column
    that correlates above the threshold with an earlier one, whether that one stays or not. Undefined correlations are 0."""

    def __init__(self, cols: Sequence[str], target: str | None = None, threshold: float = 0.5):
        super().__init__(cols)
        self.target, self.threshold = target, threshold

    def pairs(self) -> list[tuple[str, str]]:
        return [(c, self.target) for c in self.cols] if self.target else list(combinations(self.cols, 2))

    def statistics(self) -> dict[str, Column]:
        return {f"r{i}": correlation(a, b) for i, (a, b) in enumerate(self.pairs())}

    def accept(self, row) -> None:
        self.params = row.asDict() if row else {}
        size = {p: abs(self.params[f"r{i}"] or 0.0) for i, p in enumerate(self.pairs())}
        if self.target:
            self.kept = [a for a, _ in self.pairs() if size[a, self.target] >= self.threshold]
        else:
            dropped = {b for (a, b), r in size.items() if r > self.threshold}
            self.kept = [c for c in self.cols if c not in dropped]


CorrelationThreshold = CorrelationSelector


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns over rows that have both; 0 if it is undefined."""
    x, y = number(a), number(b)
    both = F.isnotnull(x) & F.isnotnull(y)
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns a before b, from one aggregation."""
    pairs = list(combinations(cols, 2))
    rows = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r")) for a, b in pairs]).alias("rows"))
    return rows.select(F.inline("rows"))
