"""The protocol of operators that learn statistics and then only project.

fit() takes all statistics of an operator in one aggregation; what they give is a handful of Python numbers, which
transform() puts into the plan as literals. Nothing is cached and nothing is joined, so transforms of several operators
fold into one projection over the scan. Missing values are NULL; NaN is read as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import quantiles

_PER_JOB = 400


class NotFittedError(RuntimeError):
    """transform() before fit()."""


def number(column: str | Column) -> Column:
    """A column as double with NaN read as missing."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value), value)


def literal(value) -> Column:
    return F.lit(value if value is None else float(value))


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


class Transformer:
    """Base class: subclasses say which statistics they need and how they use them."""

    params: dict | None = None

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def statistics(self) -> dict[str, Column]:
        """Aggregates by name; empty if the operator learns nothing."""
        return {}

    def quantiles(self) -> dict[str, tuple[Column, float | list[float]]]:
        """Exact quantiles by name: a column and one probability or several."""
        return {}

    def modes(self) -> dict[str, Column]:
        """Columns by name whose most frequent value is asked for, of ties the smallest."""
        return {}

    def accept(self, row: Row | None) -> None:
        """Takes the values of statistics()."""
        self.params = row.asDict() if row else {}

    def columns(self) -> dict[str, Column]:
        """New or replaced columns of the transformed frame."""
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Transformer:
        fit_together(df, [self])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self.check()
        return df.withColumns(self.columns())

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def check(self) -> None:
        if self.params is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")

    def get(self, kind: str, col: str):
        return self.params[f"{kind}_{self.cols.index(col)}"]

    def per_column(self, **kinds) -> dict[str, Column]:
        """Statistics named kind_index: kinds give a function of a clean column."""
        return {f"{kind}_{i}": f(number(c)) for kind, f in kinds.items() for i, c in enumerate(self.cols)}


def fit_together(df: DataFrame, operators: Sequence[Transformer]) -> None:
    """Fits operators that all look at df itself, with one scan for up to a few hundred statistics, and some more for all
    quantiles together."""
    wanted = [(i, name, value) for i, op in enumerate(operators) for name, value in op.statistics().items()]
    found: dict[str, object] = {}
    for at in range(0, len(wanted), _PER_JOB):
        part = wanted[at : at + _PER_JOB]
        found |= df.agg(*[v.alias(f"{i}:{n}") for i, n, v in part]).first().asDict()
    ranked = {f"{i}:{n}": q for i, op in enumerate(operators) for n, q in op.quantiles().items()}
    counted = {f"{i}:{n}": c for i, op in enumerate(operators) for n, c in op.modes().items()}
    found |= (quantiles.quantiles(df, ranked) if ranked else {}) | (quantiles.modes(df, counted) if counted else {})
    for i, op in enumerate(operators):
        names = [*op.statistics(), *op.quantiles(), *op.modes()]
        op.accept(Row(**{n: found[f"{i}:{n}"] for n in names}) if names else None)
