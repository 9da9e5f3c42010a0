"""Filling in missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Transformer, fit_together, literal, number
from .neighbors import nearest
from .scaling import StandardScaler


class SimpleImputer(Transformer):
    """mean, median, most_frequent (of ties the smallest; 0 for an all-missing column) or constant."""

    def __init__(self, cols: Sequence[str], strategy: str = "mean", fill_value: float | None = None):
        super().__init__(cols)
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"unknown strategy {strategy!r}")
        if strategy == "constant" and fill_value is None:
            raise ValueError("constant needs fill_value")
        self.strategy, self.fill_value = strategy, fill_value

    def statistics(self) -> dict[str, Column]:
        return self.per_column(fill=F.avg) if self.strategy == "mean" else {}

    def quantiles(self) -> dict[str, tuple]:
        return self.per_column(fill=lambda c: (c, 0.5)) if self.strategy == "median" else {}

    def modes(self) -> dict[str, Column]:
        return self.per_column(fill=lambda c: c) if self.strategy == "most_frequent" else {}

    def columns(self) -> dict[str, Column]:
        out = {}
        for c in self.cols:
            value = self.fill_value if self.strategy == "constant" else self.get("fill", c)
            out[c] = F.coalesce(number(c), literal(0.0 if value is None and self.strategy == "most_frequent" else value))
        return out


class AutoPreprocessor(Transformer):
    """Imputes only if the fitted data misses values, then scales to mean 0 and deviation 1."""

    def __init__(self, cols: Sequence[str], scaling: bool = True, imputation: bool = True, imputation_strategy: str = "mean"):
        super().__init__(cols)
        self.scaling, self.imputation, self.strategy = scaling, imputation, imputation_strategy
        self.steps: list[tuple[str, Transformer]] = []

    def fit(self, df: DataFrame) -> AutoPreprocessor:
        self.steps = []
        missing = df.agg(*[F.count_if(F.isnull(number(c))).alias(f"m{i}") for i, c in enumerate(self.cols)]).first()
        if self.imputation and any(missing):
            imputer = SimpleImputer(self.cols, self.strategy)
            fit_together(df, [imputer])
            self.steps.append(("imputer", imputer))
            df = imputer.transform(df)
        if self.scaling:
            self.steps.append(("scaler", StandardScaler(self.cols).fit(df)))
        self.params = {}
        return self

    def get_steps(self) -> list[str]:
        return [name for name, _ in self.steps]

    def transform(self, df: DataFrame) -> DataFrame:
        self.check()
        for _, step in self.steps:
            df = step.transform(df)
        return df


def knn_impute(df: DataFrame, id_col: str, cols: Sequence[str], n_neighbors: int = 5, weights: str = "uniform") -> DataFrame:
    """Rows with gaps filled from the rows nearest over their known columns.

    Candidates know all those columns; of equal distances the smaller id comes first, the row itself included. Each gap
    is the mean of the neighbours' known values, weighted by 1 / (distance + 1e-10) for weights="distance". Rows with gaps
    are handled by the pattern of what they miss, each pattern a query set against all rows, in blocks.
    """
    cols = list(cols)
    clean = df.select(id_col, *[number(c).alias(c) for c in cols])
    pattern = F.concat(*[F.when(F.isnull(c), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    patterns = [r.p for r in clean.groupBy(pattern.alias("p")).count().collect()]  # at most 2 ** columns, in practice few
    filled = None
    for p in sorted(patterns):
        if "1" not in p or "0" not in p:
            continue
        known = [c for c, x in zip(cols, p, strict=True) if x == "0"]
        gaps = [c for c, x in zip(cols, p, strict=True) if x == "1"]
        complete = clean.where(" AND ".join(f"`{c}` IS NOT NULL" for c in known))
        queries = clean.where(pattern == p).select(id_col, F.array(*known).alias("v"))
        rows = complete.select(F.col(id_col).alias("nid"), F.array(*known).alias("v"), *[F.col(c).alias(f"__{c}") for c in gaps])
        pairs = nearest(queries, rows, n_neighbors, id_col, "nid", keep=[f"__{c}" for c in gaps])
        weight = F.lit(1.0) if weights == "uniform" else 1 / (F.col("distance") + 1e-10)
        means = [(F.sum(weight * F.col(f"__{c}")) / F.sum(F.when(F.isnotnull(f"__{c}"), weight))).alias(f"__{c}") for c in gaps]
        part = pairs.groupBy(id_col).agg(*means).select(id_col, *[F.col(f"__{c}") if c in gaps else F.lit(None).cast("double").alias(f"__{c}") for c in cols])
        filled = part if filled is None else filled.unionByName(part)
    if filled is None:
        return df.withColumns({c: number(c) for c in cols})
    out = df.join(filled, id_col, "left").withColumns({c: F.coalesce(number(c), F.col(f"__{c}")) for c in cols})
    return out.select(df.columns)
