"""Encoders of categories. Dictionaries are DataFrames of (value, ...); nothing but small numbers goes to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NotFittedError, literal, number
from .ranking import numbered

#: A dictionary is broadcast up to this number of entries and joined by shuffle beyond.
BROADCAST_ENTRIES = 200_000
#: Categories a column may have where each becomes a column.
MAX_COLUMNS = 5_000


def indexed(values: DataFrame, value: str = "value", index: str = "idx") -> DataFrame:
    """Distinct values with their place in order, from 0."""
    return numbered(values.select(value).where(F.isnotnull(value)).distinct(), [value], index)


def sized(dictionary: DataFrame) -> DataFrame:
    """The dictionary, to be broadcast if it is small."""
    few = dictionary.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    return F.broadcast(dictionary) if few else dictionary


class _Dictionary:
    """Looks the values of columns up in fitted dictionaries."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.tables: dict[str, DataFrame] | None = None

    def check(self) -> None:
        if self.tables is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")

    def looked_up(self, df: DataFrame, col: str, default: Column, out: str | None = None) -> DataFrame:
        self.check()
        table = self.tables[col].toDF("__value", "__found")
        joined = df.join(table, F.col(col) == F.col("__value"), "left")
        order = [c for c in df.columns if c != (out or col)]
        position = df.columns.index(out or col) if (out or col) in df.columns else len(order)
        columns = [F.col(c) for c in order]
        columns.insert(position, F.coalesce("__found", default).alias(out or col))
        return joined.select(*columns)


class LabelEncoder(_Dictionary):
    """Values to their rank among the sorted distinct values; an unknown value raises, a null stays null."""

    def __init__(self, col: str):
        super().__init__([col])

    def fit(self, df: DataFrame) -> LabelEncoder:
        self.tables = {c: sized(indexed(df.select(F.col(c).alias("value")))) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            unknown = F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.col(c).cast("string"))).cast("bigint")
            df = self.looked_up(df, c, F.when(F.isnotnull(c), unknown))
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.check()
        for c in self.cols:
            table = self.tables[c].select(F.col("idx").alias("__idx"), F.col("value").alias("__value"))
            df = df.join(table, F.col(c) == F.col("__idx"), "left").select(*[F.col("__value").alias(c) if x == c else df[x] for x in df.columns])
        return df


class OrdinalEncoder(LabelEncoder):
    """Each column as LabelEncoder, as double; unknown values raise, or become -1 for handle_unknown="use_encoded_value"."""

    def __init__(self, cols: Sequence[str], handle_unknown: str = "error"):
        _Dictionary.__init__(self, cols)
        self.handle_unknown = handle_unknown

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            default = F.lit(-1)
            if self.handle_unknown == "error":
                default = F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.col(c).cast("string"))).cast("bigint")
            df = self.looked_up(df, c, F.when(F.isnotnull(c), default))
            df = df.withColumn(c, F.col(c).cast("double"))
        return df


class OneHotEncoder:
    """A 0/1 column for each category, categories in order, column after column.

    Unknown values raise or, for handle_unknown="ignore", are all 0. At most MAX_COLUMNS categories in all.
    """

    def __init__(self, cols: Sequence[str], handle_unknown: str = "error"):
        self.cols, self.handle_unknown = list(cols), handle_unknown
        self.categories: list[list] | None = None

    def fit(self, df: DataFrame) -> OneHotEncoder:
        row = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"c{i}") for i, c in enumerate(self.cols)]) if self._few(df) else None
        if row is None:
            raise ValueError(f"more than {MAX_COLUMNS} categories")
        self.categories = [list(v) for v in row.first()]
        return self

    def _few(self, df: DataFrame) -> bool:
        found = 0
        for c in self.cols:
            found += df.select(c).where(F.isnotnull(c)).distinct().limit(MAX_COLUMNS + 1 - found).count()
            if found > MAX_COLUMNS:
                return False
        return True

    def get_feature_names(self, input_features: Sequence[str] | None = None) -> list[str]:
        names = input_features or [f"x{i}" for i in range(len(self.cols))]
        return [f"{n}_{v}" for n, values in zip(names, self.categories, strict=True) for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        if self.categories is None:
            raise NotFittedError("OneHotEncoder is not fitted")
        out = {}
        for c, values in zip(self.cols, self.categories, strict=True):
            known = F.col(c).isin(values) if values else F.lit(False)
            bad = F.when(F.isnotnull(c) & ~known, F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.col(c).cast("string"))).cast("double"))
            for v in values:
                hot = F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                out[f"{c}_{v}"] = hot if self.handle_unknown == "ignore" else F.coalesce(bad, hot)
        return df.withColumns(out)


class TargetEncoder(_Dictionary):
    """(sum of the target + smoothing * its overall mean) / (count + smoothing); rare and unseen values get the mean."""

    def __init__(self, cols: Sequence[str], target: str, smoothing: float = 1.0, min_samples_leaf: int = 1):
        super().__init__(cols)
        self.target, self.smoothing, self.least = target, smoothing, min_samples_leaf

    def fit(self, df: DataFrame) -> TargetEncoder:
        y = number(self.target)
        self.mean = df.agg(F.avg(y)).first()[0]
        self.tables = {}
        for c in self.cols:
            groups = df.where(F.isnotnull(c)).groupBy(F.col(c).alias("value")).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
            encoded = F.when(F.col("n") >= self.least, (F.col("s") + self.smoothing * literal(self.mean)) / (F.col("n") + self.smoothing)).otherwise(literal(self.mean))
            self.tables[c] = sized(groups.select("value", encoded.alias("code")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            df = self.looked_up(df, c, literal(self.mean).cast("double"))
        return df


class FrequencyEncoder(_Dictionary):
    """The share of rows that have the value; 0 for an unseen one."""

    def fit(self, df: DataFrame) -> FrequencyEncoder:
        total = df.count()
        self.tables = {c: sized(df.where(F.isnotnull(c)).groupBy(F.col(c).alias("value")).count().select("value", (F.col("count") / F.lit(float(total))).alias("code"))) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            df = self.looked_up(df, c, F.lit(0.0))
        return df
