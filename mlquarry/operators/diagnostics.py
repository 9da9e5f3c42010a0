"""Diagnostics of labelled data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import literal, number
from .quantiles import quantiles


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n): rows of each class."""
    return df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))


def imbalance_ratio(df: DataFrame, label: str, threshold: float = 10.0) -> DataFrame:
    """One row: the largest class over the smallest, and whether that is above the threshold."""
    counts = class_distribution(df, label)
    ratio = F.max("n") / F.min("n")
    return counts.agg(ratio.alias("ratio"), (ratio > threshold).alias("severe"))


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows, distinct rows over cols, and their difference. Nulls are equal to each other."""
    groups = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def leakage_check(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: distinct rows over cols that both frames have."""
    return train.select(*cols).intersect(other.select(*cols)).agg(F.count("*").alias("n_shared"))


def feature_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max, median) of each column, population deviation."""
    middle = quantiles(df, {c: (number(c), 0.5) for c in cols})
    rows = [
        F.struct(F.lit(c).alias("feature"), F.avg(number(c)).alias("mean"), F.stddev_pop(number(c)).alias("std"), F.min(number(c)).alias("min"), F.max(number(c)).alias("max"), literal(middle[c]).cast("double").alias("median"))
        for c in cols
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def outlier_count(df: DataFrame, cols: Sequence[str], z_threshold: float = 3.0) -> DataFrame:
    """One row: rows with a column more than z_threshold population deviations (+ 1e-12) from its mean."""
    row = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    far = F.lit(False)
    for i, c in enumerate(cols):
        z = F.abs(number(c) - literal(row[f"m{i}"])) / (literal(row[f"s{i}"]) + 1e-12)
        far = far | F.coalesce(z > z_threshold, F.lit(False))
    return df.agg(F.count_if(far).alias("n_outliers"))


def report(df: DataFrame, cols: Sequence[str], label: str, imbalance_threshold: float = 10.0, z_threshold: float = 3.0) -> dict:
    """All of the above as Python values."""
    return {
        "class_distribution": {r.label: r.n for r in class_distribution(df, label).collect()},
        "imbalance": imbalance_ratio(df, label, imbalance_threshold).first().asDict(),
        "duplicates": duplicate_count(df, cols).first().n_duplicates,
        "features": {r.feature: r.asDict() for r in feature_statistics(df, cols).collect()},
        "outliers": outlier_count(df, cols, z_threshold).first().n_outliers,
    }
