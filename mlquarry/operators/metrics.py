"""Evaluation of predictions, as aggregations over (label, prediction) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(label: str, pred: str) -> Column:
    return F.avg((F.col(label) == F.col(pred)).cast("double"))


def confusion_matrix(df: DataFrame, label: str, pred: str, num_classes: int) -> DataFrame:
    """(label, c0, c1, ...): rows true, columns predicted, all classes; values outside are left out."""
    inside = df.where(F.col(label).between(0, num_classes - 1) & F.col(pred).between(0, num_classes - 1))
    counts = inside.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("p")).count()
    classes = df.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    cells = [F.sum(F.when(F.col("p") == k, F.col("count")).otherwise(0)).alias(f"c{k}") for k in range(num_classes)]
    return classes.join(counts.groupBy("label").agg(*cells), "label", "left").fillna(0)


def precision_recall_f1(df: DataFrame, label: str, pred: str, num_classes: int) -> DataFrame:
    """(label, precision, recall, f1) of each class; 0 where undefined."""
    y, p = F.col(label), F.col(pred)
    rows = []
    for k in range(num_classes):
        hit, said, true = F.count_if((y == k) & (p == k)), F.count_if(p == k), F.count_if(y == k)
        precision, recall = ratio(hit, said), ratio(hit, true)
        rows.append(F.struct(F.lit(k).alias("label"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def macro_average(df: DataFrame, label: str, pred: str, num_classes: int = 2) -> DataFrame:
    """One row: unweighted means of precision, recall and F1 over the classes."""
    return precision_recall_f1(df, label, pred, num_classes).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def mse(target: str, pred: str) -> Column:
    return F.avg(F.pow(F.col(pred) - F.col(target), 2))


def mae(target: str, pred: str) -> Column:
    return F.avg(F.abs(F.col(pred) - F.col(target)))


def r2(target: str, pred: str, constant: float = 1.0) -> Column:
    """1 - residual / total sum of squares; constant where the target does not vary (metrics say 1, scores of models 0)."""
    total = F.var_pop(target) * F.count(target)
    return F.when(total == 0, F.lit(constant)).otherwise(1 - F.try_divide(F.sum(F.pow(F.col(target) - F.col(pred), 2)), total))


def latency(runs: DataFrame, model: str, ms: str) -> DataFrame:
    """Per model mean, population deviation and 95th percentile of measured milliseconds."""
    return runs.groupBy(model).agg(F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"))
