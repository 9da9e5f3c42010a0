"""Learning rates in closed form of the epoch, and early stopping over a table of metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered


def step_lr(base: float, epoch: Column, step_size: int, gamma: float = 0.1) -> Column:
    return base * F.pow(F.lit(gamma), F.floor(epoch / step_size))


def exponential_lr(base: float, epoch: Column, gamma: float) -> Column:
    return base * F.pow(F.lit(gamma), epoch)


def cosine_lr(base: float, epoch: Column, t_max: int, eta_min: float = 0.0) -> Column:
    return eta_min + (base - eta_min) * (1 + F.cos(math.pi * epoch / t_max)) / 2


def early_stopping(history: DataFrame, run: str, epoch: str, value: str, patience: int = 7, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """(run, stop_epoch, best_epoch, best): where each run stops, null if it does not, and its best epoch until then.

    An epoch is better if it improves the best before by more than min_delta; a run stops once patience epochs in a row
    were no better. The best is folded over a run's epochs, of which there are few.
    """
    sign = F.lit(1.0 if mode == "min" else -1.0)
    points = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), (sign * F.col(value)).cast("double").alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def merge(s: Column, p: Column) -> Column:
        better = F.isnull(s["best"]) | (p["v"] < s["best"] - min_delta)
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        moved = F.struct(F.when(better, p["v"]).otherwise(s["best"]).alias("best"), F.when(better, p["e"].cast("bigint")).otherwise(s["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, p["e"].cast("bigint")).alias("stop"))
        return F.when(F.isnotnull(s["stop"]), s).otherwise(moved)

    folded = history.groupBy(run).agg(points.alias("p")).select(run, F.aggregate("p", start, merge).alias("s"))
    return folded.select(run, F.col("s.stop").alias("stop_epoch"), F.col("s.at").alias("best_epoch"), (sign * F.col("s.best")).alias("best"))


def batches(df: DataFrame, order: list[str], batch_size: int = 32, seed: int | None = None) -> DataFrame:
    """df with batch_id and place: rows dealt out in order of a seeded hash of the order columns, or in their order.

    All batches but the last are full.
    """
    key = [F.xxhash64(F.lit(seed), *order)] if seed is not None else []
    placed = numbered(df, [*key, *order], "__at")
    return placed.select(*df.columns, F.floor(F.col("__at") / batch_size).alias("batch_id"), (F.col("__at") % batch_size).alias("place"))
