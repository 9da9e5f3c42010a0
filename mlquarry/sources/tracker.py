"""Experiments as an append-only table of (exp_id, step, metric, value) under a path, beside a table of their settings."""

from __future__ import annotations

import json
import platform
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summary(log: DataFrame) -> DataFrame:
    """(exp_id, metric, last, best, mean, steps): the value of the last step, the largest, the mean and the number."""
    return log.groupBy("exp_id", "metric").agg(F.max_by("value", "step").alias("last"), F.max("value").alias("best"), F.avg("value").alias("mean"), F.count("*").alias("steps"))


class ExperimentTracker:
    """Experiments under one path of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def new(self, name: str, hyperparams: dict | None = None) -> str:
        """The id of a new experiment, whose settings are kept."""
        exp_id = uuid.uuid4().hex[:8]
        row = [(exp_id, name, json.dumps(hyperparams or {}), platform.python_version(), datetime.now(UTC))]
        self.spark.createDataFrame(row, "exp_id string, name string, hyperparams string, python string, started timestamp").write.mode("append").parquet(f"{self.path}/experiments")
        return exp_id

    def log(self, exp_id: str, metrics: dict[str, float], step: int = 0) -> None:
        rows = [(exp_id, int(step), k, float(v)) for k, v in metrics.items()]
        self.spark.createDataFrame(rows, "exp_id string, step bigint, metric string, value double").write.mode("append").parquet(f"{self.path}/metrics")

    def load_all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/experiments").orderBy("exp_id")

    def top(self, metric: str, n: int = 5, higher_is_better: bool = True) -> DataFrame:
        """The n best experiments: by their best value if higher is better, else by their last."""
        rows = summary(self.spark.read.parquet(f"{self.path}/metrics")).where(F.col("metric") == metric)
        return rows.orderBy(F.desc("best") if higher_is_better else F.asc("last"), "exp_id").limit(n)

    def to_markdown(self) -> str:
        """A table of all experiments' metrics, which are few."""
        rows = summary(self.spark.read.parquet(f"{self.path}/metrics")).orderBy("exp_id", "metric").collect()
        head = "| experiment | metric | last | best | mean | steps |\n|-|-|-|-|-|-|\n"
        return head + "".join(f"| {r.exp_id} | {r.metric} | {r['last']} | {r.best} | {r['mean']} | {r.steps} |\n" for r in rows)
