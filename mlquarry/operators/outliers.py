"""Outliers and anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .base import Transformer, literal, number
from .neighbors import nearest
from .quantiles import quantile
from .ranking import numbered


class OutlierDetector(Transformer):
    """iqr (fences 1.5 ranges beyond the quartiles, inclusive) or zscore (population deviation + 1e-10).

    action: remove rows with a column outside, cap values at the fences (mean +- threshold deviations), or flag rows: 1 in
    outlier_flag where all columns are inside. A missing value is not outside.
    """

    def __init__(self, cols: Sequence[str], method: str = "iqr", action: str = "remove", threshold: float | None = None):
        super().__init__(cols)
        if method not in ("iqr", "zscore") or action not in ("remove", "cap", "flag"):
            raise ValueError(f"unknown method {method!r} or action {action!r}")
        self.method, self.action = method, action
        self.threshold = threshold if threshold is not None else (1.5 if method == "iqr" else 3.0)

    def statistics(self) -> dict[str, Column]:
        return self.per_column(mean=F.avg, std=F.stddev_pop) if self.method == "zscore" else {}

    def quantiles(self) -> dict[str, tuple]:
        return self.per_column(q=lambda c: (c, [0.25, 0.75])) if self.method == "iqr" else {}

    def fences(self, col: str) -> tuple[float | None, float | None]:
        if self.method == "iqr":
            if not (q := self.get("q", col)):
                return None, None
            spread = self.threshold * (q[1] - q[0])
            return q[0] - spread, q[1] + spread
        mean, std = self.get("mean", col), self.get("std", col)
        if mean is None:
            return None, None
        return mean - self.threshold * (std + 1e-10), mean + self.threshold * (std + 1e-10)

    def inside(self) -> Column:
        tests = [F.coalesce(number(c).between(*map(literal, self.fences(c))), F.lit(True)) for c in self.cols]
        return reduce(lambda a, b: a & b, tests)

    def transform(self, df: DataFrame) -> DataFrame:
        self.check()
        if self.action == "remove":
            return df.where(self.inside())
        if self.action == "flag":
            return df.withColumn("outlier_flag", self.inside().cast("int"))
        capped = {}
        for c in self.cols:
            low, high = map(literal, self.fences(c))
            capped[c] = F.when(F.isnotnull(number(c)), F.greatest(F.least(number(c), high), low))
        return df.withColumns(capped)


class StatisticalAnomaly(Transformer):
    """score: the largest |z| over the columns (population deviation + 1e-10); prediction -1 above the threshold, else 1."""

    def __init__(self, cols: Sequence[str], threshold: float = 3.0):
        super().__init__(cols)
        self.threshold = threshold

    def statistics(self) -> dict[str, Column]:
        return self.per_column(mean=F.avg, std=F.stddev_pop)

    def columns(self) -> dict[str, Column]:
        z = [F.abs((number(c) - literal(self.get("mean", c))) / (literal(self.get("std", c)) + 1e-10)) for c in self.cols]
        score = F.greatest(*z) if len(z) > 1 else z[0]
        return {"score": score, "prediction": F.when(score > self.threshold, F.lit(-1)).otherwise(F.lit(1))}


class EllipticEnvelope(Transformer):
    """Mahalanobis distance by the sample covariance (pseudo-inverse, 1e-6 on the diagonal if it is deficient).

    prediction is -1 above the (1 - contamination) quantile of the scored rows, which transform() takes in a pass of its own.
    """

    def __init__(self, cols: Sequence[str], contamination: float = 0.1):
        super().__init__(cols)
        self.contamination = contamination

    def statistics(self) -> dict[str, Column]:
        out = self.per_column(mean=F.avg)
        for i, a in enumerate(self.cols):
            for j in range(i, len(self.cols)):
                out[f"cov_{i}_{j}"] = F.covar_samp(number(a), number(self.cols[j]))
        return out

    def accept(self, row) -> None:
        super().accept(row)
        d = len(self.cols)
        cov = np.array([[self.params[f"cov_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        if np.linalg.matrix_rank(cov) < d:
            cov = cov + 1e-6 * np.eye(d)
        self.precision = np.linalg.pinv(cov)

    def distance(self) -> Column:
        centred = [number(c) - literal(self.get("mean", c)) for c in self.cols]
        terms = [centred[i] * centred[j] * float(self.precision[i, j]) for i in range(len(self.cols)) for j in range(len(self.cols))]
        return F.sqrt(F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0)))

    def columns(self) -> dict[str, Column]:
        return {"score": self.distance()}

    def transform(self, df: DataFrame) -> DataFrame:
        self.check()
        scored = df.withColumn("score", self.distance())
        limit = quantile(scored, "score", 1 - self.contamination)
        return scored.withColumn("prediction", F.when(F.col("score") > literal(limit), F.lit(-1)).otherwise(F.lit(1)))


def flagged(scores: DataFrame, score: str, contamination: float) -> DataFrame:
    """prediction -1 where the score is above the (1 - contamination) quantile of all scores, else 1."""
    scores = cut(scores)
    limit = quantile(scores, score, 1 - contamination)
    return scores.withColumn("prediction", F.when(F.col(score) > literal(limit), F.lit(-1)).otherwise(F.lit(1)))


def knn_distance_outlier(df: DataFrame, id_col: str, k: int = 10, contamination: float = 0.1) -> DataFrame:
    """Mean distance to the k nearest rows, the row itself (at 0) included; flags the largest. df has its vectors in v."""
    rows = df.select(F.col(id_col).alias("nid"), "v")
    scores = nearest(df.select(id_col, "v"), rows, k, id_col, "nid").groupBy(id_col).agg(F.avg("distance").alias("score"))
    return flagged(scores, "score", contamination)


def simple_lof(df: DataFrame, id_col: str, n_neighbors: int = 20, contamination: float = 0.1) -> DataFrame:
    """Mean density of the neighbours over one's own, density being 1 / (mean neighbour distance + 1e-10), without reach."""
    rows = df.select(F.col(id_col).alias("nid"), "v")
    graph = cut(nearest(df.select(id_col, "v"), rows, n_neighbors, id_col, "nid").select(id_col, "nid", "distance"))  # read twice
    density = graph.groupBy(id_col).agg((1 / (F.avg("distance") + 1e-10)).alias("density"))
    around = graph.join(density.select(F.col(id_col).alias("nid"), F.col("density").alias("other")), "nid").groupBy(id_col).agg(F.avg("other").alias("other"))
    scores = around.join(density, id_col).select(id_col, (F.col("other") / (F.col("density") + 1e-10)).alias("score"))
    return flagged(scores, "score", contamination)


def local_outlier_factor(df: DataFrame, id_col: str, n_neighbors: int = 20, contamination: float = 0.1) -> DataFrame:
    """LOF with reach distances: k-distance is the distance to the k-th other row, the k nearest include the row itself."""
    rows = df.select(F.col(id_col).alias("nid"), "v")
    graph = cut(nearest(df.select(id_col, "v"), rows, n_neighbors + 1, id_col, "nid"))  # read four times
    k_distance = graph.groupBy(id_col).agg(F.max("distance").alias("k_distance"))
    near = graph.where(F.col("rank") <= n_neighbors).join(k_distance.withColumnRenamed(id_col, "nid"), "nid")
    lrd = near.groupBy(id_col).agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"))
    around = near.join(lrd.select(F.col(id_col).alias("nid"), F.col("lrd").alias("other")), "nid").groupBy(id_col).agg(F.avg("other").alias("other"))
    scores = around.join(lrd, id_col).select(id_col, (F.col("other") / (F.col("lrd") + 1e-10)).alias("score"))
    return flagged(scores, "score", contamination)


def select_clean(losses: DataFrame, id_col: str, loss: str, forget_rate: float = 0.2, epoch: int = 0, warm_up_epochs: int = 5) -> DataFrame:
    """The rows of smallest loss, max(1, n * (1 - forget_rate)) of them; all rows before warm-up ends.

    The cut is found by quantile and only its ties are ranked, so rows are not sorted in one place.
    """
    if epoch < warm_up_epochs:
        return losses
    n = losses.count()
    keep = max(1, int(n * (1 - forget_rate)))
    most = quantile(losses, loss, (keep - 1) / max(1, n - 1))
    below = losses.where(F.col(loss) < literal(most))
    ties = losses.where(F.col(loss) == literal(most))
    missing = keep - below.count()
    first = numbered(ties, [id_col], "__r").where(F.col("__r") < missing).drop("__r")
    return below.unionByName(first)


def clip_losses(losses: DataFrame, loss: str, clip: float | None) -> DataFrame:
    return losses if clip is None else losses.withColumn(loss, F.least(F.col(loss), F.lit(float(clip))))


def noise_estimate(history: DataFrame, id_col: str, loss: str, forget_rate: float = 0.2) -> float:
    """Share of samples whose mean loss over the epochs exceeds the (1 - forget_rate) quantile of these means."""
    means = cut(history.groupBy(id_col).agg(F.avg(loss).alias("m")))
    limit = quantile(means, "m", 1 - forget_rate)
    return means.agg(F.coalesce(F.avg((F.col("m") > literal(limit)).cast("double")), F.lit(0.0))).first()[0]
