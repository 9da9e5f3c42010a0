"""Naive Bayes classifiers: one grouped aggregation, then a projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NotFittedError, number


class _NaiveBayes:
    """Subclasses give the aggregates per class and feature, and the log likelihood of a class."""

    stats: dict | None = None

    def __init__(self, cols: Sequence[str], label: str, alpha: float = 1.0):
        self.cols, self.label, self.alpha = list(cols), label, alpha

    def aggregates(self) -> list[Column]:
        return [F.sum(number(c)).alias(f"s{i}") for i, c in enumerate(self.cols)]

    def fit(self, df: DataFrame) -> _NaiveBayes:
        rows = df.where(F.isnotnull(self.label)).groupBy(self.label).agg(F.count("*").alias("n"), *self.aggregates()).collect()  # a row a class
        self.stats = {r[self.label]: r.asDict() for r in rows}
        self.classes = sorted(self.stats)
        self.total = sum(r.n for r in rows)
        return self

    def likelihood(self, k) -> Column:
        raise NotImplementedError

    def weights(self, k) -> list[float]:
        """log((sum + alpha) / total) of each feature, for the count models."""
        raise NotImplementedError

    def log_joint(self) -> list[Column]:
        if self.stats is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return [F.lit(log(self.stats[k]["n"] / self.total)) + self.likelihood(k) for k in self.classes]

    def predict(self, df: DataFrame) -> DataFrame:
        """prediction: the likeliest class, of equal ones the first; null if no class was seen."""
        if self.stats is not None and not self.classes:
            return df.withColumn("prediction", F.lit(None).cast("int"))
        scores = F.array(*self.log_joint())
        return df.withColumn("prediction", F.element_at(F.array(*[F.lit(k) for k in self.classes]), F.array_position(scores, F.array_max(scores)).cast("int")))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """probability: an array of the classes' posteriors in order."""
        from ..functions.activations import softmax

        return df.withColumn("probability", softmax(F.array(*self.log_joint())))


class GaussianNB(_NaiveBayes):
    """Means and population variances (+ 1e-9) of each class."""

    def aggregates(self) -> list[Column]:
        return [f(number(c)).alias(f"{k}{i}") for i, c in enumerate(self.cols) for k, f in (("m", F.avg), ("v", F.var_pop))]

    def likelihood(self, k) -> Column:
        s, parts = self.stats[k], []
        for i, c in enumerate(self.cols):
            var = (s[f"v{i}"] or 0.0) + 1e-9
            d = number(c) - float(s[f"m{i}"] or 0.0)
            parts.append(F.lit(-0.5 * log(2 * pi * var)) - d * d / (2 * var))
        return reduce(lambda a, b: a + b, parts)


class _Counts(_NaiveBayes):
    def likelihood(self, k) -> Column:
        return reduce(lambda a, b: a + b, [number(c) * w for c, w in zip(self.cols, self.weights(k), strict=True)])


class MultinomialNB(_Counts):
    """Feature sums + alpha, over their total."""

    def weights(self, k) -> list[float]:
        sums = [(self.stats[k][f"s{i}"] or 0.0) + self.alpha for i in range(len(self.cols))]
        return [log(s / sum(sums)) for s in sums]


class BernoulliNB(_Counts):
    """Feature sums + alpha, over rows + 2 alpha; what is absent does not count."""

    def weights(self, k) -> list[float]:
        s = self.stats[k]
        return [log(((s[f"s{i}"] or 0.0) + self.alpha) / (s["n"] + 2 * self.alpha)) for i in range(len(self.cols))]
