"""Principal components and linear discriminants: moments in one aggregation, eigenvectors on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NotFittedError, number


def signed(vectors: np.ndarray) -> np.ndarray:
    """Rows turned so that their largest entry in size is positive."""
    at = np.abs(vectors).argmax(axis=1)
    return vectors * np.where(vectors[np.arange(len(vectors)), at] < 0, -1.0, 1.0)[:, None]


class _Projection:
    components: np.ndarray | None = None

    def __init__(self, cols: Sequence[str], n_components: int | None = None):
        self.cols, self.n = list(cols), n_components

    def columns(self) -> list[Column]:
        if self.components is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        centred = [number(c) - float(m) for c, m in zip(self.cols, self.mean, strict=True)]
        return [reduce(lambda a, b: a + b, [x * float(w) for x, w in zip(centred, row, strict=True)]) for row in self.components]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with c0, c1, ...: the projections on the components."""
        return df.withColumns({f"c{i}": c for i, c in enumerate(self.columns())})


class PCA(_Projection):
    """Eigenvectors of the sample covariance, largest eigenvalue first, each with its largest entry positive."""

    def fit(self, df: DataFrame) -> PCA:
        d = len(self.cols)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*[F.avg(number(c)) for c in self.cols], *[F.covar_samp(number(self.cols[i]), number(self.cols[j])) for i, j in pairs]).first()
        self.mean = np.array([v or 0.0 for v in row[:d]])
        self.covariance = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[d:], strict=True):
            self.covariance[i, j] = self.covariance[j, i] = v or 0.0
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(values)[::-1][: self.n or d]
        self.explained, self.components = values[order], signed(vectors[:, order].T)
        return self

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for k, c in enumerate(self.cols):
            out[c] = reduce(lambda a, b: a + b, [F.col(f"c{i}") * float(self.components[i, k]) for i in range(len(self.components))], F.lit(float(self.mean[k])))
        return df.withColumns(out)


class LDA(_Projection):
    """Directions of most scatter between classes over scatter within them, real by symmetric whitening."""

    def __init__(self, cols: Sequence[str], label: str, n_components: int | None = None):
        super().__init__(cols, n_components)
        self.label = label

    def fit(self, df: DataFrame) -> LDA:
        d = len(self.cols)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        x = [number(c) for c in self.cols]
        rows = df.where(F.isnotnull(self.label)).groupBy(self.label).agg(F.count("*"), *[F.avg(v) for v in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).collect()  # a row a class
        if not rows:
            self.mean, self.components, self.strength = np.zeros(d), np.zeros((0, d)), np.zeros(0)
            return self
        n = np.array([r[1] for r in rows], float)
        means = np.array([r[2 : 2 + d] for r in rows], float)
        self.mean = n @ means / n.sum()
        within = np.zeros((d, d))
        for r in rows:
            for (i, j), v in zip(pairs, r[2 + d :], strict=True):
                within[i, j] += r[1] * v
                within[j, i] = within[i, j]
        between = (means - self.mean).T @ ((means - self.mean) * n[:, None])
        values, vectors = np.linalg.eigh(within)
        scale = vectors / np.sqrt(np.maximum(values, 1e-12))
        strength, turned = np.linalg.eigh(scale.T @ between @ scale)
        order = np.argsort(strength)[::-1][: self.n or min(d, len(rows) - 1)]
        directions = (scale @ turned[:, order]).T
        self.strength = strength[order]
        self.components = signed(directions / np.linalg.norm(directions, axis=1, keepdims=True))
        return self
