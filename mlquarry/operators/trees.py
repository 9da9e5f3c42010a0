"""Decision trees, forests and boosting, grown level by level.

A level of all trees is one pass: each task sorts its rows into the open nodes and adds up histograms of the features'
bins; the sums, at most nodes * features * bins rows, go to the driver, which splits the nodes. Bins are the distinct
values of a feature, or MAX_BINS quantiles where there are more. Rows are never gathered, whatever a node holds.
Frames have their features as an array of doubles in v and a key in the id column, which bootstraps and ties rest on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .neighbors import _vectors
from .quantiles import quantile

MAX_BINS = 256


@dataclass
class Tree:
    """Nodes as lists: feature (-1 for a leaf), threshold (left if <=), children and value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(x), np.int64)
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not inner.size:
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, threshold
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for name, blank in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
                getattr(self, name).append(blank)
        return self.left[node], self.right[node]


def bin_edges(df: DataFrame, d: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Candidate thresholds of each feature in order."""
    item = [F.element_at("v", i + 1) for i in range(d)]
    sizes = df.agg(*[F.approx_count_distinct(x, 0.01) for x in item]).first()
    wanted = [F.collect_set(x) if n <= max_bins else F.percentile_approx(x, F.array(*[F.lit((k + 1) / (max_bins + 1)) for k in range(max_bins)]), F.lit(20_000)) for x, n in zip(item, sizes, strict=True)]
    return [np.unique(np.array(v, float)) for v in df.agg(*wanted).first()]


def poisson(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a bootstrap of mean 1 draws each row: the same for a row and tree wherever it is computed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 7919 + seed * 104729 + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64
    limits = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))
    return np.searchsorted(limits, u, side="right").astype(float)


#: From (ids, x, y) to a list, a tree each, of (weights, targets), targets being class numbers or values.
Draw = Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def impurity(stats: np.ndarray, criterion: str) -> np.ndarray:
    """Of sums over rows (last axis: classes, or weight, y, y squared) the weight times the impurity."""
    if criterion == "mse":
        n, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
        return q - np.divide(s * s, n, out=np.zeros_like(n), where=n > 0)
    n = stats.sum(axis=-1, keepdims=True)
    p = np.divide(stats, n, out=np.zeros_like(stats), where=n > 0)
    each = 1 - (p * p).sum(axis=-1) if criterion == "gini" else -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)
    return n[..., 0] * each


def grow(df: DataFrame, id_col: str, target: str, draw: Draw, n_trees: int, n_classes: int, criterion: str = "gini", max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, features: list[list[int]] | None = None, edges: list[np.ndarray] | None = None) -> list[Tree]:
    """n_trees trees. n_classes is 0 for values. Of equal splits the first feature and lowest threshold is taken."""
    first = df.select(F.size("v")).first()
    d = first[0] if first else 0
    edges = edges if edges is not None else bin_edges(df, d) if d else []
    bins = max([len(e) for e in edges] or [1])
    width = n_classes or 3
    trees = [Tree() for _ in range(n_trees)]
    rows = df.select(F.col(id_col).cast("long").alias("id"), "v", F.col(target).cast("double").alias("y"))
    open_ = {(t, 0) for t in range(n_trees)}
    depth = 0
    while open_ and d:
        sent = df.sparkSession.sparkContext.broadcast((trees, sorted(open_), edges))

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trees, nodes, edges = sent.value
            place = {k: i for i, k in enumerate(nodes)}
            sums = np.zeros((len(nodes), d, bins, width))
            for batch in batches:
                ids, x, y = batch.column(0).to_numpy(), _vectors(batch.column(1)), batch.column(2).to_numpy()
                code = np.stack([np.minimum(np.searchsorted(e, x[:, j]), max(len(e) - 1, 0)) for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, d), int)
                for t, (weight, own) in enumerate(draw(ids, x, y)):
                    leaf = trees[t].leaves(x)
                    at = np.array([place.get((t, int(n)), -1) for n in range(len(trees[t].feature))])[leaf]
                    use = np.flatnonzero((at >= 0) & (weight > 0))
                    w = weight[use]
                    for j in range(d):
                        spot = (at[use], np.full(use.size, j), code[use, j])
                        if n_classes:
                            np.add.at(sums, (*spot, own[use].astype(int)), w)
                        else:
                            v = own[use]
                            for k, part in enumerate((w, w * v, w * v * v)):
                                np.add.at(sums, (*spot, np.full(use.size, k)), part)
            n, j, b = np.nonzero(sums.any(axis=3))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(j), pa.array(b), *[pa.array(sums[n, j, b, k]) for k in range(width)]], names=["n", "j", "b", *[f"s{k}" for k in range(width)]])

        parts = rows.mapInArrow(kernel, "n long, j long, b long, " + ", ".join(f"s{k} double" for k in range(width)))
        table = parts.groupBy("n", "j", "b").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toArrow()
        nodes = sorted(open_)
        stats = np.zeros((len(nodes), d, bins, width))
        stats[tuple(table[c].to_numpy() for c in "njb")] = np.stack([table[f"s{k}"].to_numpy() for k in range(width)], axis=1)
        open_ = set()
        for i, (t, node) in enumerate(nodes):
            tree, own = trees[t], stats[i]
            whole = own[0].sum(axis=0)
            count = whole.sum() if n_classes else whole[0]
            tree.value[node] = float(whole.argmax()) if n_classes else float(whole[1] / whole[0]) if whole[0] else 0.0
            pure = n_classes and (whole > 0).sum() <= 1
            if pure or count < min_samples_split or (max_depth is not None and depth >= max_depth):
                continue
            left = own.cumsum(axis=1)
            right = whole - left
            n_left, n_right = (left.sum(axis=2), right.sum(axis=2)) if n_classes else (left[..., 0], right[..., 0])
            gain = impurity(whole[None, None], criterion)[0, 0] - impurity(left, criterion) - impurity(right, criterion)
            gain[(n_left < min_samples_leaf) | (n_right < min_samples_leaf)] = -np.inf
            if features is not None:
                gain[[j for j in range(d) if j not in features[t]]] = -np.inf
            best = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
            if gain[best] == -np.inf or (not n_classes and gain[best] <= 1e-12):
                continue
            for child in tree.split(node, int(best[0]), float(edges[best[0]][best[1]])):
                open_.add((t, child))
        depth += 1
    return trees


def predict(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], kind: str = "double", name: str = "prediction") -> DataFrame:
    """df with function(features) as a column; the function travels with the tasks."""
    at = df.columns.index("v")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = function(_vectors(batch.column(at))) if batch.num_rows else np.array([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(values, float)).cast(pa.float64() if kind == "double" else pa.int32())], names=[*batch.schema.names, name])

    schema = df.select(*df.columns, F.lit(None).cast(kind).alias(name)).schema
    return df.mapInArrow(kernel, schema)


class Forest:
    """Trees over bootstraps of the rows (or over the rows as they are), voting or averaging.

    Classes are integers from 0; of equal votes the smallest class wins.
    """

    def __init__(self, id_col: str, target: str, classify: bool = True, n_estimators: int = 1, bootstrap: bool = False, max_features: float = 1.0, random_state: int = 0, **limits):
        self.id_col, self.target, self.classify = id_col, target, classify
        self.n, self.bootstrap, self.max_features, self.seed, self.limits = n_estimators, bootstrap, max_features, random_state, limits
        self.trees: list[Tree] | None = None

    def fit(self, df: DataFrame) -> Forest:
        self.k = int(df.agg(F.max(self.target)).first()[0] or 0) + 1 if self.classify else 0
        n, bootstrap, seed = self.n, self.bootstrap, self.seed
        draw = lambda ids, x, y: [(poisson(ids, t, seed) if bootstrap else np.ones(len(ids)), y) for t in range(n)]
        features = None
        if self.max_features < 1.0:
            first = df.select(F.size("v")).first()
            random = np.random.default_rng(seed)
            features = [sorted(random.choice(first[0], max(1, int(self.max_features * first[0])), replace=False).tolist()) for _ in range(n)] if first else None
        criterion = self.limits.get("criterion", "gini" if self.classify else "mse")
        self.trees = grow(df, self.id_col, self.target, draw, n, self.k, **(self.limits | {"criterion": criterion, "features": features}))
        return self

    def function(self) -> Callable[[np.ndarray], np.ndarray]:
        trees, k = self.trees, self.k

        def run(x: np.ndarray) -> np.ndarray:
            said = np.array([t.predict(x) for t in trees])
            if not k:
                return said.mean(axis=0)
            return np.array([(said == c).sum(axis=0) for c in range(k)]).argmax(axis=0)

        return run

    def predict(self, df: DataFrame) -> DataFrame:
        return predict(df, self.function(), "int" if self.classify else "double")


def decision_tree_classifier(id_col: str, target: str, **limits) -> Forest:
    return Forest(id_col, target, True, **limits)


def decision_tree_regressor(id_col: str, target: str, **limits) -> Forest:
    return Forest(id_col, target, False, **limits)


def random_forest_classifier(id_col: str, target: str, n_estimators: int = 100, **limits) -> Forest:
    return Forest(id_col, target, True, n_estimators, bootstrap=True, **limits)


def random_forest_regressor(id_col: str, target: str, n_estimators: int = 100, **limits) -> Forest:
    return Forest(id_col, target, False, n_estimators, bootstrap=True, **limits)


def bagging_classifier(id_col: str, target: str, n_estimators: int = 10, max_features: float = 1.0, **limits) -> Forest:
    return Forest(id_col, target, True, n_estimators, True, max_features, **limits)


def bagging_regressor(id_col: str, target: str, n_estimators: int = 10, max_features: float = 1.0, **limits) -> Forest:
    return Forest(id_col, target, False, n_estimators, True, max_features, **limits)


class Boosting:
    """Stumps one after the other: mode "regression" and "logistic" fit residuals, "adaboost" weighs rows anew.

    regression starts at the mean and adds learning_rate * stump; logistic does so for the log odds of class 1; adaboost
    (classes 0 and 1) raises the weight of rows a stump gets wrong and stops at an error of one half.
    """

    def __init__(self, id_col: str, target: str, mode: str = "regression", n_estimators: int = 100, learning_rate: float = 0.1):
        if mode not in ("regression", "logistic", "adaboost"):
            raise ValueError(f"unknown mode {mode!r}")
        self.id_col, self.target, self.mode, self.n, self.rate = id_col, target, mode, n_estimators, learning_rate
        self.stumps: list[tuple[float, Tree]] = []
        self.start = 0.0

    def raw(self) -> Callable[[np.ndarray], np.ndarray]:
        start, stumps, signed = self.start, list(self.stumps), self.mode == "adaboost"

        def run(x: np.ndarray) -> np.ndarray:
            total = np.full(len(x), start)
            for a, t in stumps:
                total += a * (2 * t.predict(x) - 1 if signed else t.predict(x))
            return total

        return run

    def fit(self, df: DataFrame) -> Boosting:
        df = df.select(self.id_col, "v", self.target).persist()
        mean, n = df.agg(F.avg(self.target), F.count(self.target)).first()
        first = df.select(F.size("v")).first()
        edges = bin_edges(df, first[0]) if first else []
        self.stumps, self.start = [], 0.0
        if self.mode == "regression":
            self.start = float(mean or 0.0)
        elif self.mode == "logistic":
            p = min(max(float(mean or 0.5), 1e-9), 1 - 1e-9)
            self.start = float(np.log(p / (1 - p)))
        for _ in range(self.n):
            raw, mode = self.raw(), self.mode

            def draw(ids: np.ndarray, x: np.ndarray, y: np.ndarray, raw=raw, mode=mode) -> list:
                z = raw(x)
                if mode == "adaboost":
                    return [(np.exp(-np.clip((2 * y - 1) * z, -50, 50)), y)]
                return [(np.ones(len(y)), y - (z if mode == "regression" else 1 / (1 + np.exp(-np.clip(z, -500, 500)))))]

            tree = grow(df, self.id_col, self.target, draw, 1, 2 if mode == "adaboost" else 0, "gini" if mode == "adaboost" else "mse", max_depth=1, edges=edges)[0]
            if mode != "adaboost":
                self.stumps.append((self.rate, tree))
                continue
            said = predict(df, lambda x, t=tree: t.predict(x), name="__said")
            weighed = predict(said, raw, name="__z")
            w = F.exp(-F.greatest(F.least((2 * F.col(self.target) - 1) * F.col("__z"), F.lit(50.0)), F.lit(-50.0)))
            error = weighed.agg(F.sum(F.when(F.col("__said") != F.col(self.target), w).otherwise(F.lit(0.0))) / F.sum(w)).first()[0] or 0.0
            if error >= 0.5:
                break
            e = max(error, 1e-10)
            self.stumps.append((0.5 * self.rate * float(np.log((1 - e) / e)), tree))
            if error == 0.0:
                break
        df.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        raw = self.raw()
        if self.mode == "regression":
            return predict(df, raw)
        return predict(df, lambda x: (raw(x) >= 0).astype(float), "int")


def adaboost_regressor(df: DataFrame, cols: list[str], target: str, n_estimators: int = 50, learning_rate: float = 0.1) -> DataFrame:
    """df with prediction: sum over rounds of alpha * linear fit of the reweighted rows, alpha = rate * ln((1 - e) / e) / 2 of
    the weighted mean absolute error e. Each round is one weighted Gram aggregation and one for the error."""
    from .base import number
    from .linear import Gram

    rows = df.withColumn("__w", F.lit(1.0) / df.count())
    total = F.lit(0.0)
    for _ in range(n_estimators):
        gram = Gram(rows, cols, target, F.col("__w"))
        coef = np.linalg.pinv(gram.xx[1:, 1:], hermitian=True) @ gram.xy[1:]
        fit = F.lit((gram.xy[0] - gram.xx[0, 1:] @ coef) / max(gram.n, 1e-300))
        for c, w in zip(cols, coef, strict=True):
            fit = fit + number(c) * float(w)
        miss = F.abs(number(target) - fit)
        error = rows.agg(F.avg(F.col("__w") * miss)).first()[0] or 0.0
        e = min(max(error, 1e-10), 1 - 1e-10)
        alpha = float(learning_rate * (np.log(1 - e) - np.log(e)) / 2)
        total = total + alpha * fit
        moved = rows.withColumn("__w", F.col("__w") * F.exp(-alpha * miss))
        scale = moved.agg(F.sum("__w")).first()[0]
        if not scale:
            break
        rows = moved.withColumn("__w", F.col("__w") / scale)
    return df.withColumn("prediction", total)


def voting(df: DataFrame, votes: list[str], weights: list[float] | None = None, classes: list | None = None) -> DataFrame:
    """prediction: the class with most weight among the vote columns, of equal ones the first."""
    weights = weights or [1.0] * len(votes)
    if classes is None:
        raise ValueError("the classes must be given")
    totals = F.array(*[sum((F.when(F.col(v) == F.lit(c), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in zip(votes, weights, strict=True)), F.lit(0.0)) for c in classes])
    return df.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(totals, F.array_max(totals)).cast("int")))


def soft_voting(df: DataFrame, probabilities: list[str], classes: list, weights: list[float] | None = None) -> DataFrame:
    """prediction: the class with the largest (weighted) mean of arrays of probabilities, of equal ones the first."""
    weights = weights or [1.0] * len(probabilities)
    means = F.array(*[sum((F.element_at(p, i + 1) * float(w) for p, w in zip(probabilities, weights, strict=True)), F.lit(0.0)) / float(sum(weights)) for i in range(len(classes))])
    return df.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(means, F.array_max(means)).cast("int")))


def mean_voting(df: DataFrame, predictions: list[str], weights: list[float] | None = None) -> DataFrame:
    """prediction: the (weighted) mean of the columns."""
    weights = weights or [1.0] * len(predictions)
    return df.withColumn("prediction", sum((F.col(p).cast("double") * float(w) for p, w in zip(predictions, weights, strict=True)), F.lit(0.0)) / float(sum(weights)))


class IsolationForest:
    """Random trees over at most sample rows each, drawn by a hash of the id; score is minus two to the minus mean depth
    over the expected one, prediction -1 below the contamination quantile of the scored rows."""

    def __init__(self, id_col: str, n_estimators: int = 100, max_samples: int = 256, contamination: float = 0.1, random_state: int = 0):
        self.id_col, self.n, self.sample, self.contamination, self.seed = id_col, n_estimators, max_samples, contamination, random_state
        self.trees: list[tuple[Tree, np.ndarray]] = []

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, df: DataFrame) -> IsolationForest:
        # n * sample rows suffice for all trees: one draw, in order of a hash of the id, cut into the trees' shares
        drawn = df.select("v", F.xxhash64(F.lit(self.seed), self.id_col).alias("h")).orderBy("h").limit(self.n * self.sample).select("v").toArrow()
        x = _vectors(drawn["v"]) if drawn.num_rows else np.zeros((0, 1))
        random = np.random.default_rng(self.seed)
        self.psi = min(self.sample, len(x))
        limit = int(np.ceil(np.log2(max(self.psi, 2))))
        self.trees = []
        for _ in range(self.n if len(x) else 0):
            tree, size, depth = Tree(), [0], [0]
            work = [(0, random.choice(len(x), self.psi, replace=False))]
            while work:
                node, rows = work.pop()
                size[node] = len(rows)
                spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(x.shape[1])
                able = np.flatnonzero(spread > 0)
                if len(rows) <= 1 or depth[node] >= limit or not able.size:
                    continue
                f = int(random.choice(able))
                cut = float(random.uniform(x[rows, f].min(), x[rows, f].max()))
                below = x[rows, f] <= cut
                for child, own in zip(tree.split(node, f, cut), (rows[below], rows[~below]), strict=True):
                    size.append(0)
                    depth.append(depth[node] + 1)
                    work.append((child, own))
            tree.value = [d + self.expected(s) for d, s in zip(depth, size, strict=True)]
            self.trees.append((tree, np.array(size)))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        trees, norm = [t for t, _ in self.trees], self.expected(self.psi) or 1.0
        return predict(df, lambda x: -(2.0 ** (-np.mean([t.predict(x) for t in trees], axis=0) / norm)), name="score")

    def predict(self, df: DataFrame) -> DataFrame:
        scored = cut(self.score(df))
        limit = quantile(scored, "score", self.contamination)
        return scored.withColumn("prediction", F.when(F.col("score") < F.lit(limit), F.lit(-1)).otherwise(F.lit(1)))
