"""Linear models from sufficient statistics: one aggregation over the rows, then a small solver on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import NotFittedError, number


class Gram:
    """Sums of products of the columns, of a leading 1, and of the target, over complete rows."""

    def __init__(self, df: DataFrame, cols: Sequence[str], target: str, weight: Column | None = None):
        names = [F.lit(1.0), *[number(c) for c in cols], number(target)]
        complete = reduce(lambda a, b: a & b, [F.isnotnull(x) for x in names[1:]])
        w = weight if weight is not None else F.lit(1.0)
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        row = df.where(complete).agg(*[F.coalesce(F.sum(w * names[i] * names[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs]).first()
        full = np.zeros((len(names), len(names)))
        for i, j in pairs:
            full[i, j] = full[j, i] = row[f"g{i}_{j}"]
        self.xx, self.xy, self.yy, self.n = full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0]


class _Linear:
    coef: np.ndarray | None = None
    intercept = 0.0

    def __init__(self, cols: Sequence[str], target: str):
        self.cols, self.target = list(cols), target

    def fit(self, df: DataFrame) -> _Linear:
        self.solve(Gram(df, self.cols, self.target))
        return self

    def solve(self, gram: Gram) -> None:
        raise NotImplementedError

    def decision(self) -> Column:
        if self.coef is None:
            raise NotFittedError(f"{type(self).__name__} is not fitted")
        return reduce(lambda a, b: a + b, [number(c) * float(w) for c, w in zip(self.cols, self.coef, strict=True)], F.lit(float(self.intercept)))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.decision())

    def score(self, df: DataFrame) -> float:
        """Coefficient of determination, 0 for a target that does not vary."""
        from .metrics import r2

        return self.predict(df).agg(r2(self.target, "prediction", constant=0.0)).first()[0]


class LinearRegression(_Linear):
    """Ordinary least squares of smallest norm."""

    def __init__(self, cols: Sequence[str], target: str, fit_intercept: bool = True):
        super().__init__(cols, target)
        self.fit_intercept = fit_intercept

    def solve(self, gram: Gram) -> None:
        at = slice(0 if self.fit_intercept else 1, None)
        w = np.linalg.pinv(gram.xx[at, at], hermitian=True) @ gram.xy[at]
        self.intercept, self.coef = (w[0], w[1:]) if self.fit_intercept else (0.0, w)


class Ridge(_Linear):
    """Least squares with alpha on the squares of the coefficients, not of the intercept."""

    def __init__(self, cols: Sequence[str], target: str, alpha: float = 1.0, fit_intercept: bool = True):
        super().__init__(cols, target)
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def solve(self, gram: Gram) -> None:
        at = slice(0 if self.fit_intercept else 1, None)
        penalty = self.alpha * np.eye(len(gram.xx))
        penalty[0, 0] = 0.0
        w = np.linalg.lstsq(gram.xx[at, at] + penalty[at, at], gram.xy[at], rcond=None)[0]
        self.intercept, self.coef = (w[0], w[1:]) if self.fit_intercept else (0.0, w)


class Lasso(_Linear):
    """Half the squared error plus alpha * n on the sizes of the coefficients, by cyclic coordinate descent on the sums."""

    def __init__(self, cols: Sequence[str], target: str, alpha: float = 1.0, max_iter: int = 1000, tol: float = 1e-4):
        super().__init__(cols, target)
        self.alpha, self.max_iter, self.tol = alpha, max_iter, tol

    def solve(self, gram: Gram) -> None:
        xx, xy, sx, sy = gram.xx[1:, 1:], gram.xy[1:], gram.xx[0, 1:], gram.xy[0]
        w, b = np.zeros(len(xx)), 0.0
        for _ in range(self.max_iter):
            before = w.copy()
            for j in range(len(w)):
                rho = xy[j] - b * sx[j] - xx[j] @ w + xx[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - self.alpha * gram.n, 0.0) / xx[j, j] if xx[j, j] else 0.0
            b = (sy - sx @ w) / max(gram.n, 1.0)
            if np.abs(w - before).sum() < self.tol:
                break
        self.coef, self.intercept = w, b


class ElasticNet(_Linear):
    """Mean squared error with both penalties, by subgradient steps on the sums."""

    def __init__(self, cols: Sequence[str], target: str, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 1000, learning_rate: float = 1e-3):
        super().__init__(cols, target)
        self.alpha, self.l1_ratio, self.max_iter, self.rate = alpha, l1_ratio, max_iter, learning_rate

    def solve(self, gram: Gram) -> None:
        xx, xy, sx, sy, n = gram.xx[1:, 1:], gram.xy[1:], gram.xx[0, 1:], gram.xy[0], max(gram.n, 1.0)
        w, b = np.zeros(len(xx)), 0.0
        for _ in range(self.max_iter):
            g = 2 * (xx @ w + b * sx - xy) / n + 2 * self.alpha * (1 - self.l1_ratio) * w + self.alpha * self.l1_ratio * np.sign(w)
            gb = 2 * (sx @ w + b * n - sy) / n
            w, b = w - self.rate * g, b - self.rate * gb
        self.coef, self.intercept = w, b


class LogisticRegression(_Linear):
    """Two classes, full-batch gradient descent from zero: one aggregation over the rows for each round."""

    def __init__(self, cols: Sequence[str], target: str, learning_rate: float = 0.01, max_iter: int = 1000):
        super().__init__(cols, target)
        self.rate, self.max_iter = learning_rate, max_iter

    def fit(self, df: DataFrame) -> LogisticRegression:
        classes = [r[0] for r in df.select(self.target).where(F.isnotnull(self.target)).distinct().orderBy(self.target).limit(3).collect()]
        if len(classes) != 2:
            raise ValueError("two classes are needed")
        self.classes = classes
        rows = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(self.cols)], (F.col(self.target) == F.lit(classes[1])).cast("double").alias("y")).na.drop().persist()
        self.coef, self.intercept = np.zeros(len(self.cols)), 0.0
        for _ in range(self.max_iter):
            z = reduce(lambda a, b: a + b, [F.col(f"x{i}") * float(w) for i, w in enumerate(self.coef)], F.lit(float(self.intercept)))
            error = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0)))) - F.col("y")
            g = np.array(rows.agg(F.avg(error), *[F.avg(error * F.col(f"x{i}")) for i in range(len(self.cols))]).first(), float)
            self.intercept, self.coef = self.intercept - self.rate * g[0], self.coef - self.rate * g[1:]
        rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from ..functions.activations import sigmoid

        return df.withColumn("probability", sigmoid(self.decision()))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", F.when(F.col("probability") >= 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))


class LinearSVC(_Linear):
    """Two classes by hinge loss: averaged subgradient rounds over all rows, each one aggregation.

    A sequential pass row by row does not exist on a cluster; the objective is the same, 2 C w / n decay and a step of
    learning_rate on the sum of violated rows' gradients over n.
    """

    def __init__(self, cols: Sequence[str], target: str, C: float = 1.0, learning_rate: float = 0.1, n_iterations: int = 100):
        super().__init__(cols, target)
        self.C, self.rate, self.rounds = C, learning_rate, n_iterations

    def violated(self, z: Column, y: Column) -> Column:
        return F.when(y * z < 1, -y).otherwise(F.lit(0.0))

    def labelled(self, df: DataFrame) -> Column:
        classes = [r[0] for r in df.select(self.target).where(F.isnotnull(self.target)).distinct().orderBy(self.target).limit(3).collect()]
        if len(classes) != 2:
            raise ValueError("two classes are needed")
        self.classes = classes
        return F.when(F.col(self.target) == F.lit(classes[1]), F.lit(1.0)).otherwise(F.lit(-1.0))

    def fit(self, df: DataFrame) -> LinearSVC:
        rows = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(self.cols)], self.labelled(df).alias("y")).na.drop().persist()
        n = max(1, rows.count())
        self.coef, self.intercept = np.zeros(len(self.cols)), 0.0
        for _ in range(self.rounds):
            z = reduce(lambda a, b: a + b, [F.col(f"x{i}") * float(w) for i, w in enumerate(self.coef)], F.lit(float(self.intercept)))
            d = self.violated(z, F.col("y"))
            g = np.array([v or 0.0 for v in rows.agg(F.avg(d), *[F.avg(d * F.col(f"x{i}")) for i in range(len(self.cols))]).first()])
            self.intercept -= self.rate * g[0]
            self.coef = self.coef - self.rate * (g[1:] + 2 * self.C * self.coef / n)
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.when(self.decision() >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))


class LinearSVR(LinearSVC):
    """Regression that ignores errors up to epsilon, in the same rounds."""

    def __init__(self, cols: Sequence[str], target: str, C: float = 1.0, epsilon: float = 0.1, learning_rate: float = 0.1, n_iterations: int = 100):
        super().__init__(cols, target, C, learning_rate, n_iterations)
        self.epsilon = epsilon

    def labelled(self, df: DataFrame) -> Column:
        return number(self.target)

    def violated(self, z: Column, y: Column) -> Column:
        return F.when(F.abs(z - y) > self.epsilon, F.signum(z - y)).otherwise(F.lit(0.0))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.decision())


def kernel_decision(queries: DataFrame, train: DataFrame, id_col: str, target: str, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, weight: float = 0.01, bias: float = 0.0) -> DataFrame:
    """(id, decision): weight * the sum over all training rows of target * kernel(query, row), plus bias.

    Both frames have their vector in v, train its target (-1 and 1, or any number). gamma defaults to 1 / (dimensions *
    variance of the queries). Training rows are the query blocks here: each task adds up its rows' shares of a block.
    """
    from .kernels import summed

    if gamma is None:
        stats = queries.select(F.explode("v").alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
        first = queries.select(F.size("v")).first()
        gamma = 1 / ((first[0] if first else 1) * stats)
    return summed(queries, train, id_col, target, kernel, gamma, degree, weight, bias)


class SVC:
    """Two classes by a sum of kernels over all training rows (vectors in v), each with WEIGHT and its label of -1 or 1.

    The bias is the mean of label minus sum over the training rows, so fitting compares all of them with each other, in
    blocks of rows. Kernels are linear, rbf and poly; gamma defaults as in kernel_decision().
    """

    WEIGHT = 0.01

    def __init__(self, id_col: str, target: str, kernel: str = "rbf", gamma: float | None = None, degree: int = 3):
        self.id_col, self.target, self.kernel, self.gamma, self.degree = id_col, target, kernel, gamma, degree

    def support(self, df: DataFrame) -> DataFrame:
        classes = [r[0] for r in df.select(self.target).where(F.isnotnull(self.target)).distinct().orderBy(self.target).limit(3).collect()]
        if len(classes) != 2:
            raise ValueError("two classes are needed")
        self.classes = classes
        y = F.when(F.col(self.target) == F.lit(classes[1]), F.lit(1.0)).when(F.isnotnull(self.target), F.lit(-1.0))
        return df.select(self.id_col, "v", y.alias("__y"), F.lit(1.0).alias("__k")).where("__y is not null")

    def sums(self, df: DataFrame, bias: float = 0.0) -> DataFrame:
        return kernel_decision(df, self.rows, self.id_col, self.weights, self.kernel, self.gamma, self.degree, self.WEIGHT, bias)

    weights = "__y"

    def fit(self, df: DataFrame) -> SVC:
        self.rows = self.support(df)
        margins = self.sums(self.rows).join(self.rows.select(self.id_col, "__y"), self.id_col)
        self.intercept = self.offset(margins.withColumn("__e", F.col("__y") - F.col("decision")))
        return self

    def offset(self, errors: DataFrame) -> float:
        return errors.agg(F.coalesce(F.avg("__e"), F.lit(0.0))).first()[0]

    def decision_function(self, df: DataFrame) -> DataFrame:
        """(id, decision) of rows with their vector in v."""
        return self.sums(df.select(self.id_col, "v"), self.intercept)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(id, decision, probability of the second class)."""
        return self.decision_function(df).withColumn("probability", 1 / (1 + F.exp(-F.col("decision"))))

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, decision, prediction)."""
        return self.decision_function(df).withColumn("prediction", F.when(F.col("decision") >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))


class SVR(SVC):
    """Regression by the same sums, every training row counting alike; the bias is the mean error of the rows outside
    epsilon, or of all rows if none is."""

    weights = "__k"

    def __init__(self, id_col: str, target: str, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, epsilon: float = 0.1):
        super().__init__(id_col, target, kernel, gamma, degree)
        self.epsilon = epsilon

    def support(self, df: DataFrame) -> DataFrame:
        return df.select(self.id_col, "v", number(self.target).alias("__y"), F.lit(1.0).alias("__k")).where("__y is not null")

    def offset(self, errors: DataFrame) -> float:
        outside = F.avg(F.when(F.abs(F.col("__e")) > self.epsilon, F.col("__e")))
        return errors.agg(F.coalesce(outside, F.avg("__e"), F.lit(0.0))).first()[0]

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, prediction)."""
        return self.decision_function(df).withColumnRenamed("decision", "prediction")
