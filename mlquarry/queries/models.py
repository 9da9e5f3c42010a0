"""Neighbours, anomalies, estimators, ensembles, clustering and decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import lifecycle as L
from ..operators import linear, neighbors, trees
from ..operators import outliers as O
from ..operators.bayes import BernoulliNB, GaussianNB, MultinomialNB
from ..operators.decomposition import LDA, PCA
from .common import Registry, r6, read, rounded

query = Registry()


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


VECS = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def asked(spark, sf_dir):
    """The query set: vectors whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("vec_id % 50 = 0")


def known(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("nid"), "v", "label")


NEAR = "WITH d AS (SELECT q.vec_id, r.vec_id AS nid, r.label, list_distance(q.v, r.v) AS d FROM {e} q, {e} r WHERE {w}), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) AS rk FROM d)"
ASKED, ALL = NEAR.format(e=VECS, w="q.vec_id % 50 = 0"), NEAR.format(e=VECS, w="true")


@query("knn_search", f"{ASKED} SELECT vec_id, nid, round(d, 6) AS distance, rk AS rank FROM k WHERE rk <= 10")
def knn_search(spark, sf_dir):
    out = neighbors.nearest(asked(spark, sf_dir), known(spark, sf_dir), 10, "vec_id", "nid")
    return out.select("vec_id", "nid", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("knn_classify", f"{ASKED}, c AS (SELECT vec_id, label, count(*) AS n FROM k WHERE rk <= 5 GROUP BY 1, 2) SELECT vec_id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1")
def knn_classify(spark, sf_dir):
    return neighbors.knn_classify(asked(spark, sf_dir), known(spark, sf_dir), "vec_id", "nid", "label", 5)


@query("knn_regress", f"{ASKED} SELECT vec_id, round(avg(label), 6) AS prediction FROM k WHERE rk <= 7 GROUP BY 1")
def knn_regress(spark, sf_dir):
    return rounded(neighbors.knn_regress(asked(spark, sf_dir), known(spark, sf_dir), "vec_id", "nid", "label", 7), "prediction")


@query("cosine_topk", f"WITH d AS (SELECT q.vec_id, r.vec_id AS nid, list_cosine_similarity(q.v, r.v) AS s FROM {VECS} q, {VECS} r WHERE q.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nid) AS rk FROM d) SELECT vec_id, nid, round(s, 6) AS similarity, rk AS rank FROM k WHERE rk BETWEEN 2 AND 10")
def cosine_topk(spark, sf_dir):
    out = neighbors.cosine_topk(asked(spark, sf_dir), known(spark, sf_dir), 10, "vec_id", "nid").where("rank > 1")
    return out.select("vec_id", "nid", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("range_join", f"{ASKED} SELECT vec_id, nid, round(d, 6) AS distance FROM d WHERE d <= 9")
def range_join(spark, sf_dir):
    return rounded(neighbors.within(asked(spark, sf_dir), known(spark, sf_dir), 9.0, "vec_id", "nid"), "distance")


def flags(score: str, source: str) -> str:
    return f", z AS ({source}), q AS (SELECT quantile_cont({score}, 0.9) AS q FROM z) SELECT vec_id, round(score, 6) AS score, CASE WHEN score > q THEN -1 ELSE 1 END AS prediction FROM z, q"


@query("knn_distance_outlier", ALL + flags("score", "SELECT vec_id, avg(d) AS score FROM k WHERE rk <= 10 GROUP BY 1"))
def knn_distance_outlier(spark, sf_dir):
    return rounded(O.knn_distance_outlier(vectors(spark, sf_dir), "vec_id", 10), "score")


@query("simple_lof", ALL + ", g AS (SELECT * FROM k WHERE rk <= 20), e AS (SELECT vec_id, 1 / (avg(d) + 1e-10) AS den FROM g GROUP BY 1)" + flags("score", "SELECT g.vec_id, avg(o.den) / (any_value(s.den) + 1e-10) AS score FROM g JOIN e o ON o.vec_id = g.nid JOIN e s ON s.vec_id = g.vec_id GROUP BY 1"))
def simple_lof(spark, sf_dir):
    return rounded(O.simple_lof(vectors(spark, sf_dir), "vec_id", 20), "score")


@query(
    "lof",
    ALL + ", r AS (SELECT vec_id, max(d) AS kd FROM k WHERE rk <= 21 GROUP BY 1), g AS (SELECT * FROM k WHERE rk <= 20), e AS (SELECT g.vec_id, 1 / (avg(greatest(d, kd)) + 1e-10) AS den FROM g JOIN r ON r.vec_id = g.nid GROUP BY 1)" + flags("score", "SELECT g.vec_id, avg(o.den) / (any_value(s.den) + 1e-10) AS score FROM g JOIN e o ON o.vec_id = g.nid JOIN e s ON s.vec_id = g.vec_id GROUP BY 1"),
)
def lof(spark, sf_dir):
    return rounded(O.local_outlier_factor(vectors(spark, sf_dir), "vec_id", 20), "score")


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    model = trees.IsolationForest("vec_id", 50).fit(df := vectors(spark, sf_dir))
    return rounded(model.predict(df).select("vec_id", "score", "prediction"), "score")


@query("kmeans_anomaly")
def kmeans_anomaly(spark, sf_dir):
    return rounded(C.kmeans_anomaly(vectors(spark, sf_dir), "vec_id", 5, max_iter=20), "score")


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def linear_regression(spark, sf_dir):
    model = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(lines(spark, sf_dir))
    return spark.range(1).select(F.lit(round(float(model.coef[0]), 4)).alias("slope"), F.lit(round(float(model.intercept), 2)).alias("intercept"))


@query(
    "ridge",
    "WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem), w AS (SELECT *, (xy - x * y / n) / (xx + 1000 - x * x / n) AS w FROM s) SELECT round(w, 4) AS slope, round((y - w * x) / n, 2) AS intercept FROM w",
)
def ridge(spark, sf_dir):
    model = linear.Ridge(["l_quantity"], "l_extendedprice", 1000.0).fit(lines(spark, sf_dir))
    return spark.range(1).select(F.lit(round(float(model.coef[0]), 4)).alias("slope"), F.lit(round(float(model.intercept), 2)).alias("intercept"))


@query("regression_predict", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, round(b + a * l_quantity, 2) AS prediction FROM lineitem, m")
def regression_predict(spark, sf_dir):
    model = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(df := lines(spark, sf_dir))
    return model.predict(df).select("l_orderkey", "l_linenumber", "l_quantity", F.round("prediction", 2).alias("prediction"))


def _weights(spark, model, cols):
    return spark.createDataFrame([(c, round(float(w), 3)) for c, w in zip([*cols, "intercept"], [*model.coef, model.intercept], strict=True)], "feature string, weight double")


@query("lasso")
def lasso(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return _weights(spark, linear.Lasso(cols, "l_extendedprice", 10.0).fit(lines(spark, sf_dir)), cols)


@query(
    "lasso_single",
    "WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem), w AS (SELECT *, sign(xy - x * y / n) * greatest(abs(xy - x * y / n) - 1000 * n, 0) / (xx - x * x / n) AS w FROM s) SELECT round(w, 4) AS slope, round((y - w * x) / n, 2) AS intercept FROM w",
)
def lasso_single(spark, sf_dir):
    """With one column the solution is known: the centred slope, nearer to 0 by the penalty."""
    model = linear.Lasso(["l_quantity"], "l_extendedprice", 1000.0, tol=1e-10).fit(lines(spark, sf_dir))
    return spark.range(1).select(F.lit(round(float(model.coef[0]), 4)).alias("slope"), F.lit(round(float(model.intercept), 2)).alias("intercept"))


@query("elasticnet")
def elasticnet(spark, sf_dir):
    cols = ["l_discount", "l_tax"]
    return _weights(spark, linear.ElasticNet(cols, "l_quantity", 0.1).fit(lines(spark, sf_dir)), cols)


PARTS = "(SELECT p_partkey, p_size / 50 AS a, p_retailprice / 2000 AS b, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') OR p_size > 25 THEN 1 ELSE 0 END AS y FROM part)"


def parts(spark, sf_dir):
    y = F.when(F.col("p_brand").isin("Brand#1", "Brand#2") | (F.col("p_size") > 25), 1).otherwise(0)
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), y.alias("y"))


def _logistic_sql(rounds: int, rate: float) -> str:
    ctes = [f"p AS {PARTS}", "w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS c)"]
    for i in range(rounds):
        z = "1 / (1 + exp(-(c + wa * a + wb * b))) - y"
        ctes.append(f"w{i + 1} AS (SELECT any_value(wa) - {rate} * avg(({z}) * a) AS wa, any_value(wb) - {rate} * avg(({z}) * b) AS wb, any_value(c) - {rate} * avg({z}) AS c FROM p, w{i})")
    return f"WITH {', '.join(ctes)} SELECT p_partkey, round(1 / (1 + exp(-(c + wa * a + wb * b))), 6) AS probability FROM p, w{rounds}"


@query("logistic_regression", _logistic_sql(5, 0.5))
def logistic_regression(spark, sf_dir):
    model = linear.LogisticRegression(["a", "b"], "y", 0.5, 5).fit(df := parts(spark, sf_dir))
    return rounded(model.predict_proba(df).select("p_partkey", "probability"), "probability")


def _rounds_sql(n: int, start: str, step: str, last: str) -> str:
    """A chain of steps, each over all rows p and the one row of weights before."""
    ctes = [f"p AS MATERIALIZED {PARTS}", "n AS (SELECT count(*) AS n FROM p)", f"w0 AS (SELECT {start})"]
    ctes += [f"w{i + 1} AS MATERIALIZED (SELECT {step} FROM p, n, w{i})" for i in range(n)]
    return f"WITH {', '.join(ctes)} SELECT p_partkey, {last} AS prediction FROM p, w{n}"


HINGE = "CASE WHEN (2 * y - 1) * (c + wa * a + wb * b) < 1 THEN 1 - 2 * y ELSE 0 END"
TUBE = "CASE WHEN abs(c + wa * a - b) > 0.1 THEN sign(c + wa * a - b) ELSE 0 END"


@query(
    "linear_svc",
    _rounds_sql(
        20, "0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS c",
        f"any_value(wa) - 0.1 * (avg(({HINGE}) * a) + 2 * any_value(wa) / any_value(n)) AS wa, any_value(wb) - 0.1 * (avg(({HINGE}) * b) + 2 * any_value(wb) / any_value(n)) AS wb, any_value(c) - 0.1 * avg({HINGE}) AS c",
        "CAST(c + wa * a + wb * b >= 0 AS INT)",
    ),
)
def linear_svc(spark, sf_dir):
    model = linear.LinearSVC(["a", "b"], "y", n_iterations=20).fit(df := parts(spark, sf_dir))
    return model.predict(df).select("p_partkey", "prediction")


@query(
    "linear_svr",
    _rounds_sql(20, "0.0::DOUBLE AS wa, 0.0::DOUBLE AS c", f"any_value(wa) - 0.1 * (avg(({TUBE}) * a) + 2 * any_value(wa) / any_value(n)) AS wa, any_value(c) - 0.1 * avg({TUBE}) AS c", "round(c + wa * a, 6)"),
)
def linear_svr(spark, sf_dir):
    model = linear.LinearSVR(["a"], "b", n_iterations=20).fit(df := parts(spark, sf_dir))
    return rounded(model.predict(df).select("p_partkey", "prediction"), "prediction")


@query("svc_decision", f"SELECT q.vec_id, round(0.01 * sum((CASE WHEN r.label < 5 THEN -1 ELSE 1 END) * exp(-0.005 * pow(list_distance(q.v, r.v), 2))), 6) AS decision FROM {VECS} q, {VECS} r WHERE q.vec_id % 50 = 0 GROUP BY 1")
def svc_decision(spark, sf_dir):
    train = vectors(spark, sf_dir).withColumn("y", F.when(F.col("label") < 5, -1.0).otherwise(1.0))
    return rounded(linear.kernel_decision(asked(spark, sf_dir), train, "vec_id", "y", "rbf", 0.005), "decision")


KERNEL = "exp(-0.005 * pow(list_distance(q.v, r.v), 2))"
PLUS = f"(SELECT *, CASE WHEN label < 5 THEN -1 ELSE 1 END AS y FROM {VECS})"


@query(
    "svc_predict",
    f"WITH e AS MATERIALIZED {PLUS}, m AS (SELECT q.vec_id, any_value(q.y) AS y, 0.01 * sum(r.y * {KERNEL}) AS m FROM e q, e r GROUP BY 1), b AS (SELECT avg(y - m) AS b FROM m) SELECT vec_id, round(m + b, 6) AS decision, CAST(m + b >= 0 AS INT) AS prediction FROM m, b WHERE vec_id % 50 = 0",
)
def svc_predict(spark, sf_dir):
    df = vectors(spark, sf_dir).withColumn("y", (F.col("label") >= 5).cast("int"))
    model = linear.SVC("vec_id", "y", "rbf", 0.005).fit(df)
    return rounded(model.predict(asked(spark, sf_dir)), "decision")


@query(
    "svr_predict",
    f"WITH e AS MATERIALIZED {VECS}, m AS (SELECT q.vec_id, any_value(q.label) AS y, 0.01 * sum(list_dot_product(q.v, r.v)) AS m FROM e q, e r GROUP BY 1), b AS (SELECT avg(y - m) FILTER (abs(y - m) > 0.5) AS b FROM m) SELECT vec_id, round(m + b, 6) AS prediction FROM m, b WHERE vec_id % 50 = 0",
)
def svr_predict(spark, sf_dir):
    model = linear.SVR("vec_id", "label", "linear", 1.0, epsilon=0.5).fit(vectors(spark, sf_dir))
    return rounded(model.predict(asked(spark, sf_dir)), "prediction")


def _nb_sql(stats: str, joint: str) -> str:
    return f"WITH p AS {PARTS}, s AS (SELECT y AS k, count(*) AS n, {stats} FROM p GROUP BY y), j AS (SELECT p_partkey, k, ln(n / (SELECT count(*) FROM p)) + {joint} AS l FROM p, s) SELECT p_partkey, arg_max(k, l) AS prediction FROM j GROUP BY 1"


GAUSS = " + ".join(f"(-0.5 * ln(2 * pi() * (v{c} + 1e-9)) - pow({c} - m{c}, 2) / (2 * (v{c} + 1e-9)))" for c in "ab")


@query("gaussian_nb", _nb_sql("avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb", GAUSS))
def gaussian_nb(spark, sf_dir):
    return GaussianNB(["a", "b"], "y").fit(df := parts(spark, sf_dir)).predict(df).select("p_partkey", "prediction")


@query("multinomial_nb", _nb_sql("sum(a) + 1 AS sa, sum(b) + 1 AS sb", "a * ln(sa / (sa + sb)) + b * ln(sb / (sa + sb))"))
def multinomial_nb(spark, sf_dir):
    return MultinomialNB(["a", "b"], "y").fit(df := parts(spark, sf_dir)).predict(df).select("p_partkey", "prediction")


@query("bernoulli_nb", _nb_sql("sum(a) AS sa, sum(b) AS sb", "a * ln((sa + 1) / (n + 2)) + b * ln((sb + 1) / (n + 2))"))
def bernoulli_nb(spark, sf_dir):
    return BernoulliNB(["a", "b"], "y").fit(df := parts(spark, sf_dir)).predict(df).select("p_partkey", "prediction")


def featured(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.array("a", "b").alias("v"), "y", "b")


@query(
    "decision_stump",
    f"WITH p AS {PARTS}, f AS (SELECT 'a' AS f, a AS x, y FROM p UNION ALL SELECT 'b', b, y FROM p), h AS (SELECT f, x, count(*) AS n, sum(y) AS s FROM f GROUP BY 1, 2), c AS (SELECT f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM h WINDOW w AS (PARTITION BY f ORDER BY x)), g AS (SELECT *, 2 * sl * (nl - sl) / nl + 2 * (s - sl) * (n - nl - (s - sl)) / (n - nl) AS i FROM c WHERE n > nl), b AS (SELECT * FROM g ORDER BY round(i, 9), f, x LIMIT 1) SELECT p_partkey, CASE WHEN (CASE WHEN f = 'a' THEN a ELSE p.b END) <= x THEN CAST(2 * sl > nl AS INTEGER) ELSE CAST(2 * (s - sl) > n - nl AS INTEGER) END AS prediction FROM p, b",
)
def decision_stump(spark, sf_dir):
    df = featured(spark, sf_dir).withColumn("v", F.array(F.element_at("v", 1)))  # few distinct values: exact thresholds
    model = trees.decision_tree_classifier("p_partkey", "y", max_depth=1).fit(df)
    return model.predict(df).select("p_partkey", "prediction")


def _fitted(name, make, column="y"):
    @query(name)
    def run(spark, sf_dir):
        df = featured(spark, sf_dir)
        out = make("p_partkey", column).fit(df).predict(df).select("p_partkey", "prediction")
        return rounded(out, "prediction") if dict(out.dtypes)["prediction"] == "double" else out

    return run


_fitted("decision_tree_classifier", lambda i, t: trees.decision_tree_classifier(i, t, max_depth=4, criterion="entropy"))
_fitted("decision_tree_regressor", lambda i, t: trees.decision_tree_regressor(i, t, max_depth=4), "b")
_fitted("random_forest_classifier", lambda i, t: trees.random_forest_classifier(i, t, 10, max_depth=4))
_fitted("random_forest_regressor", lambda i, t: trees.random_forest_regressor(i, t, 10, max_depth=4), "b")
_fitted("bagging_classifier", lambda i, t: trees.bagging_classifier(i, t, 5, 0.5, max_depth=3))
_fitted("bagging_regressor", lambda i, t: trees.bagging_regressor(i, t, 5, max_depth=3), "b")
_fitted("adaboost_classifier", lambda i, t: trees.Boosting(i, t, "adaboost", 5, 1.0))
_fitted("gradient_boosting_regressor", lambda i, t: trees.Boosting(i, t, "regression", 5), "b")
_fitted("gradient_boosting_classifier", lambda i, t: trees.Boosting(i, t, "logistic", 5))


def _boosted_sql(rounds: int) -> str:
    ctes = [f"r0 AS (SELECT p_partkey, a, b, 1.0::DOUBLE / count(*) OVER () AS w, 0.0::DOUBLE AS total FROM {PARTS})"]
    for i in range(rounds):
        ctes += [
            f"g{i} AS (SELECT sum(w * a * b) / sum(w * a * a) AS k, (sum(w * b) - sum(w * a) * sum(w * a * b) / sum(w * a * a)) / sum(w) AS c FROM r{i})",
            f"f{i} AS MATERIALIZED (SELECT r{i}.*, c + k * a AS fit, abs(b - c - k * a) AS miss FROM r{i}, g{i})",
            f"e{i} AS (SELECT 0.1 * (ln(1 - avg(w * miss)) - ln(avg(w * miss))) / 2 AS alpha FROM f{i})",
            f"r{i + 1} AS MATERIALIZED (SELECT p_partkey, a, b, w * exp(-alpha * miss) / sum(w * exp(-alpha * miss)) OVER () AS w, total + alpha * fit AS total FROM f{i}, e{i})",
        ]
    return f"WITH {', '.join(ctes)} SELECT p_partkey, round(total, 6) AS prediction FROM r{rounds}"


@query("adaboost_regressor", _boosted_sql(5))
def adaboost_regressor(spark, sf_dir):
    out = trees.adaboost_regressor(parts(spark, sf_dir), ["a"], "b", 5)
    return rounded(out.select("p_partkey", "prediction"), "prediction")


VOTES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER % 3 AS a, l_linenumber % 3 AS b, l_suppkey % 3 AS c, l_discount AS d, l_tax AS t FROM lineitem)"


def votes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("int") % 3).alias("a"), (F.col("l_linenumber") % 3).alias("b"), (F.col("l_suppkey") % 3).cast("int").alias("c"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


@query("weighted_vote", f"WITH w AS (SELECT *, (a = 0)::INT * 1.5 + (b = 0)::INT + (c = 0)::INT AS w0, (a = 1)::INT * 1.5 + (b = 1)::INT + (c = 1)::INT AS w1, (a = 2)::INT * 1.5 + (b = 2)::INT + (c = 2)::INT AS w2 FROM {VOTES}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS prediction FROM w")
def weighted_vote(spark, sf_dir):
    return trees.voting(votes(spark, sf_dir), ["a", "b", "c"], [1.5, 1.0, 1.0], [0, 1, 2]).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")


@query("soft_vote", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (d * 5 + t * 10) / 2 >= ((1 - d * 5) + (1 - t * 10)) / 2 THEN 0 ELSE 1 END AS prediction FROM {VOTES}")
def soft_vote(spark, sf_dir):
    d, t = F.col("d") * 5, F.col("t") * 10
    df = votes(spark, sf_dir).withColumns({"x": F.array(d, 1 - d), "y": F.array(t, 1 - t)})
    return trees.soft_voting(df, ["x", "y"], [0, 1]).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")


@query("voting_regressor", f"SELECT l_orderkey, l_linenumber, l_partkey, round((2 * d + t) / 3, 6) AS prediction FROM {VOTES}")
def voting_regressor(spark, sf_dir):
    return rounded(trees.mean_voting(votes(spark, sf_dir), ["d", "t"], [2.0, 1.0]).select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), "prediction")


START = f"c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v FROM {VECS} WHERE vec_id < 4)"
STEP = "a AS (SELECT e.vec_id, e.v, c.cluster, list_distance(e.v, c.v) AS d FROM {e} e, {c} c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY d, c.cluster) = 1)"


def start(spark, sf_dir):
    return np.array([r.v for r in vectors(spark, sf_dir).where("vec_id < 4").orderBy("vec_id").collect()])


@query("kmeans_assign", f"WITH {START}, {STEP.format(e=VECS, c='c')} SELECT vec_id, cluster::INTEGER AS cluster, round(d, 6) AS distance FROM a")
def kmeans_assign(spark, sf_dir):
    return rounded(C.assign(vectors(spark, sf_dir), start(spark, sf_dir)).select("vec_id", "cluster", "distance"), "distance")


@query("kmeans_lloyd", f"WITH {START}, {STEP.format(e=VECS, c='c')}, u AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a) SELECT cluster::INTEGER AS cluster, round(sum(m), 4) AS total FROM (SELECT cluster, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1")
def kmeans_lloyd(spark, sf_dir):
    model = C.KMeans("vec_id", 4, init=start(spark, sf_dir))
    moved = model.step(vectors(spark, sf_dir))
    return spark.createDataFrame([(i, round(float(c.sum()), 4)) for i, c in enumerate(moved)], "cluster int, total double")


def _kmeans_sql(rounds: int) -> str:
    ctes = [f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v FROM {VECS} WHERE vec_id < 4)"]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS (SELECT e.vec_id, e.v, c.cluster FROM {VECS} e, c{k} c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.v, c.v), c.cluster) = 1)")
        ctes.append(f"c{k + 1} AS (SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{k}) GROUP BY 1, 2) GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, cluster::INTEGER AS cluster FROM a{rounds}"


@query("kmeans_rounds", _kmeans_sql(3))
def kmeans_rounds(spark, sf_dir):
    return C.KMeans("vec_id", 4, 3, init=start(spark, sf_dir)).fit(df := vectors(spark, sf_dir)).predict(df).select("vec_id", "cluster")


@query("kmeans")
def kmeans(spark, sf_dir):
    return C.KMeans("vec_id", 4, 10).fit(df := vectors(spark, sf_dir)).predict(df).select("vec_id", "cluster")


EPS = 9.2


@query(
    "dbscan",
    f"WITH RECURSIVE n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM {VECS} a, {VECS} b WHERE list_distance(a.v, b.v) <= {EPS}), k AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), e AS (SELECT n.a, n.b FROM n JOIN k x ON x.a = n.a JOIN k y ON y.a = n.b), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), l AS (SELECT a, min(b) AS c FROM r GROUP BY a), o AS (SELECT n.a, min(l.c) AS c FROM n JOIN l ON l.a = n.b GROUP BY n.a) SELECT vec_id, coalesce(l.c, o.c, -1) AS cluster, l.a IS NOT NULL AS core FROM embeddings LEFT JOIN l ON l.a = vec_id LEFT JOIN o ON o.a = vec_id",
)
def dbscan(spark, sf_dir):
    return C.dbscan(vectors(spark, sf_dir), "vec_id", EPS, 4)


@query("agglomerative")
def agglomerative(spark, sf_dir):
    return C.agglomerative(vectors(spark, sf_dir), "vec_id", 5, "average")


@query("pca_covariance", "SELECT 0 AS i, 1 AS j, round(covar_samp(l_quantity, l_discount), 6) AS v FROM lineitem UNION ALL SELECT 0, 0, round(var_samp(l_quantity), 6) FROM lineitem UNION ALL SELECT 1, 1, round(var_samp(l_discount), 6) FROM lineitem")
def pca_covariance(spark, sf_dir):
    cov = PCA(["l_quantity", "l_discount"]).fit(lines(spark, sf_dir)).covariance
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 6)) for i in range(2) for j in range(i, 2)], "i int, j int, v double")


@query(
    "pca",
    "WITH s AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) AS a, covar_samp(p_size, p_retailprice) AS b, var_samp(p_retailprice) AS c FROM part), e AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 AS l FROM s), u AS (SELECT *, b / sqrt(b * b + pow(l - a, 2)) AS x, (l - a) / sqrt(b * b + pow(l - a, 2)) AS y FROM e) SELECT p_partkey, round(((p_size - ma) * x + (p_retailprice - mb) * y) * CASE WHEN (abs(x) >= abs(y) AND x < 0) OR (abs(y) > abs(x) AND y < 0) THEN -1 ELSE 1 END, 4) AS c0 FROM part, u",
)
def pca(spark, sf_dir):
    out = PCA(["p_size", "p_retailprice"], 1).fit(df := read(spark, sf_dir, "part")).transform(df)
    return out.select("p_partkey", F.round("c0", 4).alias("c0"))


@query(
    "lda",
    f"WITH p AS {PARTS}, s AS (SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab FROM p GROUP BY y), w AS (SELECT sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab, sum(n * ma) / sum(n) AS ma, sum(n * mb) / sum(n) AS mb, max(ma) FILTER (y = 1) - max(ma) FILTER (y = 0) AS da, max(mb) FILTER (y = 1) - max(mb) FILTER (y = 0) AS db FROM s), d AS (SELECT *, bb * da - ab * db AS u, aa * db - ab * da AS v FROM w) SELECT p_partkey, round(((a - ma) * u + (b - mb) * v) / sqrt(u * u + v * v) * CASE WHEN (abs(u) >= abs(v) AND u < 0) OR (abs(v) > abs(u) AND v < 0) THEN -1 ELSE 1 END, 6) AS c0 FROM p, d",
)
def lda(spark, sf_dir):
    model = LDA(["a", "b"], "y", 1).fit(df := parts(spark, sf_dir))
    if not len(model.components):  # no rows, no direction
        return df.select("p_partkey", F.lit(None).cast("double").alias("c0"))
    return rounded(model.transform(df).select("p_partkey", "c0"), "c0")


@query("zero_shot", f"WITH c AS (SELECT 'c' || vec_id AS n, vec_id, v FROM {VECS} WHERE vec_id < 3), s AS (SELECT e.vec_id, c.n, list_cosine_similarity(e.v, c.v) AS s, c.vec_id AS o FROM {VECS} e, c) SELECT vec_id, n AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, o) = 1")
def zero_shot(spark, sf_dir):
    df = vectors(spark, sf_dir)
    classes = [(f"c{r.vec_id}", r.v) for r in df.where("vec_id < 3").orderBy("vec_id").collect()]
    return L.zero_shot(df, classes).select("vec_id", "prediction")


@query(
    "contrastive_loss",
    f"WITH e AS (SELECT vec_id // 100 AS batch, vec_id, v FROM {VECS}), p AS (SELECT x.batch, x.vec_id AS i, y.vec_id AS j, list_cosine_similarity(x.v[1:32], y.v[33:64]) / 0.07 AS z FROM e x JOIN e y USING (batch)), a AS (SELECT batch, avg(l) AS l FROM (SELECT batch, i, ln(sum(exp(z))) - max(CASE WHEN i = j THEN z END) AS l FROM p GROUP BY batch, i) GROUP BY batch), b AS (SELECT batch, avg(l) AS l FROM (SELECT batch, j, ln(sum(exp(z))) - max(CASE WHEN i = j THEN z END) AS l FROM p GROUP BY batch, j) GROUP BY batch) SELECT batch, round((a.l + b.l) / 2, 6) AS loss FROM a JOIN b USING (batch)",
)
def contrastive_loss(spark, sf_dir):
    """Halves of the embeddings as two views, in batches of a hundred."""
    pairs = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("batch"), "vec_id", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    return rounded(L.contrastive_losses(pairs, "batch", "vec_id", "a", "b"), "loss")


QUERIES, ORACLE_SQL = query.queries, query.sql
