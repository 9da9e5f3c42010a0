"""Scaling, imputing, encoding, features, outliers, diagnostics and metrics on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses, schedules
from ..operators import diagnostics as D
from ..operators import metrics as M
from ..operators.encoding import FrequencyEncoder, LabelEncoder, OneHotEncoder, OrdinalEncoder, TargetEncoder
from ..operators.features import CorrelationSelector, FeatureInteractions, PolynomialFeatures, VarianceThreshold, correlation_matrix
from ..operators.imputing import AutoPreprocessor, SimpleImputer, knn_impute
from ..operators.outliers import EllipticEnvelope, OutlierDetector, StatisticalAnomaly, clip_losses, select_clean
from ..operators.scaling import MinMaxScaler, Normalizer, PowerTransformer, RobustScaler, StandardScaler, TypeConverter, box_cox, yeo_johnson
from ..plans.pipeline import Pipeline
from .common import Registry, r6, read, rounded

query = Registry()
X = ["l_quantity", "l_extendedprice", "l_discount"]
KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]
PLAIN = ", ".join(KEYS)


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*KEYS, *X)


def gaps(spark, sf_dir):
    """Order lines in which some quantities and discounts are missing."""
    return lines(spark, sf_dir).withColumn("l_quantity", F.nullif(F.col("l_quantity"), F.lit(13.0))).withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.05)))


GAPS = "(SELECT l_orderkey, l_partkey, l_linenumber, nullif(l_quantity, 13.0) AS l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS l_discount FROM lineitem)"


def scaled(formula: str) -> str:
    return f"SELECT {PLAIN}, " + ", ".join(f"round({formula.format(c=c)}, 6) AS {c}" for c in X) + " FROM lineitem"


@query("standard_scaler", scaled("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def standard_scaler(spark, sf_dir):
    return rounded(StandardScaler(X).fit_transform(lines(spark, sf_dir)), *X)


@query("standard_scaler_inverse", scaled("{c}"))
def standard_scaler_inverse(spark, sf_dir):
    scaler = StandardScaler(X).fit(df := lines(spark, sf_dir))
    return rounded(scaler.inverse_transform(scaler.transform(df)), *X)


@query("minmax_scaler", scaled("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem) * 2 - 1"))
def minmax_scaler(spark, sf_dir):
    return rounded(MinMaxScaler(X, (-1.0, 1.0)).fit_transform(lines(spark, sf_dir)), *X)


@query("robust_scaler", scaled("({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def robust_scaler(spark, sf_dir):
    return rounded(RobustScaler(X).fit_transform(lines(spark, sf_dir)), *X)


NORMS = {"l1": "(abs(l_quantity) + abs(l_extendedprice) + abs(l_discount))", "l2": "sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount)", "max": "greatest(abs(l_quantity), abs(l_extendedprice), abs(l_discount))"}
for _norm, _sql in NORMS.items():
    query(f"row_normalize_{_norm}", scaled("{c} / " + _sql))(lambda spark, sf_dir, norm=_norm: rounded(Normalizer(X, norm).transform(lines(spark, sf_dir)), *X))


@query("power_transformer")
def power_transformer(spark, sf_dir):
    return rounded(PowerTransformer(X).fit_transform(lines(spark, sf_dir)), *X)


@query(
    "power_functions",
    "SELECT l_orderkey, l_linenumber, l_partkey, round((pow(l_quantity + 1, 0.5) - 1) / 0.5, 6) AS up, round(-(pow(1 + l_quantity, 1.5) - 1) / 1.5, 6) AS down, round((pow(l_extendedprice, 0.3) - 1) / 0.3, 6) AS box, round(ln(l_extendedprice), 6) AS logarithm FROM lineitem",
)
def power_functions(spark, sf_dir):
    """Yeo-Johnson on either side of 0 and Box-Cox, at given powers."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    made = {"up": yeo_johnson(x, 0.5), "down": yeo_johnson(-x, 0.5), "box": box_cox(y, 0.3), "logarithm": box_cox(y, 0.0)}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(n) for n, c in made.items()])


@query("type_converter", f"SELECT {PLAIN}, CAST(l_quantity AS INTEGER) AS l_quantity, CAST(l_extendedprice AS VARCHAR) IS NOT NULL AS priced FROM lineitem")
def type_converter(spark, sf_dir):
    out = TypeConverter(["l_extendedprice"], "str").transform(TypeConverter(["l_quantity"], "int32").transform(lines(spark, sf_dir)))
    return out.select(*KEYS, "l_quantity", F.isnotnull("l_extendedprice").alias("priced"))


FILLS = {
    "mean": "(SELECT avg({c}) FROM g)",
    "median": "(SELECT median({c}) FROM g)",
    "most_frequent": "(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)",
    "constant": "-1.0",
}
for _how, _sql in FILLS.items():
    query(f"impute_{_how}", f"WITH g AS {GAPS} SELECT {PLAIN}, " + ", ".join(f"round(coalesce({c}, {_sql.format(c=c)}), 6) AS {c}" for c in X) + " FROM g")(
        lambda spark, sf_dir, how=_how: rounded(SimpleImputer(X, how, -1.0 if how == "constant" else None).fit_transform(gaps(spark, sf_dir)), *X)
    )

FILLED = "(SELECT l_orderkey, l_partkey, l_linenumber, coalesce(l_quantity, (SELECT avg(l_quantity) FROM g)) AS l_quantity, l_extendedprice, coalesce(l_discount, (SELECT avg(l_discount) FROM g)) AS l_discount FROM g)"
PIPED = f"WITH g AS {GAPS}, f AS {FILLED} SELECT {PLAIN}, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 6) AS {c}" for c in X) + " FROM f"


@query("auto_preprocessor", PIPED)
def auto_preprocessor(spark, sf_dir):
    return rounded(AutoPreprocessor(X).fit_transform(gaps(spark, sf_dir)), *X)


@query("pipeline_impute_scale", PIPED)
def pipeline_impute_scale(spark, sf_dir):
    steps = Pipeline([("impute", SimpleImputer(X)), ("scale", StandardScaler(X))])
    return rounded(steps.fit_transform(gaps(spark, sf_dir)), *X)


@query(
    "knn_impute",
    """
WITH p AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal / 1000 AS b, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal * 2 END AS c FROM supplier),
d AS (SELECT q.s_suppkey, r.s_suppkey AS nid, r.c, sqrt(pow(q.a - r.a, 2) + pow(q.b - r.b, 2)) AS d FROM p q, p r WHERE q.c IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, nid) AS rk FROM d),
m AS (SELECT s_suppkey, avg(c) AS c FROM k WHERE rk <= 5 GROUP BY s_suppkey)
SELECT p.s_suppkey, round(a, 6) AS a, round(b, 6) AS b, round(coalesce(p.c, m.c), 6) AS c FROM p LEFT JOIN m USING (s_suppkey)
""",
)
def knn_impute_query(spark, sf_dir):
    p = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 1000).alias("b"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") * 2).alias("c"))
    return rounded(knn_impute(p, "s_suppkey", ["a", "b", "c"]), "a", "b", "c")


@query("polynomial_features", f'SELECT {PLAIN}, 1.0::DOUBLE AS "1", l_quantity AS q, l_discount AS d, round(l_quantity * l_quantity, 6) AS "q q", round(l_quantity * l_discount, 6) AS "q d", round(l_discount * l_discount, 6) AS "d d" FROM lineitem')
def polynomial_features(spark, sf_dir):
    df = lines(spark, sf_dir).select(*KEYS, F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return rounded(PolynomialFeatures(["q", "d"]).transform(df), "q q", "q d", "d d")


for _kind, _sign in {"multiply": "*", "add": "+", "subtract": "-", "divide": "/"}.items():
    _right = "({} + 1e-10)" if _kind == "divide" else "{}"
    query(f"feature_interactions_{_kind}", f"SELECT {PLAIN}, " + ", ".join(f"round({a} {_sign} {_right.format(b)}, 4) AS p{i}" for i, (a, b) in enumerate([(X[0], X[1]), (X[0], X[2]), (X[1], X[2])])) + " FROM lineitem")(
        lambda spark, sf_dir, kind=_kind: _interactions(spark, sf_dir, kind)
    )


def _interactions(spark, sf_dir, kind):
    made = FeatureInteractions(X, kind)
    names = made.get_feature_names()[len(X) :]
    return made.transform(lines(spark, sf_dir)).select(*KEYS, *[F.round(F.col(f"`{n}`"), 4).alias(f"p{i}") for i, n in enumerate(names)])


@query("variance_threshold", f"SELECT {PLAIN}, l_quantity, l_extendedprice FROM lineitem")
def variance_threshold(spark, sf_dir):
    return VarianceThreshold(X, 1.0).fit_transform(lines(spark, sf_dir))


@query("correlation_selector", f"SELECT {PLAIN}, l_quantity, l_discount FROM lineitem WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) > 0.5 FROM lineitem) UNION ALL SELECT {PLAIN}, l_quantity, l_discount FROM lineitem WHERE NOT (SELECT abs(corr(l_quantity, l_extendedprice)) > 0.5 FROM lineitem)")
def correlation_selector(spark, sf_dir):
    df = lines(spark, sf_dir)
    return CorrelationSelector(X, threshold=0.5).fit(df).transform(df).select(*KEYS, "l_quantity", "l_discount")


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM lineitem" for a, b in [(X[0], X[1]), (X[0], X[2]), (X[1], X[2])]))
def correlation_matrix_query(spark, sf_dir):
    return rounded(correlation_matrix(lines(spark, sf_dir), X), "r")


ORDERS = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]


def orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(*ORDERS)


RANK = "(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i FROM (SELECT DISTINCT {c} FROM orders))"


@query("label_encode", f"SELECT o_orderkey, i AS o_orderpriority FROM orders JOIN {RANK.format(c='o_orderpriority')} ON v = o_orderpriority")
def label_encode(spark, sf_dir):
    return LabelEncoder("o_orderpriority").fit(df := orders(spark, sf_dir)).transform(df).select("o_orderkey", "o_orderpriority")


@query("label_encode_inverse", "SELECT o_orderkey, o_orderpriority FROM orders")
def label_encode_inverse(spark, sf_dir):
    made = LabelEncoder("o_orderpriority").fit(df := orders(spark, sf_dir))
    return made.inverse_transform(made.transform(df)).select("o_orderkey", "o_orderpriority")


@query("ordinal_encode", f"SELECT o_orderkey, CAST(a.i AS DOUBLE) AS o_orderpriority, CAST(b.i AS DOUBLE) AS o_orderstatus FROM orders JOIN {RANK.format(c='o_orderpriority')} a ON a.v = o_orderpriority JOIN {RANK.format(c='o_orderstatus')} b ON b.v = o_orderstatus")
def ordinal_encode(spark, sf_dir):
    made = OrdinalEncoder(["o_orderpriority", "o_orderstatus"], "use_encoded_value")
    return made.fit(df := orders(spark, sf_dir)).transform(df).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("onehot_encode", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority[1] = '{i}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p{i}" for i in range(1, 6)) + " FROM orders")
def onehot_encode(spark, sf_dir):
    made = OneHotEncoder(["o_orderpriority"], "ignore").fit(df := orders(spark, sf_dir))
    return made.transform(df).select("o_orderkey", *[F.col(f"`o_orderpriority_{v}`").alias(f"p{v[0]}") for v in made.categories[0]])


@query("target_encode", "WITH m AS (SELECT avg(o_totalprice) AS m FROM orders), g AS (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_orderkey, round((s + 10 * m) / (n + 10), 4) AS o_orderpriority FROM orders JOIN g USING (o_orderpriority), m")
def target_encode(spark, sf_dir):
    made = TargetEncoder(["o_orderpriority"], "o_totalprice", smoothing=10.0)
    return made.fit(df := orders(spark, sf_dir)).transform(df).select("o_orderkey", F.round("o_orderpriority", 4).alias("o_orderpriority"))


@query("frequency_encode", "SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER (), 6) AS o_orderpriority FROM orders")
def frequency_encode(spark, sf_dir):
    return rounded(FrequencyEncoder(["o_orderpriority"]).fit(df := orders(spark, sf_dir)).transform(df).select("o_orderkey", "o_orderpriority"), "o_orderpriority")


PRICES = "(SELECT o_orderkey, o_totalprice FROM orders)"
FENCE = "WITH q AS (SELECT quantile_cont(o_totalprice, 0.4) AS a, quantile_cont(o_totalprice, 0.6) AS b, quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders), f AS (SELECT lo - 0.2 * (hi - lo) AS lo, hi + 0.2 * (hi - lo) AS hi FROM q)"


def prices(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_totalprice")


@query("outlier_iqr_remove", f"{FENCE} SELECT o_orderkey, o_totalprice FROM orders, f WHERE o_totalprice BETWEEN lo AND hi")
def outlier_iqr_remove(spark, sf_dir):
    return OutlierDetector(["o_totalprice"], "iqr", "remove", 0.2).fit_transform(prices(spark, sf_dir))


@query("outlier_iqr_cap", f"{FENCE} SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 6) AS o_totalprice FROM orders, f")
def outlier_iqr_cap(spark, sf_dir):
    return rounded(OutlierDetector(["o_totalprice"], "iqr", "cap", 0.2).fit_transform(prices(spark, sf_dir)), "o_totalprice")


@query("outlier_iqr_flag", f"{FENCE} SELECT o_orderkey, o_totalprice, CAST(o_totalprice BETWEEN lo AND hi AS INTEGER) AS outlier_flag FROM orders, f")
def outlier_iqr_flag(spark, sf_dir):
    return OutlierDetector(["o_totalprice"], "iqr", "flag", 0.2).fit_transform(prices(spark, sf_dir))


@query("outlier_zscore", "WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, o_totalprice, CAST(abs(o_totalprice - m) <= 1.5 * (s + 1e-10) AS INTEGER) AS outlier_flag FROM orders, m")
def outlier_zscore(spark, sf_dir):
    return OutlierDetector(["o_totalprice"], "zscore", "flag", 1.5).fit_transform(prices(spark, sf_dir))


@query(
    "statistical_anomaly",
    "WITH m AS (SELECT avg(s_acctbal) AS ma, stddev_pop(s_acctbal) AS sa, avg(s_nationkey) AS mb, stddev_pop(s_nationkey) AS sb FROM supplier), z AS (SELECT s_suppkey, greatest(abs(s_acctbal - ma) / (sa + 1e-10), abs(s_nationkey - mb) / (sb + 1e-10)) AS score FROM supplier, m) SELECT s_suppkey, round(score, 6) AS score, CASE WHEN score > 1.5 THEN -1 ELSE 1 END AS prediction FROM z",
)
def statistical_anomaly(spark, sf_dir):
    out = StatisticalAnomaly(["s_acctbal", "s_nationkey"], 1.5).fit_transform(read(spark, sf_dir, "supplier"))
    return rounded(out.select("s_suppkey", "score", "prediction"), "score")


@query(
    "elliptic_envelope",
    """
WITH m AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part),
d AS (SELECT p_partkey, sqrt((c * pow(p_size - ma, 2) - 2 * b * (p_size - ma) * (p_retailprice - mb) + a * pow(p_retailprice - mb, 2)) / (a * c - b * b)) AS score FROM part, m),
q AS (SELECT quantile_cont(score, 0.9) AS q FROM d)
SELECT p_partkey, round(score, 5) AS score, CASE WHEN score > q THEN -1 ELSE 1 END AS prediction FROM d, q
""",
)
def elliptic_envelope(spark, sf_dir):
    out = EllipticEnvelope(["p_size", "p_retailprice"]).fit_transform(read(spark, sf_dir, "part"))
    return out.select("p_partkey", F.round("score", 5).alias("score"), "prediction")


@query("class_distribution", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1")
def class_distribution(spark, sf_dir):
    return D.class_distribution(read(spark, sf_dir, "labels"), "quality")


@query("imbalance_ratio", "SELECT round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 5 AS severe FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")
def imbalance_ratio(spark, sf_dir):
    return rounded(D.imbalance_ratio(read(spark, sf_dir, "labels"), "quality", 5.0), "ratio")


@query("duplicate_rows", "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_rows(spark, sf_dir):
    return D.duplicate_count(read(spark, sf_dir, "documents"), ["text", "lang"])


@query("leakage_check", "SELECT count(*) AS n_shared FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def leakage_check(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return D.leakage_check(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["text"])


@query("feature_statistics", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median FROM lineitem" for c in X))
def feature_statistics(spark, sf_dir):
    return rounded(D.feature_statistics(lines(spark, sf_dir), X), "mean", "std")


@query("zscore_outlier_count", "WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s, avg(l_quantity) AS n, stddev_pop(l_quantity) AS t FROM lineitem) SELECT count(*) AS n_outliers FROM lineitem, m WHERE abs(l_extendedprice - m) / (s + 1e-12) > 1.6 OR abs(l_quantity - n) / (t + 1e-12) > 1.6")
def zscore_outlier_count(spark, sf_dir):
    return D.outlier_count(lines(spark, sf_dir), ["l_extendedprice", "l_quantity"], 1.6)


@query("label_noise_select", "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= greatest(1, CAST(floor(n * 0.8) AS BIGINT))")
def label_noise_select(spark, sf_dir):
    return select_clean(prices(spark, sf_dir), "o_orderkey", "o_totalprice", 0.2, epoch=9)


@query("label_noise_clip", "SELECT o_orderkey, least(o_totalprice, 100000.0) AS o_totalprice FROM orders")
def label_noise_clip(spark, sf_dir):
    return clip_losses(prices(spark, sf_dir), "o_totalprice", 100000.0)


def predictions(spark, sf_dir):
    """Order lines with a class and a guess at it from other columns."""
    df = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_quantity") < 17, 0).when(F.col("l_quantity") < 34, 1).otherwise(2)
    pred = F.when(F.col("l_extendedprice") < 30000, 0).when(F.col("l_extendedprice") < 60000, 1).otherwise(2)
    return df.select(label.alias("y"), pred.alias("p"), F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("e"), F.col("l_discount").alias("d"), (F.col("l_tax") * 10).alias("prob"), (F.col("l_linenumber") % 2).cast("double").alias("bit"))


PREDICTED = "(SELECT CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS y, CASE WHEN l_extendedprice < 30000 THEN 0 WHEN l_extendedprice < 60000 THEN 1 ELSE 2 END AS p, l_extendedprice AS t, l_quantity * 1500 AS e, l_discount AS d, l_tax * 10 AS prob, (l_linenumber % 2)::DOUBLE AS bit FROM lineitem)"


@query("accuracy", f"SELECT round(avg((y = p)::INTEGER), 6) AS accuracy FROM {PREDICTED}")
def accuracy(spark, sf_dir):
    return predictions(spark, sf_dir).agg(r6(M.accuracy("y", "p")).alias("accuracy"))


@query("confusion_matrix", f"SELECT y AS label, " + ", ".join(f"count(*) FILTER (p = {k}) AS c{k}" for k in range(3)) + f" FROM {PREDICTED} GROUP BY y")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir), "y", "p", 3)


PRF = " UNION ALL ".join(f"SELECT {k} AS label, count(*) FILTER (y = {k} AND p = {k}) / count(*) FILTER (p = {k}) AS a, count(*) FILTER (y = {k} AND p = {k}) / count(*) FILTER (y = {k}) AS b FROM {PREDICTED}" for k in range(3))


@query("precision_recall_f1", f"SELECT label, round(a, 6) AS precision, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS f1 FROM ({PRF})")
def precision_recall_f1(spark, sf_dir):
    return rounded(M.precision_recall_f1(predictions(spark, sf_dir), "y", "p", 3), "precision", "recall", "f1")


@query("macro_average", f"SELECT round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(2 * a * b / (a + b)), 6) AS f1 FROM ({PRF})")
def macro_average(spark, sf_dir):
    return rounded(M.macro_average(predictions(spark, sf_dir), "y", "p", 3), "precision", "recall", "f1")


@query("regression_metrics", f"SELECT round(avg(pow(e - t, 2)), 2) AS mse, round(avg(abs(e - t)), 4) AS mae, round(1 - sum(pow(t - e, 2)) / (var_pop(t) * count(*)), 6) AS r2 FROM {PREDICTED}")
def regression_metrics(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.round(M.mse("t", "e"), 2).alias("mse"), F.round(M.mae("t", "e"), 4).alias("mae"), r6(M.r2("t", "e")).alias("r2"))


@query(
    "losses",
    f"SELECT round(avg(CASE WHEN abs(d - prob) <= 0.3 THEN 0.5 * pow(d - prob, 2) ELSE 0.3 * (abs(d - prob) - 0.15) END), 6) AS huber, round(avg(-(bit * ln(prob * 0.9 + 0.05 + 1e-15) + (1 - bit) * ln(1 - (prob * 0.9 + 0.05) + 1e-15))), 6) AS bce, round(avg(ln(exp(d) + exp(prob) + exp(bit)) - CASE y WHEN 0 THEN d WHEN 1 THEN prob ELSE bit END), 6) AS ce FROM {PREDICTED}",
)
def losses_query(spark, sf_dir):
    d, p, bit = F.col("d"), F.col("prob"), F.col("bit")
    return predictions(spark, sf_dir).agg(
        r6(F.avg(losses.huber(p, d, 0.3))).alias("huber"), r6(F.avg(losses.binary_cross_entropy(p * 0.9 + 0.05, bit))).alias("bce"), r6(F.avg(losses.cross_entropy(F.array(d, p, bit), F.col("y")))).alias("ce")
    )


@query("latency_report", "SELECT event_type, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1")
def latency_report(spark, sf_dir):
    return rounded(M.latency(read(spark, sf_dir, "events"), "event_type", "value"), "mean_ms", "std_ms", "p95_ms")


@query("data_loader", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 32 AS place FROM orders")
def data_loader(spark, sf_dir):
    return schedules.batches(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 32)


QUERIES, ORACLE_SQL = query.queries, query.sql
