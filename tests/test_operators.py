"""Operators on small frames: goldens, edge cases and comparisons with numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlquarry.functions import activations, arrays, losses, schedules
from mlquarry.functions import text as T
from mlquarry.operators import clustering, decomposition, diagnostics, encoding, features, imputing, lifecycle, linear, metrics, neighbors, outliers, scaling, sequences, trees, vectorizing
from mlquarry.operators.base import NotFittedError
from mlquarry.plans.pipeline import Graph, Pipeline, TextPlan
from mlquarry.sources import files, tracker


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0), (4, None, 5.0), (5, float("nan"), 5.0)], "id int, a double, b double")


# scaling and imputing


def test_scalers_with_gaps_and_constant_columns(frame):
    got = values(scaling.StandardScaler(["a", "b"]).fit_transform(frame), "a", "b")
    x = np.array([1.0, 2.0, 4.0])
    assert [a for a, _ in got[:3]] == pytest.approx(list((x - x.mean()) / x.std())) and got[3][0] is got[4][0] is None
    assert {b for _, b in got} == {0.0}
    assert values(scaling.MinMaxScaler(["a", "b"], (2.0, 4.0)).fit_transform(frame), "a", "b")[:3] == [(2.0, 2.0), (pytest.approx(2 + 2 / 3), 2.0), (4.0, 2.0)]
    assert values(scaling.RobustScaler(["a"]).fit_transform(frame), "a")[:3] == pytest.approx([-1 / 1.5, 0.0, 2 / 1.5])


def test_unfitted_and_empty(spark, frame):
    with pytest.raises(NotFittedError):
        scaling.StandardScaler(["a"]).transform(frame)
    none = frame.where("false")
    for op in (scaling.StandardScaler(["a"]), scaling.MinMaxScaler(["a"]), scaling.RobustScaler(["a"]), imputing.SimpleImputer(["a"]), outliers.OutlierDetector(["a"]), outliers.StatisticalAnomaly(["a"])):
        assert op.fit_transform(none).collect() == []


def test_normalizer_leaves_zero_rows(spark):
    df = spark.createDataFrame([(1, 3.0, -4.0), (2, 0.0, 0.0)], "id int, a double, b double")
    assert values(scaling.Normalizer(["a", "b"]).transform(df), "a", "b") == [(0.6, -0.8), (0.0, 0.0)]
    with pytest.raises(ValueError):
        scaling.Normalizer(["a"], "l3")


def test_power_transformer_finds_the_likeliest_power(spark):
    x = np.exp(np.random.default_rng(0).normal(size=400))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, a double")
    assert scaling.PowerTransformer(["a"], "box-cox").fit(df).params["a"] == pytest.approx(0, abs=0.15)
    with pytest.raises(ValueError):
        scaling.PowerTransformer(["a"], "box-cox").fit(df.withColumn("a", -F.col("a")))


def test_imputers(frame, spark):
    assert values(imputing.SimpleImputer(["a"], "median").fit_transform(frame), "a") == [1.0, 2.0, 4.0, 2.0, 2.0]
    ties = spark.createDataFrame([(1, 7.0), (2, 3.0), (3, None)], "id int, a double")
    assert values(imputing.SimpleImputer(["a"], "most_frequent").fit_transform(ties), "a")[2] == 3.0
    empty = spark.createDataFrame([(1, None)], "id int, a double")
    assert values(imputing.SimpleImputer(["a"], "most_frequent").fit_transform(empty), "a") == [0.0]
    with pytest.raises(ValueError):
        imputing.SimpleImputer(["a"], "constant")
    auto = imputing.AutoPreprocessor(["a"]).fit(frame)
    assert auto.get_steps() == ["imputer", "scaler"] and imputing.AutoPreprocessor(["b"]).fit(frame).get_steps() == ["scaler"]


def test_knn_imputer_weights(spark):
    rows = [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 3.0, 30.0), (4, 0.5, None), (5, None, None), (6, None, 40.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = dict(zip(range(1, 7), values(imputing.knn_impute(df, "id", ["a", "b"], 2), "a", "b"), strict=True))
    # the row itself is the nearest candidate, and has no value to give
    assert got[4][1] == 10.0 and got[1] == (0.0, 10.0) and got[5] == (None, None)
    wide = dict(zip(range(1, 7), values(imputing.knn_impute(df, "id", ["a", "b"], 3, "distance"), "a", "b"), strict=True))
    assert wide[4][1] == pytest.approx(15.0)


# encoding, features


def test_encoders(spark):
    df = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "cat"), (4, "bird"), (5, None)], "id int, c string")
    made = encoding.LabelEncoder("c").fit(df)
    assert values(made.transform(df), "c") == [1, 2, 1, 0, None]
    assert values(made.inverse_transform(made.transform(df)), "c") == ["cat", "dog", "cat", "bird", None]
    new = spark.createDataFrame([(1, "cow")], "id int, c string")
    with pytest.raises(Exception, match="unknown value"):
        made.transform(new).collect()
    assert values(encoding.OrdinalEncoder(["c"], "use_encoded_value").fit(df).transform(new), "c") == [-1.0]
    hot = encoding.OneHotEncoder(["c"]).fit(df)
    assert hot.get_feature_names() == ["x0_bird", "x0_cat", "x0_dog"]
    assert values(hot.transform(df), "c_cat", "c_dog")[:2] == [(1.0, 0.0), (0.0, 1.0)]
    with pytest.raises(Exception, match="unknown value"):
        hot.transform(new).collect()
    assert values(encoding.FrequencyEncoder(["c"]).fit(df).transform(df), "c") == [0.4, 0.2, 0.4, 0.2, 0.0]


def test_target_encoder(spark):
    df = spark.createDataFrame(list(enumerate("ABACB")), "id int, c string").withColumn("y", F.element_at(F.array(*[F.lit(float(v)) for v in (1, 0, 1, 1, 0)]), F.col("id") + 1))
    got = values(encoding.TargetEncoder(["c"], "y", smoothing=1.0).fit(df).transform(df), "c")
    assert got[:2] == pytest.approx([(2 + 0.6) / 3, 0.6 / 3])
    assert values(encoding.TargetEncoder(["c"], "y", min_samples_leaf=2).fit(df).transform(df), "c")[3] == pytest.approx(0.6)


def test_dictionary_index_is_the_order(spark):
    df = spark.range(2000).select(F.sha1(F.col("id").cast("string")).alias("value"))
    got = [r.value for r in encoding.indexed(df).orderBy("idx").collect()]
    assert got == sorted(got) and [r.idx for r in encoding.indexed(df).orderBy("idx").limit(3).collect()] == [0, 1, 2]


def test_features(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 0.0)], "id int, a double, b double, z double")
    poly = features.PolynomialFeatures(["a", "b"], 3, interaction_only=True)
    assert poly.get_feature_names() == ["1", "a", "b", "a b", "a a b", "a b b"]
    assert values(poly.transform(df), "a a b", "a b b") == [(12.0, 18.0)]
    assert values(features.FeatureInteractions(["a", "z"], "divide").transform(df), "a/z") == [pytest.approx(2e10)]
    many = spark.range(20).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"), F.lit(1.0).alias("c"))
    assert features.VarianceThreshold(["a", "b", "c"]).fit_transform(many).columns == ["id", "a", "b"]
    assert features.CorrelationSelector(["a", "b", "c"]).fit_transform(many).columns == ["id", "a", "c"]
    assert features.CorrelationSelector(["b", "c"], "a").fit_transform(many).columns == ["id", "a", "b"]


# outliers, diagnostics, metrics


def test_outlier_actions(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)] + [(99, 100.0), (100, None)], "id int, a double")
    assert outliers.OutlierDetector(["a"]).fit_transform(df).count() == 41
    capped = values(outliers.OutlierDetector(["a"], action="cap").fit_transform(df), "a")
    assert max(v for v in capped if v is not None) < 10 and capped[-1] is None
    assert values(outliers.OutlierDetector(["a"], "zscore", "flag").fit_transform(df), "outlier_flag")[-2:] == [0, 1]
    with pytest.raises(ValueError):
        outliers.OutlierDetector(["a"], "other")


def test_label_noise(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 3, 3, 3, 9, 2, 2, 8])], "id int, loss double")
    assert sorted(r.id for r in outliers.select_clean(df, "id", "loss", 0.5, epoch=9).collect()) == [1, 2, 3, 7, 8]
    assert outliers.select_clean(df, "id", "loss", 0.5, epoch=1).count() == 10
    assert outliers.noise_estimate(df, "id", "loss", 0.2) == pytest.approx(0.2)
    assert max(values(outliers.clip_losses(df, "loss", 4.0), "loss")) == 4.0


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 1.0, 0), (3, 2.0, 1), (4, None, 0), (5, None, 0)], "id int, a double, y int")
    report = diagnostics.report(df, ["a"], "y", 3.0)
    assert report["class_distribution"] == {0: 4, 1: 1} and report["imbalance"] == {"ratio": 4.0, "severe": True} and report["duplicates"] == 2
    assert diagnostics.leakage_check(df, df.where("id = 4"), ["a"]).first().n_shared == 1


def test_metrics_goldens(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (1, 2), (0, 0)], "y int, p int")
    assert [tuple(r) for r in metrics.confusion_matrix(df, "y", "p", 3).orderBy("label").collect()] == [(0, 2, 0, 0), (1, 0, 1, 1), (2, 0, 1, 0)]
    rows = {r.label: r for r in metrics.precision_recall_f1(df, "y", "p", 4).collect()}
    assert rows[1].precision == 0.5 and rows[2].f1 == 0.0 and rows[3].recall == 0.0
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "t double, e double")
    assert flat.agg(metrics.r2("t", "e")).first()[0] == 1.0 and flat.agg(metrics.r2("t", "e", 0.0)).first()[0] == 0.0


# neighbours and models


def cloud(spark, n=200, d=3, seed=0, k=2):
    own = np.random.default_rng(seed)
    y = own.integers(0, k, n)
    x = own.normal(size=(n, d)) + y[:, None] * 3
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, v array<double>, y int").repartition(3), x, y


def test_nearest_in_blocks_with_ties(spark, monkeypatch):
    df, x, _ = cloud(spark, 120)
    doubled = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    monkeypatch.setattr(neighbors, "CELLS", 3000)
    got = neighbors.nearest(df.select("id", "v"), doubled.select(F.col("id").alias("nid"), "v"), 4, "id", "nid")
    for i in (0, 7, 119):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j + o) for j in range(120) for o in (0, 1000))[:4]
        assert [(round(r.distance, 9), r.nid) for r in got.where(F.col("id") == i).orderBy("rank").collect()] == [(round(a, 9), b) for a, b in d]


def test_linear_models_against_numpy(spark):
    own = np.random.default_rng(1)
    x = own.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 3 + own.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)] + [(None, 1.0, 5.0)], "a double, b double, t double")
    one = np.column_stack([np.ones(80), x])
    want = np.linalg.lstsq(one, y, rcond=None)[0]
    model = linear.LinearRegression(["a", "b"], "t").fit(df)
    assert [model.intercept, *model.coef] == pytest.approx(list(want)) and model.score(df.na.drop()) > 0.99
    ridge = linear.Ridge(["a", "b"], "t", 5.0).fit(df)
    assert [ridge.intercept, *ridge.coef] == pytest.approx(list(np.linalg.solve(one.T @ one + 5 * np.diag([0, 1, 1]), one.T @ y)))
    lasso = linear.Lasso(["a", "b"], "t", 0.5).fit(df)
    r = y - x @ lasso.coef - lasso.intercept
    assert abs(r.mean()) < 1e-3 and np.abs(x.T @ r) == pytest.approx(np.full(2, 0.5 * 80), rel=1e-3)
    net = linear.ElasticNet(["a", "b"], "t", 0.01, max_iter=5000, learning_rate=0.01).fit(df)
    assert net.coef == pytest.approx([2.0, -1.0], abs=0.1)
    with pytest.raises(NotFittedError):
        linear.Ridge(["a"], "t").predict(df)


def test_linear_classifiers(spark):
    df, x, y = cloud(spark, 200, 2)
    wide = df.select("id", F.element_at("v", 1).alias("a"), F.element_at("v", 2).alias("b"), "y")
    for model in (linear.LogisticRegression(["a", "b"], "y", 0.5, 60), linear.LinearSVC(["a", "b"], "y", n_iterations=60)):
        assert model.fit(wide).predict(wide).agg(metrics.accuracy("y", "prediction")).first()[0] > 0.93
    with pytest.raises(ValueError):
        linear.LogisticRegression(["a"], "y").fit(wide.where("y = 0"))
    svr = linear.LinearSVR(["a"], "b", n_iterations=150).fit(wide)
    assert svr.predict(wide).agg(metrics.mae("b", "prediction")).first()[0] < 1.5


def brute_split(x, y):
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            parts = [y[x[:, j] <= t], y[x[:, j] > t]]
            g = sum(len(p) * (1 - sum((p == c).mean() ** 2 for c in (0, 1))) for p in parts)
            if best is None or g < best[0] - 1e-9:
                best = (g, j, t)
    return best[1:]


def test_tree_takes_the_best_split(spark):
    df, x, y = cloud(spark, 150, 3)
    tree = trees.decision_tree_classifier("id", "y", max_depth=1).fit(df).trees[0]
    assert (tree.feature[0], tree.threshold[0]) == brute_split(x, y)
    full = trees.decision_tree_classifier("id", "y").fit(df)
    assert full.predict(df).agg(metrics.accuracy("y", "prediction")).first()[0] == 1.0


def test_forests_and_boosting(spark):
    df, x, y = cloud(spark, 300, 3)
    for model in (trees.random_forest_classifier("id", "y", 8, max_depth=4), trees.bagging_classifier("id", "y", 5, 0.7, max_depth=3), trees.Boosting("id", "y", "adaboost", 8, 1.0), trees.Boosting("id", "y", "logistic", 20, 0.5)):
        assert model.fit(df).predict(df).agg(metrics.accuracy("y", "prediction")).first()[0] > 0.93
    target = df.withColumn("t", F.element_at("v", 1) * 2)
    errors = [trees.Boosting("id", "t", "regression", n, 0.5).fit(target).predict(target).agg(metrics.mse("t", "prediction")).first()[0] for n in (1, 10)]
    assert errors[1] < errors[0] / 3
    assert trees.random_forest_regressor("id", "t", 5, max_depth=5).fit(target).predict(target).agg(metrics.r2("t", "prediction")).first()[0] > 0.9


def test_poisson_bootstrap_has_mean_one():
    w = trees.poisson(np.arange(20_000), 3, 1)
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)


def test_isolation_forest_and_kmeans_find_an_outlier(spark):
    df, _, _ = cloud(spark, 200, 2, k=1)
    far = df.unionByName(spark.createDataFrame([(999, [30.0, -30.0], 0)], df.schema))
    model = trees.IsolationForest("id", 30, 64).fit(far)
    assert model.score(far).orderBy("score").first().id == 999
    assert clustering.kmeans_anomaly(far, "id", 2, max_iter=5).where("id = 999").count() == 1


def test_dbscan_and_min_labels(spark):
    rows = [(i, [float(i) * 0.4, 0.0]) for i in range(10)] + [(20 + i, [50.0 + i * 0.4, 0.0]) for i in range(5)] + [(90, [200.0, 0.0])]
    got = {r.id: r.cluster for r in clustering.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), "id", 0.5, 3).collect()}
    assert {got[i] for i in range(10)} == {1} and {got[20 + i] for i in range(5)} == {21} and got[90] == -1


def test_agglomerative_and_kmeans(spark):
    df, _, y = cloud(spark, 60, 2, seed=3)
    apart = df.withColumn("v", F.transform("v", lambda x: x + F.col("y") * 20))
    for linkage in ("single", "complete", "average"):
        got = {r.id: r.cluster for r in clustering.agglomerative(apart, "id", 2, linkage).collect()}
        assert len({(got[i], int(y[i])) for i in range(60)}) == 2
    model = clustering.KMeans("id", 2, 20).fit(apart)
    assert model.predict(apart).select("cluster", "y").distinct().count() == 2
    with pytest.raises(ValueError):
        clustering.agglomerative(apart, "id", limit=10)


def test_pca_and_lda(spark):
    df, x, y = cloud(spark, 150, 3)
    wide = df.select("id", *[F.element_at("v", i + 1).alias(f"x{i}") for i in range(3)], "y")
    cols = ["x0", "x1", "x2"]
    model = decomposition.PCA(cols).fit(wide)
    assert model.explained == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    back = model.inverse_transform(model.transform(wide)).orderBy("id").collect()
    assert np.allclose([[r[c] for c in cols] for r in back], x)
    lda = decomposition.LDA(cols, "y").fit(wide).transform(wide)
    gap = lda.groupBy("y").agg(F.avg("c0").alias("m"), F.stddev("c0").alias("s")).orderBy("y").collect()
    assert abs(gap[0].m - gap[1].m) > 2 * max(gap[0].s, gap[1].s)


# functions, text


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "See http://x.y/z or mail a.b@c.de: Café  isn't CLOSED — “Yes” 42!"), (2, ""), (3, None), (4, "  \n ")], "id int, t string")
    assert values(df.withColumn("o", T.clean(F.col("t"), contractions=True)), "o") == ["see or mail : cafe is not closed — “yes” 42!", "", None, ""]
    assert values(df.withColumn("o", T.normalize(F.col("t"))), "o")[0].endswith('isn\'t closed - "yes" 42!')
    assert values(df.withColumn("o", T.ngrams(T.words_by_space(F.col("t")), 3)), "o")[1] == []
    assert values(df.withColumn("o", T.word_tokens(F.lit("A_b c-d é?"))), "o")[0] == ["a_b", "c", "-", "d", "é", "?"]
    stems = spark.createDataFrame([(i, w) for i, w in enumerate(["flies", "running", "cat", "kilometer", "relational", "caresses", None])], "id int, w string")
    assert values(stems.withColumn("o", T.simple_stem(F.col("w"))), "o")[:3] == ["fli", "runn", "cat"]
    assert values(stems.withColumn("o", T.lancaster_stem(F.col("w"))), "o")[3:5] == ["meter", "relate"]
    assert values(stems.withColumn("o", T.porter_stem("w")), "o")[5:] == ["caress", None]
    with pytest.raises(ValueError):
        T.tokenize(F.col("t"), "other")


def test_vocabulary_encode_decode(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c zz"), (3, "")], "id int, t string")
    vocab = vectorizing.vocabulary(df, "id", "t", 3)
    assert [(r.term, r.idx) for r in vocab.orderBy("idx").collect()] == [("b", 0), ("a", 1), ("c", 2)]
    ids = vectorizing.encode(df, "id", T.words_by_space(F.col("t")), vocab, pad_to_length=4)
    assert values(ids, "ids") == [[0, 1, 0, 0], [2, 0, 0, 0], [0, 0, 0, 0]]
    known = vectorizing.encode(df, "id", T.words_by_space(F.col("t")), vocab, unknown="a")
    assert values(known, "ids")[1] == [2, 1] and values(vectorizing.decode(known, "id", vocab), "text")[0] == "b a b"


def test_subword_vectors(spark):
    vectors = spark.createDataFrame([("#ab", [1.0, 0.0]), ("ab#", [3.0, 2.0])], "gram string, v array<double>")
    got = vectorizing.subword_vectors(spark.createDataFrame([("ab",), ("zz",)], "word string"), "word", vectors).collect()
    assert [(r.word, r.v) for r in got] == [("ab", [2.0, 1.0])]


def test_arrays_and_activations(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id int, a array<double>")
    a = F.col("a")
    got = df.select(arrays.transpose(arrays.reshape(a, 2)).alias("t"), arrays.divide(a, F.array(*[F.lit(v) for v in (2.0, 0.0, 1.0, 4.0)])).alias("d"), arrays.assigned(a, 1, 9.0).alias("s"), arrays.mean(a).alias("m"), arrays.euclidean(a, arrays.multiply(a, 2.0)).alias("e"), activations.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first()
    assert got.t == [[1.0, 3.0], [2.0, 4.0]] and got.d == [0.5, None, 3.0, 1.0] and got.s[1] == 9.0 and got.m == 2.5 and got.e == pytest.approx(30**0.5) and got.p == [0.5, 0.5]
    with pytest.raises(ValueError):
        activations.get_activation("none")


def test_distillation_of_itself_is_cross_entropy(spark):
    z = F.array(F.lit(1.0), F.lit(2.0))
    row = spark.range(1).select(losses.distillation(z, z, F.lit(1), 3.0, 0.5).alias("d"), losses.cross_entropy(z, F.lit(1)).alias("c")).first()
    assert row.d == pytest.approx(row.c / 2)


def test_early_stopping_and_batches(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([3, 2, 2.5, 2.4, 1])] + [("b", 0, 1.0)]
    got = {r.run: r for r in schedules.early_stopping(spark.createDataFrame(rows, "run string, e int, v double"), "run", "e", "v", 2).collect()}
    assert (got["a"].stop_epoch, got["a"].best_epoch, got["a"].best) == (3, 1, 2.0) and got["b"].stop_epoch is None
    sizes = schedules.batches(spark.range(23), ["id"], 10, seed=1).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in sizes] == [10, 10, 3]


# sequences, lifecycle, plans, sources


def test_sequence_folds(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 100, 100, 5, 90])], "seq int, pos int, v double")
    assert sequences.two_pass_boundaries(df, "seq", "pos", "v", 30.0, 70.0).first().kept == [0, 1, 3, 4]
    assert sequences.interpolated(df, "seq", "pos", "v", 4).count() == 17
    frames = spark.range(1).select(sequences.framed(F.array(*[F.lit(float(i)) for i in range(5)]), 2, 2).alias("f"), sequences.structural_similarity(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(1.0), F.lit(9.0))).alias("s")).first()
    assert frames.f == [[0.0, 1.0], [2.0, 3.0]] and frames.s == pytest.approx(1.0)


def test_lifecycle(spark):
    params = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([-1, 0.5, 2])] + [("b", 0, 0.0)], "layer string, id int, value double")
    q = lifecycle.quantized(params, ["layer"]).where("layer = 'a'").collect()
    assert all(abs(r.restored - r.value) <= r.scale / 2 + 1e-9 and -128 <= r.q <= 127 for r in q)
    assert [r.value for r in lifecycle.pruned(params, ["layer"], sparsity=0.5).where("layer = 'a'").orderBy("id").collect()] == [0.0, 0.0, 2.0]
    genes = lambda rows: spark.createDataFrame(rows, "innovation int, weight double")
    assert lifecycle.genome_distance(genes([(1, 1.0), (2, 1.0)]), genes([(1, 2.0), (3, 0.0), (4, 0.0)])).first()[0] == pytest.approx(2 / 3 + 1 / 3 + 0.4)
    assert lifecycle.genome_distance(genes([(1, 1.0)]), genes([(2, 1.0)])).first()[0] == float("inf")


def test_plans(spark, frame):
    with pytest.raises(ValueError):
        Pipeline([("a", scaling.StandardScaler(["a"])), ("a", scaling.StandardScaler(["a"]))])
    made = Pipeline([("i", imputing.SimpleImputer(["a"])), ("s", scaling.StandardScaler(["a"]))]).fit(frame)
    assert "i__strategy" in made.get_params() and made.transform(frame).where("a IS NULL").count() == 0
    plan = made.transform(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Aggregate", "Window"))  # fitted steps only project
    with pytest.raises(ValueError):
        TextPlan([{"operation": "none"}])
    graph = Graph()
    graph.add_node("both", lambda a, b: a.unionByName(b), ["x", "double"])
    graph.add_node("double", lambda a: a.withColumn("id", F.col("id") * 2), ["x"])
    assert sorted(r.id for r in graph.run({"x": spark.range(3)}, "both").collect()) == [0, 0, 1, 2, 2, 4]
    graph.add_node("loop", lambda a: a, ["loop"])
    with pytest.raises(RuntimeError):
        graph.order()


def test_files(spark, tmp_path):
    own = np.random.default_rng(0)
    for shape in ((4, 5), (4, 5, 3)):
        x = own.integers(0, 256, shape)
        for binary in (True, False):
            assert (files.decode_image(files.encode_image(x, binary)) == x).all()
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.ppm").write_bytes(files.encode_image(x))
    row = files.read_images(spark, str(tmp_path / "i")).first()
    assert (row.height, row.width, row.channels) == (4, 5, 3) and row.data == x.reshape(-1).tolist()
    tone = np.sin(np.arange(100) / 5)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.wav").write_bytes(files.encode_wav(tone, 8000))
    sound = files.read_audio(spark, str(tmp_path / "s")).first()
    assert sound.sample_rate == 8000 and np.allclose(sound.samples, tone, atol=1e-4)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "t")).first().text == "one\ntwo"
    assert files.modality("x/Y.WAV") == "audio"
    for bad in ("x.exe",):
        with pytest.raises(ValueError):
            files.modality(bad)


def test_tracker(spark, tmp_path):
    own = tracker.ExperimentTracker(spark, str(tmp_path))
    one, two = own.new("one", {"lr": 1}), own.new("two")
    for exp, best in ((one, 0.9), (two, 0.7)):
        own.log(exp, {"acc": best}, 1)
        own.log(exp, {"acc": 0.5}, 2)
    assert [r.exp_id for r in own.top("acc", 1).collect()] == [one] and own.load_all().count() == 2 and one in own.to_markdown()


def test_preprocessor_plans(spark, tmp_path):
    from mlquarry.plans.preprocess import Preprocessor

    x = np.arange(64).reshape(8, 8)
    (tmp_path / "a.pgm").write_bytes(files.encode_image(x))
    own = Preprocessor(spark)
    df = own.load(f"{tmp_path}/a.pgm")
    got = own.preprocess(df, [{"operation": "flip"}, {"operation": "crop", "params": {"top": 0, "left": 0, "height": 2, "width": 3}}], "data", (8, 8)).first()
    assert got.out == x[:2, ::-1][:, :3].reshape(-1).tolist() and own.get_history() == ["load image", "flip", "crop"]
    with pytest.raises(ValueError):
        own.preprocess(df, [{"operation": "none"}], "data", (8, 8))
    tone = np.sin(np.arange(4000) / 3)
    (tmp_path / "a.wav").write_bytes(files.encode_wav(tone))
    sound = own.preprocess(own.load(f"{tmp_path}/a.wav"), [{"operation": "time_stretch", "params": {"speed": 2.0}}], "samples").first()
    assert len(sound.out) == len(tone) // 2


def test_quantiles_are_exact_at_every_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from mlquarry.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    own = np.random.default_rng(3)
    n = 6000
    columns = {
        "plain": own.normal(size=n),
        "ties": own.integers(0, 3, n).astype(float),
        "mixed": np.where(own.random(n) < 0.6, 7.0, own.normal(7, 0.1, n)),
        "gaps": np.where(own.random(n) < 0.3, np.nan, own.exponential(size=n)),
        "none": np.full(n, np.nan),
        "one": np.r_[5.0, np.full(n - 1, np.nan)],
    }
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))
    shares = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.quantiles(df, {c: (F.col(c), shares) for c in columns})
    for c, values in columns.items():
        kept = values[~np.isnan(values)]
        assert got[c] == (pytest.approx(np.percentile(kept, [100 * s for s in shares]), rel=1e-12) if kept.size else None), c
    assert quantiles.quantile(df, "plain", 0.5) == pytest.approx(np.median(columns["plain"]))
    assert quantiles.quantile(df.where("false"), "plain", 0.5) is None
    assert quantiles.modes(df, {c: F.col(c) for c in ("ties", "mixed", "none")}) == {"ties": float(np.argmax(np.bincount(columns["ties"].astype(int)))), "mixed": 7.0, "none": None}


def test_neighbours_by_product_equal_plain_distances(spark):
    from mlquarry.operators import neighbors

    own = np.random.default_rng(1)
    x = np.round(own.normal(size=(400, 7)) * 3, 1)
    x[100:140] = x[:40]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    rows = df.withColumnRenamed("id", "nid")
    d = neighbors.distances(x, x, "euclidean")
    got = {(r.id, r.rank): (r.nid, r.distance) for r in neighbors.nearest(df, rows, 6, "id", "nid").collect()}
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:6]
        assert [got[i, k + 1] for k in range(6)] == [(j, pytest.approx(d[i, j], abs=1e-12)) for j in order.tolist()]
    near = {(r.id, r.nid) for r in neighbors.within(df, rows, 5.0, "id", "nid").collect()}
    assert near == set(zip(*(z.tolist() for z in np.nonzero(d <= 5.0)), strict=True))


def test_rows_without_a_whole_vector(spark):
    import pyarrow as pa

    from mlquarry.operators import clustering, neighbors

    data = [(1, [0.0, 0.0]), (2, None), (3, [0.0, None]), (4, [0.0, 1.0]), (5, [3.0, 4.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = {(r.id, r.nid): r.distance for r in neighbors.nearest(df, df.withColumnRenamed("id", "nid"), 2, "id", "nid").collect()}
    assert got == {(1, 1): 0, (1, 4): 1, (4, 4): 0, (4, 1): 1, (5, 5): 0, (5, 4): pytest.approx(18**0.5)}
    assert {r.id: r.cluster for r in clustering.dbscan(df, "id", 1.5, 2).collect()} == {1: 1, 2: -1, 3: -1, 4: 1, 5: -1}
    for bad in ([[1.0], None], [[1.0], [None]], [[1.0], [1.0, 2.0]], [[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]]):
        with pytest.raises(ValueError, match="vector"):
            neighbors._vectors(pa.array(bad, pa.list_(pa.float64())))
    assert neighbors._vectors(pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float64())).slice(1)).tolist() == [[1, 2], [3, 4]]


def plain_tree(x, y, depth, score, leaf):
    """A tree by trying every cut of every column anew: a nested (column, cut, left, right) or the value of a leaf."""
    best = None
    if depth and len(set(y.tolist())) > 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in values[:-1]:
                low = x[:, f] <= cut
                gain = score(y) - (low.sum() * score(y[low]) + (~low).sum() * score(y[~low])) / len(y)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    if best is None or best[0] <= 1e-12:
        return leaf(y)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x[low], y[low], depth - 1, score, leaf), plain_tree(x[~low], y[~low], depth - 1, score, leaf)


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_trees_equal_plain_trees(spark):
    own = np.random.default_rng(11)
    x = np.round(own.normal(size=(150, 3)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(int)
    t = np.round(np.where(x[:, 2] > 0, 3.0, 1.0) + x[:, 0], 2)
    df = spark.createDataFrame([(i, v.tolist(), int(a), float(b)) for i, (v, a, b) in enumerate(zip(x, y, t, strict=True))], "id long, v array<double>, y int, t double").repartition(3)

    def entropy(a):
        p = np.bincount(a) / len(a)
        return -sum(q * np.log2(q) for q in p if q)

    for depth in (1, 3):
        grown = trees.decision_tree_classifier("id", "y", max_depth=depth, criterion="entropy").fit(df)
        got = {r.id: r.prediction for r in grown.predict(df).collect()}
        plain = plain_tree(x, y, depth, entropy, lambda a: int(np.bincount(a).argmax()))
        wrong = sum(got[i] != y[i] for i in got), sum(walked(plain, x[i]) != y[i] for i in got)
        assert wrong[0] == wrong[1], depth
        grown = trees.decision_tree_regressor("id", "t", max_depth=depth).fit(df)
        got = {r.id: r.prediction for r in grown.predict(df).collect()}
        plain = plain_tree(x, t, depth, np.var, np.mean)
        assert all(got[i] == pytest.approx(walked(plain, x[i]), abs=1e-6) for i in got), depth


def test_agglomerative_equals_plain_merging(spark):
    x = np.random.default_rng(2).normal(size=(40, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    for linkage, measure in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        groups = [[i] for i in range(40)]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        while len(groups) > 4:
            pairs = [(measure(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
            _, i, j = min(pairs)
            groups[i] += groups.pop(j)
        got = {}
        for r in clustering.agglomerative(df, "id", 4, linkage).collect():
            got.setdefault(r.cluster, set()).add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)), linkage


def test_kmeans_equals_plain_rounds(spark):
    x = np.random.default_rng(4).normal(size=(200, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    centers = x[:5].copy()
    model = clustering.KMeans("id", 5, 30, init=centers).fit(df)
    for _ in range(30):
        near = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.stack([x[near == k].mean(axis=0) for k in range(5)])
    assert np.allclose(model.centers, centers, atol=1e-3)


def test_elastic_net_and_lasso_reach_their_conditions(spark):
    """Lasso's coordinates at rest: the gradient of the squares equals the penalty where a weight is not 0, and is below it elsewhere."""
    own = np.random.default_rng(7)
    x = own.normal(size=(300, 4))
    y = x @ np.array([2.0, 0.0, -1.0, 0.05]) + own.normal(size=300) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    model = linear.Lasso(list("abcd"), "y", 0.2, tol=1e-12).fit(df)
    left = y - x @ model.coef - model.intercept
    slope = x.T @ left / 300
    assert all(abs(g) <= 0.2 + 1e-6 if w == 0 else g == pytest.approx(0.2 * np.sign(w), abs=1e-6) for g, w in zip(slope, model.coef, strict=True))
    assert 0 in model.coef.tolist() and left.mean() == pytest.approx(0, abs=1e-6)


def test_dbscan_equals_plain_clusters(spark, monkeypatch):
    from mlquarry.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 50)
    own = np.random.default_rng(9)
    x = np.concatenate([own.normal(c, 0.5, (60, 2)) for c in (0, 3, 6)] + [own.uniform(-3, 9, (40, 2))])
    for kind in ("long", "int"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id {kind}, v array<double>").repartition(4)
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.45
        core = near.sum(axis=1) >= 5
        cluster = np.full(len(x), -1)
        for i in np.flatnonzero(core):  # in order of ids, so a cluster's number is its smallest core id
            todo = [i] if cluster[i] < 0 else []
            while todo:
                j = todo.pop()
                if cluster[j] < 0:
                    cluster[j] = i
                    todo += [k for k in np.flatnonzero(near[j] & core) if cluster[k] < 0]
        for i in np.flatnonzero(~core):
            own_near = cluster[near[i] & core]
            cluster[i] = own_near.min() if own_near.size else -1
        got = {r.id: (r.cluster, r.core) for r in clustering.dbscan(df, "id", 0.45, 5).collect()}
        assert got == {i: (int(c), bool(k)) for i, (c, k) in enumerate(zip(cluster, core, strict=True))}
    assert clustering.dbscan(df.where("false"), "id").collect() == []


def test_vocabulary_of_all_terms(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "c b d")], "id int, t string")
    bounded = {r.term: r.idx for r in vectorizing.vocabulary(docs, "id", "t").collect()}
    assert {r.term: r.idx for r in vectorizing.vocabulary(docs, "id", "t", None).collect()} == bounded == {"b": 0, "c": 1, "a": 2, "d": 3}


def test_one_hot_limit_is_exact(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), "x") for i in range(9)], "a string, b string")
    monkeypatch.setattr(encoding, "MAX_COLUMNS", 10)
    assert len(encoding.OneHotEncoder(["a", "b"]).fit(df).get_feature_names()) == 10
    monkeypatch.setattr(encoding, "MAX_COLUMNS", 9)
    with pytest.raises(ValueError, match="categories"):
        encoding.OneHotEncoder(["a", "b"]).fit(df)


def away_from_driver(monkeypatch):
    """Small groups, so that a search has many, and an error where rows pass the driver one by one."""
    from pyspark.sql.classic.dataframe import DataFrame

    from mlquarry.operators import neighbors

    def refused(self, *_):
        raise AssertionError("rows pass the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    for name, value in (("LEAST", 10), ("BLOCK", 16), ("CELLS", 500), ("HELD", 40)):
        monkeypatch.setattr(neighbors, name, value, raising=False)


def test_searches_do_not_pass_the_driver(spark, monkeypatch):
    from mlquarry.operators import neighbors

    away_from_driver(monkeypatch)
    own = np.random.default_rng(21)
    for offset in (0.0, 1e6):
        x = own.normal(size=(70, 3)).round(1) + offset  # with ties
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
        rows = df.select(F.col("id").cast("string").alias("nid"), "v", (F.col("id") * 2).alias("y"))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        names = [str(i) for i in range(70)]
        got = {(r.id, r.rank): (r.nid, r.distance, r.y) for r in neighbors.nearest(df, rows, 6, "id", "nid", ["y"]).collect()}
        for i in range(70):
            for rank, j in enumerate(sorted(range(70), key=lambda j, i=i: (d[i, j], names[j]))[:6], 1):
                assert got[i, rank] == (names[j], d[i, j], 2 * j)
        assert len(got) == 420
        pairs = {(r.id, int(r.nid)) for r in neighbors.within(df, rows, float(d[0, 1]), "id", "nid").collect()}
        assert pairs == {(int(i), int(j)) for i, j in np.argwhere(d <= d[0, 1])}


def test_dbscan_does_not_pass_the_driver(spark, monkeypatch):
    away_from_driver(monkeypatch)
    monkeypatch.setattr(clustering, "BLOCK", 4)
    own = np.random.default_rng(5)
    x = np.concatenate([own.normal(c, 0.4, (40, 2)) for c in (0, 4, 8)] + [own.uniform(-3, 11, (20, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.6
    core = near.sum(axis=1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        label = np.where(core, np.where(near & core[None], label[None], len(x)).min(axis=1), len(x))
    seen = np.where(near & core[None], label[None], len(x)).min(axis=1)
    got = {r.id: (r.cluster, r.core) for r in clustering.dbscan(df, "id", 0.6, 4).collect()}
    assert got == {i: (int(c) if c < len(x) else -1, bool(k)) for i, (c, k) in enumerate(zip(seen, core, strict=True))}
    assert len(set(label[core].tolist())) > 2


def test_kernel_sums_do_not_pass_the_driver(spark, monkeypatch):
    away_from_driver(monkeypatch)
    own = np.random.default_rng(6)
    x, t = own.normal(size=(60, 3)), own.integers(0, 9, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, t, strict=True))], "id long, v array<double>, t long").repartition(3)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for kernel, k in (("linear", x @ x.T), ("rbf", np.exp(-0.3 * square)), ("poly", (x @ x.T + 1) ** 3)):
        m = 0.01 * k.sum(axis=1)
        left = (t - m)[np.abs(t - m) > 0.5]
        got = {r.id: r.prediction for r in linear.SVR("id", "t", kernel, 0.3, epsilon=0.5).fit(df).predict(df).collect()}
        assert got == pytest.approx({i: m[i] + left.mean() for i in range(60)}), kernel
        y = np.where(t == 4, 1.0, -1.0)
        m = 0.01 * k @ y
        both = df.withColumn("t", (F.col("t") == 4).cast("int"))
        got = {r.id: r.decision for r in linear.SVC("id", "t", kernel, 0.3).fit(both).predict(both).collect()}
        assert got == pytest.approx({i: m[i] + (y - m).mean() for i in range(60)}), kernel
    broken = df.withColumn("v", F.when(F.col("id") != 7, F.col("v")))
    for kernel in ("linear", "rbf"):  # refused as before
        with pytest.raises(Exception, match="a vector is null"):
            linear.kernel_decision(df, broken, "id", "t", kernel, 0.3).collect()


def test_power_transformer_takes_moments_without_an_aggregate_for_each_power(spark, monkeypatch):
    own = np.random.default_rng(8)
    x = np.concatenate((own.lognormal(2, 1, 300), -own.lognormal(0, 1, 200)))
    df = spark.createDataFrame([(float(v), float(abs(v))) for v in x] + [(None, float("nan"))], "a double, b double").repartition(3)

    def refused(*_):
        raise AssertionError("an aggregate for each power")

    monkeypatch.setattr(F, "var_pop", refused)

    def plain(x, method):
        centre, width = 0.0, 5.0
        for _ in range(4):
            likely = []
            grid = np.linspace(centre - width, centre + width, 21)
            for p in grid:
                up = lambda v, p: np.log(v) if abs(p) < 1e-12 else (v**p - 1) / p
                t = up(x, p) if method == "box-cox" else np.concatenate((up(1 + x[x >= 0], p), -up(1 - x[x < 0], 2 - p)))
                j = np.log(x).sum() if method == "box-cox" else (np.sign(x) * np.log1p(np.abs(x))).sum()
                likely.append(-len(x) / 2 * np.log(t.var()) + (p - 1) * j)
            centre, width = float(grid[int(np.argmax(likely))]), width / 10
        return centre

    got = scaling.PowerTransformer(["a", "b"]).fit(df).params
    assert got == pytest.approx({"a": plain(x, "yeo-johnson"), "b": plain(np.abs(x), "yeo-johnson")}, abs=1e-9)
    assert scaling.PowerTransformer(["b"], "box-cox").fit(df).params["b"] == pytest.approx(plain(np.abs(x), "box-cox"), abs=1e-9)


def test_vectorizers_count_each_text_where_it_lies(spark, monkeypatch):
    own = np.random.default_rng(12)
    texts = [" ".join(own.choice(list("abcdefgh"), own.integers(0, 12))) for _ in range(40)] + [None, "", "zz ZZ a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    made = {}
    for rows in (df, df.unionByName(df)):  # an id with two rows counts as one text
        if rows is df:
            monkeypatch.setattr(vectorizing, "WORDS", 7, raising=False)
            monkeypatch.setattr(vectorizing, "cut", None)
        else:
            monkeypatch.undo()
        times = 1 if rows is df else 2
        counted = [Counter((t or "").lower().split()) for t in texts]
        total, held = sum(counted, Counter()), Counter(w for c in counted for w in c)
        top = lambda c: sorted(c, key=lambda w: (-c[w], w))[:5]
        got = {(r.id, r.term): r.n for r in vectorizing.count_vectorize(rows, "id", "text", 5).collect()}
        assert got == {(i, w): n * times for i, c in enumerate(counted) for w, n in c.items() if w in top(total)}
        got = [(r.id, r.term, r.value) for r in vectorizing.binary_vectorize(rows, "id", "text", 5).collect()]
        assert sorted(got) == sorted((i, w, 1) for i, c in enumerate(counted) for w in c if w in top(held))
        made[times] = {(r.id, r.term): r.weight for r in vectorizing.tfidf(rows, "id", "text", 5, min_df=2, max_df=0.9).collect()}
    best = sorted((w for w in held if 2 <= held[w] <= 0.9 * len(texts)), key=lambda w: (-held[w], w))[:5]
    want = {}
    for i, c in enumerate(counted):
        w = {x: c[x] / sum(c.values()) * np.log(len(texts) / held[x]) for x in best if x in c}
        want |= {(i, x): v / np.sqrt(sum(u * u for u in w.values())) for x, v in w.items()}
    assert made[1] == pytest.approx(want)


def test_subword_vectors_take_means_without_a_row_for_each_number(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a row for each number")

    monkeypatch.setattr(F, "posexplode", refused)
    vectors = spark.createDataFrame([("#ab", [1.0, 5.0]), ("ab#", [3.0, None, 7.0]), ("#zz", [])], "gram string, v array<double>")
    got = vectorizing.subword_vectors(spark.createDataFrame([("ab",), ("zz",), ("q",)], "word string"), "word", vectors, 3, 3).collect()
    assert [tuple(r) for r in got] == [("ab", [2.0, 5.0, 7.0])]


def test_agglomerative_in_rounds_equals_the_driver(spark, monkeypatch):
    own = np.random.default_rng(14)
    x = np.concatenate([own.normal(c, 0.5, (25, 2)) for c in (0, 3, 6)] + [own.uniform(-9, 15, (15, 2)), np.zeros((3, 2))])
    df = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    for linkage in ("single", "complete", "average"):
        want = sorted(map(tuple, clustering.agglomerative(df, "id", 6, linkage).collect()))
        with monkeypatch.context() as m:
            for name, value in (("LEAST", 10), ("BLOCK", 16), ("CELLS", 500), ("HELD", 40)):
                m.setattr(neighbors, name, value)
            m.setattr(clustering, "MATRIX", 12, raising=False)
            assert sorted(map(tuple, clustering.agglomerative(df, "id", 6, linkage).collect())) == want, linkage


def test_agglomerative_takes_more_rows_than_the_driver_holds(spark):
    x = np.random.default_rng(15).integers(0, 3, 4100) * 100.0
    df = spark.createDataFrame([(i, [float(v), i * 1e-6]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {(r.cluster, x[r.id]) for r in clustering.agglomerative(df, "id", 3, "single").collect()}
    assert len(got) == 3 and {c for c, _ in got} == {0, 1, 2}
