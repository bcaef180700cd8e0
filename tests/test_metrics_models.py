"""Metrics, rankings and the learners' parameter mapping."""

import math

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import metrics, model


def test_classification_metrics_hand_values(spark):
    rows = [("k1", "m", 1, "A", "A"), ("k2", "m", 1, "A", "B"), ("k3", "m", 1, "B", "B"), ("k4", "m", 1, "C", "B")]
    preds = spark.createDataFrame(rows, "key string, model string, ordinal int, actual string, predicted string")
    got = {r["metric"]: r["value"] for r in metrics.classification_metrics(preds).collect()}
    # precision: A 1/1, B 1/3, C 0 (never predicted); weights 2,1,1
    assert got["Accuracy"] == 0.5
    assert got["Recall"] == got["Accuracy"]          # weighted recall equals accuracy
    assert math.isclose(got["Precision"], round((2 * 1.0 + 1 * (1 / 3) + 0) / 4, 4))
    cm = metrics.confusion_matrix(preds).collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 4
    norm = metrics.confusion_normalised(metrics.confusion_matrix(preds))
    sums = norm.groupBy("actual").agg(F.sum("share").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in sums)


def test_regression_metrics_hand_values(spark):
    rows = [("a", "m", 1, 1.0, 2.0), ("b", "m", 1, 3.0, 3.0), ("c", "m", 1, 5.0, 4.0)]
    preds = spark.createDataFrame(rows, "key string, model string, ordinal int, actual double, predicted double")
    got = {r["metric"]: r["value"] for r in metrics.regression_metrics(preds).collect()}
    assert got["MAE"] == round(2 / 3, 4) and got["MSE"] == round(2 / 3, 4)
    assert got["RMSE"] == round(math.sqrt(2 / 3), 4) and got["R2"] == round(1 - 2 / 8, 4)


def test_leaderboard_ties_keep_table_order(spark):
    rows = [("regression", "B", 2, "R2", 0.5), ("regression", "A", 1, "R2", 0.5), ("regression", "C", 3, "R2", 0.9)]
    mt = spark.createDataFrame(rows, "task string, model string, ordinal int, metric string, value double")
    board = [(r["model"], r["rank"]) for r in metrics.leaderboard(mt).orderBy("rank").collect()]
    assert board == [("C", 1), ("A", 2), ("B", 3)]
    assert metrics.best_model(mt).first()["best_model"] == "C"


def test_importance_pct_sums_to_100(spark):
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "feature string, importance double")
    out = metrics.importance_pct(imp).collect()
    assert [r["rank"] for r in out] == [1, 2, 3] and math.isclose(sum(r["pct"] for r in out), 100.0)


def _toy(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.uniform(size=n) * 10
    y = 30 + 8 * x1 + 2 * x2 + rng.normal(size=n) * 3
    cat = np.where(y >= 40, "Mainstream", "Emerging")
    rows = [(str(i), float(a), float(b), float(c), str(d)) for i, (a, b, c, d) in enumerate(zip(x1, x2, y, cat))]
    return spark.createDataFrame(rows, "id string, x1 double, x2 double, popularity double, popularity_category string")


def test_ridge_matches_closed_form(spark):
    df = _toy(spark)
    feats = ["x1", "x2"]
    train, test, classes, stats = model.prepare(df, feats, test_fraction=0.0001)
    t = model.train_regressors(train, test, feats, stats, names=["Ridge Regression"])
    lr = t.models["Ridge Regression"].stages[-1]
    pdf = train.select(*feats, "popularity").toPandas()
    X = np.column_stack([(pdf[c] - stats[c][0]) / stats[c][1] for c in feats])
    y = pdf["popularity"].to_numpy()
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(2), Xc.T @ yc)
    assert np.allclose(lr.coefficients.toArray(), w, rtol=1e-4, atol=1e-4)


def test_classifiers_and_tuning_smoke(spark):
    df = _toy(spark)
    feats = ["x1", "x2"]
    train, test, classes, stats = model.prepare(df, feats)
    assert classes == ["Emerging", "Mainstream"]
    small = model.Sizes(trees=5, forest_depth=4, boost_rounds=3)
    c = model.train_classifiers(train, test, feats, stats, classes,
                                names=["Logistic Regression", "Gaussian Naive Bayes"], sizes=small)
    acc = {r["model"]: r["value"] for r in c.metrics.where("metric = 'Accuracy'").collect()}
    assert all(v > 0.7 for v in acc.values())
    grid = {"numTrees": [3, 4], "maxDepth": [2, 3], "minInstancesPerNode": [1]}
    m, tuned, imp = model.tune_forest(train, test, feats, stats, grid=grid, k=2)
    got = {r["metric"]: r["value"] for r in tuned.collect()}
    assert got["R2"] > 0.3 and "best_cv_r2" in got
    assert [r["feature"] for r in imp.collect()][0] == "x1"


def test_gaussian_nb_matches_mllib(spark):
    df = _toy(spark)
    feats = ["x1", "x2"]
    fitted = model.gaussian_nb_fit(df, feats)
    ours = model.gaussian_nb_predict(df, fitted).select("id", "predicted")
    train, test, classes, stats = model.prepare(df, feats, test_fraction=0.0001)
    agree = ours.join(df, "id").where(F.col("predicted") == F.col("popularity_category")).count()
    assert agree / df.count() > 0.8


def test_shallow_booster_keeps_no_node_ids(spark):
    """Same trees either way; a persisted table of node ids a level only costs time."""
    from pyspark.ml.feature import VectorAssembler

    from cadenza.operators import model
    est = model.regressors(100, 1.0, sizes=model.Sizes(boost_rounds=3))["Gradient Boosting"]
    assert not est.getCacheNodeIds() and (est.getMaxIter(), est.getMaxDepth()) == (3, 3)
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("popularity", F.col("a") * F.col("b")))
    trees = [est.copy({est.cacheNodeIds: kept}).fit(rows).toDebugString.split("\n")[1:] for kept in (False, True)]
    assert trees[0] == trees[1]
