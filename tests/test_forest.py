"""Forests grown beside their rows: against brute force, Spark's own, and themselves in other cuts."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from cadenza.operators import forest, model
from cadenza.session import scratch_path


def _rows(spark, n=900):
    df = spark.range(0, n, 1, 3).select(
        "id", ((F.col("id") * 37) % 31).cast("double").alias("a"), ((F.col("id") * 53) % 29).cast("double").alias("b"),
        ((F.col("id") * 7) % 3).cast("double").alias("c"))
    df = df.withColumn("popularity", (F.col("a") % 7) * 3 + F.col("b") + F.col("id") % 5).withColumn("label", F.floor(F.col("popularity") / 16).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def _nodes(spark, grown):
    path = scratch_path(spark, "grown")
    grown.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return trees


def _brute(x, y, depth, level=0):
    """Mean by leaf of a greedy variance tree, as (rows' predictions)."""
    out = np.full(len(y), y.mean())
    best = (1e-9, None)
    if level < depth and len(y) > 1:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= v
                gain = y.var() - (low.mean() * y[low].var() + (~low).mean() * y[~low].var())
                if gain > best[0] + 1e-9:
                    best = (gain, low)
    if best[1] is not None:
        low = best[1]
        out[low], out[~low] = _brute(x[low], y[low], depth, level + 1), _brute(x[~low], y[~low], depth, level + 1)
    return out


@pytest.mark.parametrize("local", [1 << 18, 100, 20])
def test_one_tree_of_all_rows_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    rows = _rows(spark)
    est = RandomForestRegressor(labelCol="popularity", numTrees=1, maxDepth=5, bootstrap=False, seed=1)
    got = forest.grow_forest(est, rows).transform(rows).select("a", "b", "c", "popularity", "prediction").toPandas()
    want = _brute(got[["a", "b", "c"]].to_numpy(), got.popularity.to_numpy(), 5)
    assert np.abs(got.prediction - want).max() < 1e-9
    theirs = DecisionTreeRegressor(labelCol="popularity", maxDepth=5).fit(rows).transform(rows).toPandas()
    assert abs(((theirs.prediction - theirs.popularity) ** 2).mean() - ((got.prediction - got.popularity) ** 2).mean()) < 0.5


@pytest.mark.parametrize("local", [1 << 18, 60])
def test_every_node_holds_the_rows_that_reach_it(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    rows = _rows(spark)
    for est in (RandomForestRegressor(labelCol="popularity", numTrees=5, maxDepth=8, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=3),
                RandomForestClassifier(labelCol="label", numTrees=5, maxDepth=8, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=3)):
        grown = forest.grow_forest(est, rows)
        trees = _nodes(spark, grown)
        assert sorted(trees) == list(range(5)) and grown.getOrDefault("maxDepth") == 8
        for t in trees.values():
            assert sorted(t) == list(range(len(t))) and 700 < t[0]["rawCount"] < 1100
            for node in t.values():
                if node["leftChild"] >= 0:
                    low, high = t[node["leftChild"]], t[node["rightChild"]]
                    assert low["rawCount"] + high["rawCount"] == node["rawCount"] and min(low["rawCount"], high["rawCount"]) >= 2
                    assert np.allclose(np.add(low["impurityStats"], high["impurityStats"]), node["impurityStats"])
                    inner = (low["rawCount"] * low["impurity"] + high["rawCount"] * high["impurity"]) / node["rawCount"]
                    assert node["gain"] == pytest.approx(node["impurity"] - inner, abs=1e-9) and node["gain"] > 0
        assert abs(sum(grown.featureImportances.toArray()) - 1) < 1e-9


def test_quality_is_that_of_sparks_forest(spark):
    rows = _rows(spark)
    est = RandomForestRegressor(labelCol="popularity", numTrees=20, maxDepth=9, featureSubsetStrategy="sqrt", seed=3)
    ev = RegressionEvaluator(labelCol="popularity", metricName="r2")
    ours, theirs = (ev.evaluate(m.transform(rows)) for m in (forest.grow_forest(est, rows), est.fit(rows)))
    assert abs(ours - theirs) < 0.05


def test_draws_are_poisson_and_codes_come_back():
    rules = forest.Rules(0, 3, 32, 3, 5, 1, 42, 1.0, True, "f8")
    w = np.stack([forest.draws(np.arange(20000), t, rules) for t in range(4)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w)[0, 1]) < 0.03
    for bins in (1, 2, 32, 200):
        codes = np.random.default_rng(1).integers(0, bins, (50, 7)).astype(np.uint8)
        assert (forest.unpack(forest.pack(codes, bins).tobytes(), 50, 7, bins) == codes).all()


def test_constant_features_and_one_row(spark):
    rows = _rows(spark).withColumn("features", F.first("features").over(__import__("pyspark").sql.Window.partitionBy()))
    est = RandomForestRegressor(labelCol="popularity", numTrees=3, maxDepth=4, seed=2)
    assert forest.grow_forest(est, rows).totalNumNodes == 3
    one = forest.grow_forest(est, _rows(spark, 1))
    assert one.totalNumNodes == 3 and one.transform(_rows(spark, 1)).first()["prediction"] >= 0


def test_a_pass_sends_rows_once_a_tree_not_histograms(spark, monkeypatch):
    """The registered forests don't call the learner whose shuffles grow with nodes times tasks."""
    def no(*a, **k):
        raise AssertionError("fit on all rows")
    rows = _rows(spark)
    whole = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: whole(self, df, *a) if self.getMaxDepth() == 0 else no())
    feats = ["a", "b", "c"]
    stats = model.scaler_stats(rows, feats)
    est = RandomForestRegressor(featuresCol=model.FEATURES_COL, labelCol="popularity", numTrees=2, maxDepth=3)
    fitted = model.fit_one(est, rows.drop("features"), stats, feats)
    assert fitted.transform(rows.drop("features")).where("prediction is null").count() == 0


def test_fits_side_by_side_ship_the_package_once(monkeypatch):
    import time
    from multiprocessing.pool import ThreadPool
    from types import SimpleNamespace

    from cadenza import session

    monkeypatch.setattr(session, "_SHIPPED", set())
    sent = []
    fake = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app", addPyFile=lambda path: (time.sleep(0.2), sent.append(path))))
    with ThreadPool(3) as pool:
        pool.map(session.ship_package, [fake] * 3)
    assert len(sent) == 1


def _walk(nodes, x):
    at = nodes[0]
    while at["leftChild"] >= 0:
        low = x[at["split"]["featureIndex"]] <= at["split"]["leftCategoriesOrThreshold"][0]
        at = nodes[at["leftChild"] if low else at["rightChild"]]
    return at


def test_packed_trees_give_what_the_nodes_say(spark):
    """Prediction, shares, importances and a saved copy, against a walk over the nodes; no Spark model is built on the driver."""
    from pyspark.ml import PipelineModel

    rows = _rows(spark).withColumn("x", F.col("features"))
    for est in (RandomForestRegressor(labelCol="popularity", numTrees=4, maxDepth=7, featureSubsetStrategy="sqrt", seed=5),
                RandomForestClassifier(labelCol="label", numTrees=4, maxDepth=7, seed=5)):
        grown = forest.grow_forest(est, rows)
        assert not hasattr(grown, "_java_obj")
        trees = _nodes(spark, grown)
        path = scratch_path(spark, "piped")
        PipelineModel(stages=[grown]).write().overwrite().save(path)
        again = PipelineModel.load(path).stages[0]
        assert again.totalNumNodes == grown.totalNumNodes == sum(len(t) for t in trees.values())
        assert again.getOrDefault("maxDepth") == 7 and (again.featureImportances.toArray() == grown.featureImportances.toArray()).all()
        for model_ in (grown, again):
            for r in model_.transform(rows.limit(60)).collect():
                leaves = [_walk(t, r["features"]) for t in trees.values()]
                if "probability" not in r:
                    assert r["prediction"] == pytest.approx(np.mean([n["prediction"] for n in leaves]))
                else:
                    shares = sum(np.array(n["impurityStats"]) / sum(n["impurityStats"]) for n in leaves)
                    assert np.allclose(r["rawPrediction"].toArray(), shares) and np.allclose(r["probability"].toArray(), shares / 4)
                    assert r["prediction"] == shares.argmax()


def test_words_of_codes_and_labels_that_are_no_class(spark):
    for bins, width in ((32, 18), (256, 5), (2, 40), (32, 3)):
        codes = np.random.default_rng(2).integers(0, bins, (9, width)).astype(np.uint8)
        assert (forest.unpack(forest.pack(codes, bins).tobytes(), 9, width, bins) == codes).all()
    with pytest.raises(ValueError):
        forest.grow_forest(RandomForestClassifier(labelCol="popularity"), _rows(spark).withColumn("popularity", F.lit(0.5)))
    with pytest.raises(ValueError):
        forest.grow_forest(RandomForestRegressor(labelCol="popularity"), _rows(spark).where("id < 0"))
