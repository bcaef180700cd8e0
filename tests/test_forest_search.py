"""The rows-to-split minimum of forests and the random search over the whole grid."""

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cadenza.operators import model
from cadenza.schema import TUNE_GRID
from cadenza.session import scratch_path


def _rows(spark):
    df = spark.range(0, 600, 1, 3).select(
        "id", ((F.col("id") * 37) % 101).cast("double").alias("a"),
        ((F.col("id") * 53) % 29).cast("double").alias("b"))
    df = df.withColumn("popularity", (F.col("a") % 7) * 3 + F.col("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def _walk(nodes, row, minimum):
    """Down one tree, stopping at the first node with fewer than ``minimum`` rows."""
    at = nodes[0]
    while at["leftChild"] >= 0 and at["rawCount"] >= minimum:
        split = at["split"]
        low = row[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0]
        at = nodes[at["leftChild"] if low else at["rightChild"]]
    return at["prediction"]


def test_pruned_forest_equals_a_walk_that_stops_at_small_nodes(spark):
    rows = _rows(spark)
    grown = RandomForestRegressor(labelCol="popularity", numTrees=4, maxDepth=9, seed=3).fit(rows)
    path = scratch_path(spark, "grown")
    grown.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    for minimum in (2, 5, 40):
        cut = model.min_rows_to_split(spark, grown, minimum)
        got = cut.transform(rows).select("a", "b", "prediction").collect()
        want = [sum(_walk(t, (r["a"], r["b"]), minimum) for t in trees.values()) / len(trees) for r in got]
        assert max(abs(r["prediction"] - w) for r, w in zip(got, want)) < 1e-9
    assert cut.totalNumNodes < grown.totalNumNodes
    assert abs(sum(cut.featureImportances.toArray()) - 1) < 1e-9


def test_a_limit_grows_the_same_tree_as_the_leaf_minimum_forbids(spark):
    """Under a leaf minimum of m no node of fewer than 2 m rows is split, so that limit changes nothing."""
    rows = _rows(spark)
    grown = RandomForestRegressor(labelCol="popularity", numTrees=2, maxDepth=8, minInstancesPerNode=3, seed=1).fit(rows)
    assert model.min_rows_to_split(spark, grown, 6).totalNumNodes == grown.totalNumNodes


def test_grid_is_whole_and_draws_are_distinct():
    every = model.draw_params(TUNE_GRID, 10 ** 6)
    assert len(every) == 36 == len({json.dumps(c) for c in every})
    drawn = model.draw_params()
    assert len(drawn) == 3 and all(c in every for c in drawn) and drawn == model.draw_params()


def test_candidates_that_differ_in_the_limit_share_a_fit(spark):
    folded = _rows(spark).withColumn("fold", (F.col("id") % 2).cast("int"))
    rf = RandomForestRegressor(labelCol="popularity", seed=1)
    cands = [{"numTrees": 3, "maxDepth": 5, "minRowsToSplit": m} for m in (2, 30)]
    together = model.forest_scores(rf, folded, cands, 2, 2)
    apart = [model.forest_scores(rf, folded, [c], 2, 1)[0] for c in cands]
    assert all(abs(x - y) < 1e-9 for x, y in zip(together, apart))
    assert together[0] != together[1]
