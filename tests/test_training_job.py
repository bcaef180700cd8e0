"""The offline job end to end on small music-shaped CSV files."""

import os

import numpy as np

from cadenza.plans import training
from cadenza.schema import ARTISTS_SCHEMA, TRACKS_SCHEMA
from cadenza.sources import artifacts
from cadenza.sources.csv import scan_csv


def write_csvs(d, n=300, seed=5):
    rng = np.random.default_rng(seed)
    t = os.path.join(d, "tracks.csv")
    a = os.path.join(d, "artists.csv")
    with open(t, "w") as fh:
        fh.write(",".join(f.name for f in TRACKS_SCHEMA.fields) + "\n")
        for i in range(n):
            art = i % 12
            pop = float(min(100, max(0, rng.normal(45, 20))))
            year = 1950 + i % 70
            date = [f"{year}", f"{year}-03", f"{year}-03-14"][i % 3]
            fh.write(f"t{i % (n - 10)},song {i},{pop:.0f},{rng.uniform(9e4, 4e5):.0f},{i % 2},"
                     f"\"['Artist {art}']\",\"['a{art}']\",{date},"
                     + ",".join(f"{v:.4f}" for v in [rng.uniform(), rng.uniform(), rng.uniform(-30, 0),
                                                     rng.exponential(0.05), rng.uniform(), rng.uniform() ** 4,
                                                     rng.exponential(0.1), rng.uniform(), rng.uniform(60, 180)])
                     + "\n")
    with open(a, "w") as fh:
        fh.write("id,followers,popularity,genres\n")
        for k in range(10):
            fh.write(f"a{k},{k * 1000},{k * 9},\"['g{k}', 'h']\"\n")
    return t, a


def test_training_job(spark, tmp_dir):
    t, a = write_csvs(tmp_dir)
    out = os.path.join(tmp_dir, "artifacts")
    res = training.run(spark, scan_csv(spark, t, TRACKS_SCHEMA), scan_csv(spark, a, ARTISTS_SCHEMA), out,
                       sizes=training.model.Sizes(trees=4, forest_depth=3, boost_rounds=2, tree_depth=3),
                       tune_grid={"numTrees": [3, 4], "maxDepth": [2, 3], "minInstancesPerNode": [1]},
                       regressors=["Linear Regression", "Decision Tree"],
                       classifiers=["Decision Tree", "Gaussian Naive Bayes"])
    assert res["features"] and res["classes"][0] < res["classes"][-1]
    loaded = artifacts.load(spark, out)
    assert loaded["features"] == res["features"]
    imp = [r["importance"] for r in loaded["importance"].collect()]
    assert imp == sorted(imp, reverse=True)
    assert spark.read.parquet(os.path.join(out, "snapshot")).count() > 0
    sizes = {r["artifact"]: r["bytes"] for r in artifacts.sizes(spark, out).collect()}
    assert set(sizes) == {"metrics", "importance", "confusion"} and all(v > 0 for v in sizes.values())


def test_fit_on_train_uses_training_rows_only(spark, tmp_dir):
    from pyspark.sql import functions as F
    from cadenza.operators import model
    t, a = write_csvs(tmp_dir, n=200, seed=9)
    tracks, artists = scan_csv(spark, t, TRACKS_SCHEMA), scan_csv(spark, a, ARTISTS_SCHEMA)
    _, all_stats = training.features_from_sources(tracks, artists)
    feats, train_stats = training.features_from_sources(tracks, artists, fit_on="train")
    train_only = model.with_split(feats).where(~F.col("is_test"))
    assert train_stats["min"] == train_only.agg(F.min("loudness")).first()[0]
    assert all_stats["min"] <= train_stats["min"]
