"""The offline job: CSV tracks + artists -> cleaned, joined features ->
selection -> models -> tuned forest -> artifacts and dashboard snapshot.

    python -m cadenza.plans.training --tracks t.csv --artists a.csv --out DIR

Each step is DataFrame -> DataFrame; jobs start only for the table statistics,
feature selection, fitting and the writes. The joined table is written once to
the shared folder, so later passes read columns from files instead of
re-running scans, the dedup shuffle and the join.
"""

from __future__ import annotations

import argparse
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import clean, features, join, metrics, model, select
from cadenza.plans import dashboard
from cadenza.schema import ARTISTS_SCHEMA, POSITION, TRACKS_SCHEMA
from cadenza.session import get_session, materialize
from cadenza.sources import artifacts
from cadenza.sources.csv import scan_csv


def in_files(df: DataFrame) -> list[str] | None:
    """The columns that order a scan as its files do, if it has them."""
    return POSITION if set(POSITION) <= set(df.columns) else None


def features_from_sources(tracks: DataFrame, artists: DataFrame,
                          order_by: list[str] | None = None, fit_on: str = "all",
                          key: str = "id") -> tuple[DataFrame, dict]:
    """Cleaned, joined, featured tracks. ``fit_on="all"`` (default, as the
    reproduced job) takes min/max and skewness over every row; ``"train"``
    over the training rows only (the split is a hash of the key, so it is
    known before any model code runs and test rows do not leak)."""
    t = clean.clean_tracks(tracks, order_by=order_by or in_files(tracks))
    a = clean.clean_artists(artists, order_by=in_files(artists))
    j = materialize(join.join_written(t, a), "joined")
    if fit_on == "train":
        train_rows = features.basic(model.with_split(j, key).where(~F.col("is_test")))
        return features.build(j, stats=features.table_stats(train_rows))
    return features.build(j)


def run(spark: SparkSession, tracks: DataFrame, artists: DataFrame, out_dir: str,
        sizes: model.Sizes | None = None, cap: int | None = None,
        snapshot_cap: int | None = None, tune_grid: dict | None = None,
        regressors: list[str] | None = None, classifiers: list[str] | None = None,
        fit_on: str = "all") -> dict:
    feats_df, stats = features_from_sources(tracks, artists, fit_on=fit_on)
    sel_rows = (model.with_split(feats_df).where(~F.col("is_test")) if fit_on == "train" else feats_df)
    selected = [r["feature"] for r in select.select_features(sel_rows).collect()]
    train, test, classes, sc = model.prepare(feats_df, selected, cap=cap)
    reg = model.train_regressors(train, test, selected, sc, names=regressors, sizes=sizes)
    clf = model.train_classifiers(train, test, selected, sc, classes, names=classifiers, sizes=sizes)
    kw = {"grid": tune_grid} if tune_grid else {}
    tuned_model, tuned, imp = model.tune_forest(train, test, selected, sc, **kw)
    best_clf = metrics.best_model(clf.metrics).where(F.col("task") == "classification").first()["best_model"]
    cm = metrics.confusion_matrix(clf.predictions.where(F.col("model") == best_clf))
    all_metrics = reg.metrics.unionByName(clf.metrics).unionByName(tuned)
    snap = dashboard.snapshot_sample(feats_df, snapshot_cap) if snapshot_cap else dashboard.snapshot(feats_df)
    artifacts.save(out_dir, tuned_model, all_metrics, imp, cm, snap, classes)
    board = metrics.leaderboard(all_metrics.where(F.col("task") != "tuned"))
    return {
        "features": selected,
        "classes": classes,
        "skewness": stats["skew"],
        "best_classifier": best_clf,
        "leaderboard": [r.asDict() for r in board.orderBy("task", "rank").collect()],
        "artifacts": out_dir,
    }


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Train the popularity models and write artifacts.")
    ap.add_argument("--tracks", required=True)
    ap.add_argument("--artists", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--fit-on", choices=["all", "train"], default="all",
                    help="rows that feature statistics and selection see")
    ap.add_argument("--multi-line", action="store_true",
                    help="quoted fields hold line breaks (a file is read by one task)")
    ap.add_argument("--snapshot-rows", type=int, default=None,
                    help="sample so many rows for the snapshot (default: all rows)")
    args = ap.parse_args(argv)
    spark = get_session(args.master)

    def scan(label, path, schema):
        try:
            return scan_csv(spark, path, schema, args.multi_line, positions=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(f"{label} file not found: {path}") from e
            raise
    tracks = scan("tracks", args.tracks, TRACKS_SCHEMA)
    artists = scan("artists", args.artists, ARTISTS_SCHEMA)
    done = run(spark, tracks, artists, args.out, fit_on=args.fit_on, snapshot_cap=args.snapshot_rows)
    print(json.dumps(done, default=str, indent=1))


if __name__ == "__main__":
    main()
