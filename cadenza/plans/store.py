"""Build-once tables and models in the shared work folder.

The feature table (clean -> dedup -> join -> features) and the tuned model
are what every dashboard and scoring query reads. They are built once per
table set, written to the session's shared folder (``spark.checkpoint.dir``)
and read back, exactly as the offline job writes a snapshot and artifacts for
the dashboard. A written table also cuts the lineage: a lost executor only
re-reads files instead of recomputing scans, shuffles and joins.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import scratch_path, shuffles_for

_TABLES: dict[tuple, str] = {}
_BUNDLES: dict[tuple, dict] = {}


def _signature(sf_dir: str) -> tuple:
    """Changes when a source table is rewritten (local paths only)."""
    try:
        names = sorted(os.listdir(sf_dir))
        return tuple((n, int(os.stat(os.path.join(sf_dir, n)).st_mtime), os.stat(os.path.join(sf_dir, n)).st_size)
                     for n in names)
    except OSError:
        return ()


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (spark.sparkContext.applicationId, name, sf_dir.rstrip("/"), _signature(sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str, build, rows=None) -> DataFrame:
    """``build(spark, sf_dir) -> DataFrame`` written once to the shared folder;
    its shuffles are sized for ``rows(spark, sf_dir)`` rows."""
    k = _key(spark, sf_dir, name)
    if k not in _TABLES:
        path = scratch_path(spark, name)
        with shuffles_for(spark, rows(spark, sf_dir) if rows else 0):
            build(spark, sf_dir).write.mode("overwrite").parquet(path)
        _TABLES[k] = path
    return spark.read.parquet(_TABLES[k])


def bundle(spark: SparkSession, sf_dir: str, name: str, build) -> dict:
    """``build(spark, sf_dir) -> dict`` (e.g. a saved model and its tables), once."""
    k = _key(spark, sf_dir, name)
    if k not in _BUNDLES:
        _BUNDLES[k] = build(spark, sf_dir)
    return _BUNDLES[k]
