"""Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators.clean import normalise_nan

# rows per output file; keeps files a sensible size at any table size
MAX_RECORDS_PER_FILE = 1_000_000


def scan(spark: SparkSession, path: str, columns: list[str] | None = None,
         nan_to_null: bool = False) -> DataFrame:
    """Read parquet; select early so only the needed columns are read."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return normalise_nan(df) if nan_to_null else df


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write the dashboard snapshot (no index column); optionally partitioned
    (e.g. by decade) so explorer filters prune files."""
    w = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str, with_decade: bool = True) -> DataFrame:
    """Read the snapshot; re-derive ``decade`` as the dashboard does."""
    from cadenza.functions.numeric import decade
    df = spark.read.parquet(path)
    if with_decade and "decade" not in df.columns:
        df = df.withColumn("decade", decade("release_year"))
    return df
