"""The dashboard snapshot: a lean projection of the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sampling import sample_exact
from cadenza.schema import SEED, SNAPSHOT_CAP, SNAPSHOT_COLUMNS


def snapshot(features: DataFrame) -> DataFrame:
    """All rows, the snapshot columns that exist, categoricals as text."""
    cols = [c for c in SNAPSHOT_COLUMNS if c in features.columns]
    return features.select(*[F.col(c).cast("string").alias(c) if c.endswith("_category") else F.col(c)
                             for c in cols])


def snapshot_sample(features: DataFrame, rows: int = SNAPSHOT_CAP, key: str = "id", seed: int = SEED) -> DataFrame:
    """The snapshot of an exact seeded sample, for a file of bounded size."""
    return snapshot(sample_exact(features, rows, key, seed))
