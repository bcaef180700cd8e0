"""Derived features: row-wise projections and table-wide statistics.

Table-wide statistics (min/max of loudness, skewness of the audio features)
are computed in ONE aggregate pass; the few resulting numbers come back to the
driver (they decide which ``*_log`` columns exist) and enter the plan as
literals, so no single-partition window is ever used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import (clip, energy_category, flag,
                                       popularity_category)
from cadenza.schema import (AUDIO_FEATURES, CURRENT_YEAR, MODERN_YEAR,
                            POPULAR_ARTIST, SKEW_THRESHOLD)


def basic(df: DataFrame, year: int = CURRENT_YEAR) -> DataFrame:
    """F1 duration in minutes, F2 age in years (never negative)."""
    return df.select("*",
                     (F.col("duration_ms") / 60000).alias("duration_min"),
                     F.greatest(F.lit(0), F.lit(year) - F.col("release_year")).cast("int").alias("track_age"))


def table_stats(df: DataFrame, shift_col: str = "loudness",
                skew_cols: list[str] = AUDIO_FEATURES) -> dict:
    """One aggregate pass: min/max of ``shift_col`` and the (biased) skewness of
    each of ``skew_cols``. Returns a small dict (bounded size)."""
    cols = [c for c in skew_cols if c in df.columns]
    aggs = [F.min(shift_col).alias("_min"), F.max(shift_col).alias("_max")]
    aggs += [F.skewness(c).alias(c) for c in cols]
    row = df.agg(*aggs).first()
    return {"min": row["_min"], "max": row["_max"],
            "skew": {c: row[c] for c in cols}}


def skewness_frame(df: DataFrame, cols: list[str] = AUDIO_FEATURES) -> DataFrame:
    """A3 as a table: (feature, skewness), one aggregate pass, unpivoted."""
    cols = [c for c in cols if c in df.columns]
    wide = df.agg(*[F.skewness(c).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "skewness")


def shift_to_zero(df: DataFrame, col: str, lo: float, name: str | None = None) -> DataFrame:
    """A1: ``x - min(x)`` with the minimum from :func:`table_stats`."""
    return df.withColumn(name or f"{col}_shifted", F.col(col) - F.lit(lo))


def minmax(df: DataFrame, col: str, lo: float, hi: float, name: str | None = None) -> DataFrame:
    """A2: min-max scale; a zero range gives NULL."""
    rng = F.lit(hi) - F.lit(lo)
    return df.withColumn(name or f"{col}_norm", F.try_divide(F.col(col) - F.lit(lo), rng))


def log_skewed(df: DataFrame, skew: dict, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """A4: ``<c>_log = log1p(c)`` for every column whose skewness exceeds
    ``threshold`` (NULL for x <= -1)."""
    high = [c for c in skew if skew[c] is not None and skew[c] > threshold]
    return df.select("*", *[F.log1p(c).alias(f"{c}_log") for c in high])


def engineer(df: DataFrame) -> DataFrame:
    """Categories, products, clipped vocal density, follower log, flags."""
    return df.select(
        "*",
        popularity_category("popularity").alias("popularity_category"),
        energy_category("energy").alias("energy_category"),
        (F.col("danceability") * F.col("energy")).alias("dance_energy_index"),
        (F.col("acousticness") * F.col("instrumentalness")).alias("acoustic_instrumental"),
        (F.col("valence") * F.col("energy")).alias("mood_score"),
        clip(1 - F.col("instrumentalness") - F.col("speechiness"), 0.0, 1.0).alias("vocal_density"),
        F.log1p("artist_followers").alias("followers_log"),
        flag(F.col("release_year") >= MODERN_YEAR).alias("is_modern"),
        flag(F.col("artist_popularity") >= POPULAR_ARTIST).alias("is_popular_artist"),
    )


def build(joined: DataFrame, year: int = CURRENT_YEAR, threshold: float = SKEW_THRESHOLD,
          stats: dict | None = None) -> tuple[DataFrame, dict]:
    """Joined tracks -> full feature table. Returns (features, stats)."""
    df = basic(joined, year)
    if stats is None:
        stats = table_stats(df)
    df = shift_to_zero(df, "loudness", stats["min"])
    df = log_skewed(df, stats["skew"], threshold)
    df = engineer(df)
    df = minmax(df, "loudness", stats["min"], stats["max"])
    return df, stats
