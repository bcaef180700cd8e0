"""The facts behind the dashboard's insight sentences, computed as group-bys.

Each function is one aggregate pass over the feature table (bins take their
edges from one min/max aggregate) followed by work on the small aggregated
result only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import pearson, round_to

from cadenza.operators.explore import literal_bin

ARTIST_FEATURES = ["artist_popularity", "followers_log", "artist_genre_count", "is_popular_artist"]
AUDIO_SET = ["danceability", "energy", "loudness", "speechiness", "acousticness",
             "instrumentalness", "liveness", "valence", "tempo"]
# tempo bands (BPM) and duration bands (minutes): label, lower bound (inclusive)
TEMPO_BANDS = [("<90", None), ("90-120", 90.0), ("120-130", 120.0), ("130-150", 130.0), (">=150", 150.0)]
DURATION_BANDS = [("<1.5", None), ("1.5-2.5", 1.5), ("2.5-4", 2.5), ("4-7", 4.0), (">7", 7.0)]
SPEECH_LIMIT = 0.66


def _hit() -> Column:
    return (F.col("popularity_category") == "Hit").cast("double")


def _band(col: str, bands: list) -> Column:
    out = None
    for label, lo in reversed(bands):
        cond = F.lit(True) if lo is None else (F.col(col) >= lo)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(F.col(col).isNull(), None).otherwise(out)


def _band_order(col: str, bands: list) -> Column:
    out = F.lit(None).cast("int")
    for i, (label, _) in enumerate(bands):
        out = F.when(F.col(col) == label, i + 1).otherwise(out)
    return out


def corr_ranked(df: DataFrame, cols: list[str], target: str = "popularity") -> DataFrame:
    """Correlation of each column with the target, ranked by |corr|."""
    wide = df.agg(*[pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "corr").select("feature", round_to("corr", 6).alias("corr"))
    w = Window.orderBy(F.abs("corr").desc_nulls_last(), "feature")
    return long.select("*", F.row_number().over(w).alias("rank"))


def artist_vs_audio(df: DataFrame, target: str = "popularity") -> DataFrame:
    """Mean and max |corr| with the target, artist features vs audio."""
    cols = [c for c in ARTIST_FEATURES + AUDIO_SET if c in df.columns]
    wide = df.agg(*[pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "corr")
    group = F.when(F.col("feature").isin(ARTIST_FEATURES), "artist").otherwise("audio")
    return (long.groupBy(group.alias("feature_group"))
                .agg(round_to(F.avg(F.abs("corr")), 6).alias("mean_abs_corr"),
                     round_to(F.max(F.abs("corr")), 6).alias("max_abs_corr")))


def dance_energy_quadrants(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Mean popularity in the 2x2 quadrants of danceability x energy."""
    return (df.where(F.col("danceability").isNotNull() & F.col("energy").isNotNull())
              .groupBy((F.col("danceability") >= limit).alias("high_dance"),
                       (F.col("energy") >= limit).alias("high_energy"))
              .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg("popularity"), 6).alias("avg_popularity")))


def binned_mean(df: DataFrame, col: str, bins: int = 10, target: str = "popularity",
                by: Column | None = None) -> DataFrame:
    """Mean target per equal-width bin of ``col`` (I4, I5, I12, I13): one
    min/max aggregate (two numbers to the driver), then one group-by."""
    src = df.where(F.col(col).isNotNull())
    row = src.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    keys = [] if by is None else [by]
    b = literal_bin(F.col(col).cast("double"), row["lo"], row["hi"], bins).alias("bin")
    return (src.groupBy(*keys, b)
               .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg(target), 6).alias("avg_popularity")))


def acousticness_by_period(df: DataFrame, years: tuple[int, int] = (2010, 2020), bins: int = 10) -> DataFrame:
    """Mean popularity per acousticness bin, inside the year window and overall."""
    inside = F.col("release_year").between(years[0], years[1])
    win = binned_mean(df.where(inside), "acousticness", bins).withColumn("period", F.lit(f"{years[0]}-{years[1]}"))
    allp = binned_mean(df, "acousticness", bins).withColumn("period", F.lit("all"))
    return win.unionByName(allp)


def mean_by(df: DataFrame, key: str, target: str = "popularity") -> DataFrame:
    """Mean of ``target`` by a key column."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg(target), 6).alias(f"avg_{target}")))


def banded(df: DataFrame, col: str, bands: list) -> DataFrame:
    """Mean popularity and hit rate per band of ``col``."""
    return (df.where(F.col(col).isNotNull())
              .groupBy(_band(col, bands).alias("band"))
              .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg("popularity"), 6).alias("avg_popularity"),
                   round_to(F.avg(_hit()), 6).alias("hit_rate"))
              .withColumn("ord", _band_order("band", bands)))


def decades_with_change(df: DataFrame) -> DataFrame:
    """Per decade the count, mean popularity and the change of the mean
    against the previous decade (``lag`` over the few decade rows)."""
    agg = (df.where(F.col("decade") != "0s").groupBy("decade")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("popularity").alias("_m")))
    w = Window.orderBy("decade")
    return agg.select("decade", "n", round_to("_m", 6).alias("avg_popularity"),
                      round_to(F.col("_m") - F.lag("_m").over(w), 6).alias("change"))


def speechiness_split(df: DataFrame, limit: float = SPEECH_LIMIT) -> DataFrame:
    """Hit rate above / at-or-below the speechiness limit."""
    return (df.where(F.col("speechiness").isNotNull())
              .groupBy((F.col("speechiness") > limit).alias("above_limit"))
              .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg(_hit()), 6).alias("hit_rate")))


def valence_profile(df: DataFrame, bins: int = 10) -> DataFrame:
    """Correlation of valence with popularity, plus the binned means."""
    corr = df.agg(round_to(pearson("valence", "popularity"), 6).alias("corr")).withColumn("_k", F.lit(1))
    return (binned_mean(df, "valence", bins).withColumn("_k", F.lit(1))
            .join(F.broadcast(corr), "_k").drop("_k"))
