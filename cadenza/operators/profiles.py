"""Genre- and artist-relative views (the dashboard's suggested extras).

Group statistics are computed with a map-side-combined ``groupBy`` and joined
back on the group key, never with a window partitioned by the group: a genre
holding a third of all rows would otherwise land whole in one task. The join
side has one row per group; AQE broadcasts it when its measured size allows
and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import round_to
from cadenza.operators.join import HOT_FRACTION, join_dimension
from cadenza.schema import AUDIO_FEATURES
from cadenza.session import materialize

BROADCAST_GROUPS = 100_000      # about 50 bytes a group: some 5 MB
MOOD_LIMIT = 0.5
# valence high/low x energy high/low
MOOD_LABELS = {(True, True): "Happy-Energetic", (True, False): "Calm-Positive",
               (False, True): "Tense-Energetic", (False, False): "Sad-Calm"}


def genre_zscore(df: DataFrame, value: str = "popularity", group: str = "primary_genre",
                 key: str = "id", broadcast_rows: int = BROADCAST_GROUPS,
                 hot_fraction: float = HOT_FRACTION) -> DataFrame:
    """Popularity as a z-score within its genre (sample std; a one-row genre
    or a constant genre gives NULL; rows without a genre go).

    The group table is written and counted. Up to ``broadcast_rows`` groups it
    is broadcast and the rows don't move; beyond, rows of groups with more than
    ``hot_fraction`` of all rows (fewer than ``1 / hot_fraction``, named by
    the group table itself) are salted in the shuffle join.
    """
    rows = df.select(key, group, value).where(F.col(group).isNotNull())
    stats = materialize(rows.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"),
                                                F.count(F.lit(1)).alias("_n")), "groups")
    size = stats.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    slim = stats.select(group, "_m", "_s")
    if size["groups"] <= broadcast_rows:
        both = rows.join(F.broadcast(slim), group)
    else:
        hot = [r[group] for r in stats.where(F.col("_n") > hot_fraction * size["rows"]).select(group).collect()]
        both = join_dimension(rows, slim, group, null_safe=False, hot=hot)
    return both.select(key, group, value,
                       round_to(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), 6).alias("genre_z"))


def top_k(df: DataFrame, value: str = "dance_energy_index", k: int = 10,
          cols: tuple = ("id", "name", "artist_name")) -> DataFrame:
    """The ``k`` largest rows by ``value`` (ties by the shown columns);
    each task keeps only its own top ``k``."""
    shown = [c for c in cols if c in df.columns]
    return (df.orderBy(F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in shown])
              .limit(k).select(*shown, value))


def mood_quadrant(valence: str = "valence", energy: str = "energy", limit: float = MOOD_LIMIT):
    v, e = F.col(valence) >= limit, F.col(energy) >= limit
    out = None
    for (hv, he), label in MOOD_LABELS.items():
        cond = (v if hv else ~v) & (e if he else ~e)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def mood_profile(df: DataFrame) -> DataFrame:
    """Rows, mean popularity and mean mood score per mood quadrant."""
    return (df.where(F.col("valence").isNotNull() & F.col("energy").isNotNull())
              .groupBy(mood_quadrant().alias("mood"))
              .agg(F.count(F.lit(1)).alias("n"), round_to(F.avg("popularity"), 6).alias("avg_popularity"),
                   round_to(F.avg("mood_score"), 6).alias("avg_mood_score")))


def artist_vs_genre(df: DataFrame, feats: list[str] = AUDIO_FEATURES, artist: str = "artist_name",
                    group: str = "primary_genre") -> DataFrame:
    """Each artist's mean of each audio feature against its genre's mean,
    long form (artist, genre, feature, artist_mean, genre_mean, diff)."""
    feats = [f for f in feats if f in df.columns]
    a = df.groupBy(artist, group).agg(*[F.avg(f).alias(f) for f in feats])
    g = df.groupBy(group).agg(*[F.avg(f).alias(f"g_{f}") for f in feats])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("am"), F.col(f"g_{f}").alias("gm"))
                      for f in feats])
    return (a.join(g, group).select(artist, group, F.inline(cells))
             .select(artist, group, "feature", round_to("am", 6).alias("artist_mean"),
                     round_to("gm", 6).alias("genre_mean"), round_to(F.col("am") - F.col("gm"), 6).alias("diff")))
