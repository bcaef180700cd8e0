"""Cleaning operators (dedup, missing values, parsing, sanity filters)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.dates import release_year as release_year_expr
from cadenza.functions.numeric import nan_to_null
from cadenza.functions.text import first_of_list, list_or_empty, trim_space
from cadenza.schema import YEAR_RANGE


def dedup_keep_first(df: DataFrame, key: str | list[str], order_by: list[str] | None = None,
                     drop_order: bool = False) -> DataFrame:
    """One row per ``key`` (a column or several): the first by ``order_by`` (then all
    other columns). For the first in a file, scan with positions and order by
    ``schema.POSITION``. Rows that a join left grouped by one of the key's columns
    aren't shuffled again.

    Written as ``groupBy(key).agg(min(struct(order..., rest...)))`` rather than
    a ``row_number`` window: the aggregate is combined map-side, so a key that
    holds a third of all rows is reduced to one row per input partition before
    the shuffle instead of landing whole in one task. A missing key is one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    order_by = list(order_by or others)
    rest = [c for c in others if c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by + rest])
    first = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    keep = [c for c in others if not (drop_order and c in order_by)]
    out = first.select(*keys, *[F.col("_first").getField(c).alias(c) for c in keep])
    return out.select(*[c for c in df.columns if c in keys or c in keep])


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows where any of ``subset`` is missing (NULL or NaN)."""
    cond = F.lit(True)
    for c in subset:
        col = F.col(c)
        miss = col.isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            miss = miss | F.isnan(col)
        cond = cond & ~miss
    return df.where(cond)


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (right after a scan)."""
    return df.select(*[nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def first_rows(df: DataFrame, key: str, order_by: list[str] | None = None,
               widen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keep-first dedup without the order's columns. ``widen`` adds columns that
    are functions of the others (and drops the order's), after the shuffle
    instead of through it."""
    if widen is None:
        return dedup_keep_first(df, key, order_by, drop_order=bool(order_by))
    return widen(dedup_keep_first(df, key, order_by))


def clean_tracks(df: DataFrame, key: str = "id", order_by: list[str] | None = None,
                 year_range: tuple[int, int] = YEAR_RANGE,
                 widen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keep-first dedup, drop missing target/name, flag cast, release year,
    first artist name and id, trimmed names, positive tempo and duration,
    year range (both ends in)."""
    return clean_first(first_rows(df, key, order_by, widen), year_range)


def clean_first(df: DataFrame, year_range: tuple[int, int] = YEAR_RANGE) -> DataFrame:
    """:func:`clean_tracks` of rows whose keep-first is done."""
    df = drop_missing(df, ["popularity", "name"])
    passthrough = [c for c in df.columns
                   if c not in ("explicit", "name", "release_date", "artists", "id_artists")]
    df = df.select(
        *[F.col(c) for c in passthrough],
        trim_space(F.col("name")).alias("name"),
        F.col("explicit").cast("int").alias("explicit"),
        F.col("release_date"),
        F.col("artists"),
        F.col("id_artists"),
        release_year_expr("release_date").alias("release_year"),
        trim_space(first_of_list("artists", "Unknown")).alias("artist_name"),
        first_of_list("id_artists", None).alias("artist_id_key"),
    )
    return sanity_filter(df, year_range)


def sanity_filter(df: DataFrame, year_range: tuple[int, int] = YEAR_RANGE) -> DataFrame:
    lo, hi = year_range
    return df.where((F.col("tempo") > 0) & (F.col("duration_ms") > 0)
                    & F.col("release_year").between(lo, hi))


def clean_artists(df: DataFrame, key: str = "id", order_by: list[str] | None = None) -> DataFrame:
    """Keep-first dedup, parsed genre list, primary genre, genre count."""
    df = dedup_keep_first(df, key, order_by, drop_order=bool(order_by))
    genres = list_or_empty("genres")
    return df.select(
        *[F.col(c) for c in df.columns],
        genres.alias("genres_list"),
        F.coalesce(F.try_element_at(genres, F.lit(1)), F.lit("unknown")).alias("primary_genre"),
        F.size(genres).cast("int").alias("genre_count"),
    )


def clean_counts(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Row counts after cleaning, one row per table."""
    return (tracks.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("tracks").alias("table_name"), "n_rows")
            .unionByName(artists.agg(F.count(F.lit(1)).alias("n_rows"))
                         .select(F.lit("artists").alias("table_name"), "n_rows")))
