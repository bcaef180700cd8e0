"""The dimension join: tracks -> artists on the first artist id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize

ARTIST_RENAME = {
    "id": "artist_id_key",
    "followers": "artist_followers",
    "popularity": "artist_popularity",
    "primary_genre": "primary_genre",
    "genre_count": "artist_genre_count",
}
ARTIST_FILL = {
    "artist_followers": 0.0,
    "artist_popularity": 0.0,
    "primary_genre": "unknown",
    "artist_genre_count": 0,
}


def slim_dimension(artists: DataFrame, rename: dict = ARTIST_RENAME) -> DataFrame:
    """Project and rename the dimension side (only the columns the join needs)."""
    return artists.select(*[F.col(src).alias(dst) for src, dst in rename.items()])


SALTS = 64
HOT_FRACTION = 0.01
SKETCH_ITEMS = 10_000       # counters of the heavy-hitter sketch
MAX_BROADCAST_ROWS = 1_000_000   # at most about 100 MB of slim dimension rows


def _top(key: str, fraction: float) -> list[Column]:
    """One-pass aggregates: the rows, and a bounded sketch of the most frequent
    present keys (mergeable, estimates within rows / ``SKETCH_ITEMS`` or so)."""
    k = min(int(1 / fraction) + 1, SKETCH_ITEMS // 2)
    return [F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k(`{key}`, {k}, {SKETCH_ITEMS})").alias("top")]


def _above(found: dict, fraction: float) -> list:
    return [r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] > fraction * found["n"]]


def hot_keys(fact: DataFrame, key: str, fraction: float = HOT_FRACTION) -> list:
    """Present keys holding more than ``fraction`` of the fact rows (fewer than
    ``1 / fraction``), by a sketch in one pass over the key column. A key near
    the limit may be named too; salting it changes no row."""
    return _above(fact.agg(*_top(key, fraction)).first().asDict(), fraction)


def write_fact(fact: DataFrame, name: str, key: str, fraction: float = HOT_FRACTION) -> tuple[DataFrame, list]:
    """The fact written to the shared folder, and its hot keys, found by the
    sketch in a pass over the written key column. (Not by an ``Observation`` of the
    write: the session then holds a manager that can't be serialised, and models
    that carry the session to their tasks fail.)"""
    written = materialize(fact, name)
    return written, hot_keys(written, key, fraction)


def write_dimension(dim: DataFrame, name: str, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The dimension written to the shared folder, and whether it is counted as
    small enough to broadcast. Sizes of unwritten aggregates are guessed, and the
    planner then shuffles the whole fact before it has seen how small the dimension is."""
    written = materialize(dim, name)
    small = written.count() <= max_rows
    return (F.broadcast(written) if small else written), small


def join_dimension(fact: DataFrame, dim: DataFrame, key: str,
                   fill: dict | None = None, null_safe: bool = True,
                   salts: int = SALTS, hot_fraction: float | None = None,
                   hot: list | None = None) -> DataFrame:
    """Left equi-join; unmatched rows get ``fill`` values.

    ``null_safe`` (default) matches a missing key with a missing key, as the
    reproduced behaviour does; ``False`` gives SQL semantics. The dimension is
    unique on ``key``, the missing key being one key, so the fact side never
    fans out. No broadcast hint on the dimension: the planner broadcasts it
    when its measured size allows, otherwise it is a sort-merge join.

    Skew is salted explicitly. Fact rows whose key is missing or ``hot`` (from
    :func:`write_fact`, or looked for here with ``hot_fraction``) get a salt
    1..``salts`` from a hash of the row (deterministic, so a retried task puts
    its rows in the same place); all other rows get 0. The dimension is read
    once; its rows of those keys are repeated once per salt. A key holding a
    third of all rows thus spreads over ``salts`` partitions in one join.
    """
    dim_key, fsalt, dsalt = "_dim_" + key, "_salt", "_dim_salt"
    if hot is None:
        hot = hot_keys(fact, key, hot_fraction) if hot_fraction else []

    def spread(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).isin(hot) if hot else F.col(c).isNull()

    row_hash = F.xxhash64(*[F.col(c) for c in fact.columns])
    f = fact.withColumn(fsalt, F.when(spread(key), F.pmod(row_hash, F.lit(salts)) + 1)
                               .otherwise(F.lit(0)).cast("int"))
    d = dim.withColumnRenamed(key, dim_key)
    if not null_safe:
        d = d.where(F.col(dim_key).isNotNull())
    d = d.withColumn(dsalt, F.explode(F.when(spread(dim_key), F.sequence(F.lit(1), F.lit(salts)))
                                       .otherwise(F.array(F.lit(0)))))
    cond = f[key].eqNullSafe(d[dim_key]) & (f[fsalt] == d[dsalt])
    out = f.join(d, cond, "left").drop(dim_key, fsalt, dsalt)
    if fill:
        out = out.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
                           for c in out.columns])
    return out


def join_artists(tracks: DataFrame, artists: DataFrame, null_safe: bool = True,
                 hot: list | None = None) -> DataFrame:
    """Slim artists, left join on ``artist_id_key``, fill 0/0/unknown/0."""
    return join_slim(tracks, slim_dimension(artists), null_safe, hot)


def join_slim(tracks: DataFrame, slim: DataFrame, null_safe: bool = True, hot: list | None = None) -> DataFrame:
    out = join_dimension(tracks, slim, "artist_id_key", ARTIST_FILL, null_safe, hot=hot)
    return out.withColumn("artist_genre_count", F.col("artist_genre_count").cast("int"))


def join_written(tracks: DataFrame, artists: DataFrame, name: str = "tracks", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """:func:`join_artists` over written artists. Small ones are broadcast to the
    tasks that make the tracks: no shuffle, so no skew, and no written copy of the
    tracks. Else the tracks are written first, and their hot keys found and salted."""
    slim, small = write_dimension(slim_dimension(artists), "artists", max_rows)
    hot = None
    if not small:
        tracks, hot = write_fact(tracks, name, "artist_id_key")
    return join_slim(tracks, slim, hot=hot)
