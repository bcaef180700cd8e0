"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL``.
Every query reads the whole given tables (through the mapped views) and runs
the library operators; no row caps, id subsets or prefixes. Queries over the
feature table read the joined tracks that :mod:`cadenza.plans.store` builds
once per table set in the shared folder (the oracle rebuilds the same table in
SQL from the raw tables); learning queries share one tuned-model bundle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.numeric import pearson, round_to  # noqa: F401

from cadenza import schema
from cadenza.operators import clean, features, join
from cadenza.plans.oracle_base import with_features
from cadenza.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query builder; ``oracle`` is the final SELECT over the
    feature CTEs (None: rows-only check)."""
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_features(oracle)
        return fn
    return wrap


def _insights_module():
    from cadenza.operators import insights
    return insights


def r6(c, digits: int = 6):
    return round_to(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------

def first_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracks, the first of each id."""
    return clean.first_rows(tables.music_rows(spark, sf_dir), "id", tables.TRACK_ORDER, tables.music_columns)


def cleaned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_tracks(tables.music_rows(spark, sf_dir), order_by=tables.TRACK_ORDER,
                              widen=tables.music_columns)


def cleaned_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_artists(tables.music_artists(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str, null_safe: bool = True) -> DataFrame:
    return join.join_artists(cleaned_tracks(spark, sf_dir), cleaned_artists(spark, sf_dir),
                             null_safe=null_safe)


def first_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`first_tracks` by order and line instead of their id: after the join
    with shuffled orders no further shuffle, and no id goes through one. Rows
    without a line have no id, which is one key over all orders: they stand apart,
    and scans skip them by the files' null counts where there are none."""
    rows = tables.order_rows(spark, sf_dir)
    lines = clean.dedup_keep_first(rows.where(F.col("k_line").isNotNull()), ["k_order", "k_line"], tables.TRACK_ORDER)
    no_line = clean.dedup_keep_first(rows.where(F.col("k_line").isNull()), "k_line", tables.TRACK_ORDER)
    return tables.music_columns(tables.with_ids(lines.unionByName(no_line)))


def build_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`joined` over the written artists."""
    tracks = clean.clean_first(first_of_lines(spark, sf_dir))
    return join.join_written(tracks, cleaned_artists(spark, sf_dir))


def fact_rows(spark: SparkSession, sf_dir: str) -> int:
    """Line items, by the files' metadata."""
    return tables.read_table(spark, sf_dir, "lineitem").count()


def build_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lazy plan: scans -> clean -> keep-first dedup -> join -> features."""
    feats, _ = features.build(joined(spark, sf_dir))
    return feats


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table over the joined tracks, which are built once per
    table set in the shared folder (the costly scans, dedup shuffle and join).
    The table statistics are one pass over that written table, also done
    once; the feature columns stay lazy so each query reads only what it
    needs."""
    from cadenza.plans import store
    j = store.table(spark, sf_dir, "joined", build_joined, fact_rows)
    stats = store.bundle(spark, sf_dir, "feature_stats",
                         lambda _s, _d: features.table_stats(features.basic(j)))
    feats, _ = features.build(j, stats=stats)
    return feats


def dashboard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table with the derived ``decade`` (the dashboard's frame)."""
    from cadenza.functions.numeric import decade
    return feature_table(spark, sf_dir).withColumn("decade", decade("release_year"))


# ---------------------------------------------------------------------------
# minimum slice
# ---------------------------------------------------------------------------

@query("popularity_by_decade", """
SELECT decade, round(avg(popularity), 6) AS avg_popularity
FROM feat WHERE decade <> '0s' GROUP BY decade
""")
def q_popularity_by_decade(spark, sf_dir):
    from cadenza.operators import explore
    return explore.popularity_by_decade(dashboard_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# cleaning (C1-C14)
# ---------------------------------------------------------------------------

RAW_COLS = ("id, name, popularity, duration_ms, explicit, artists, id_artists, release_date, "
            "danceability, energy, loudness, speechiness, acousticness, instrumentalness, "
            "liveness, valence, tempo")


@query("dedup_keep_first", f"SELECT {RAW_COLS} FROM t_first")
def q_dedup_keep_first(spark, sf_dir):
    return first_tracks(spark, sf_dir)


@query("dropna_subset", f"SELECT {RAW_COLS} FROM t_first WHERE popularity IS NOT NULL AND name IS NOT NULL")
def q_dropna_subset(spark, sf_dir):
    d = first_tracks(spark, sf_dir)
    return clean.drop_missing(d, ["popularity", "name"])


@query("cast_flag", "SELECT id, explicit FROM t_clean")
def q_cast_flag(spark, sf_dir):
    d = first_tracks(spark, sf_dir)
    return clean.drop_missing(d, ["popularity", "name"]).select("id", F.col("explicit").cast("int"))


def _parsed(spark, sf_dir):
    """Deduplicated, parsed tracks before the sanity filter."""
    from cadenza.functions.dates import release_year
    from cadenza.functions.text import first_of_list, trim_space
    d = clean.drop_missing(first_tracks(spark, sf_dir), ["popularity", "name"])
    return d.select("*", release_year("release_date").alias("release_year"),
                    trim_space(first_of_list("artists", "Unknown")).alias("artist_name"),
                    first_of_list("id_artists", None).alias("artist_id_key"),
                    trim_space("name").alias("name_trimmed"))


@query("release_year", "SELECT id, release_date, release_year FROM t_clean")
def q_release_year(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "release_date", "release_year")


@query("first_artist", "SELECT id, artists, artist_name, artist_id_key FROM t_clean")
def q_first_artist(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", "artists", "artist_name", "artist_id_key")


@query("trim_names", "SELECT id, name, artist_name FROM t_clean")
def q_trim_names(spark, sf_dir):
    return _parsed(spark, sf_dir).select("id", F.col("name_trimmed").alias("name"), "artist_name")


@query("sanity_filter", "SELECT id, release_year, tempo, duration_ms FROM c_tracks")
def q_sanity_filter(spark, sf_dir):
    return cleaned_tracks(spark, sf_dir).select("id", "release_year", "tempo", "duration_ms")


@query("clean_counts", """
SELECT 'tracks' AS table_name, count(*) AS n_rows FROM c_tracks
UNION ALL SELECT 'artists', count(*) FROM c_artists
""")
def q_clean_counts(spark, sf_dir):
    return clean.clean_counts(cleaned_tracks(spark, sf_dir), cleaned_artists(spark, sf_dir))


GENRES_SQL = """CASE WHEN genres = '[]' THEN ''
     WHEN genres LIKE '%,%' THEN regexp_extract(genres, '^\\[''([^'']*)''', 1) || '|'
                                 || regexp_extract(genres, '"([^"]*)"\\]$', 1)
     ELSE regexp_extract(genres, '^\\[''([^'']*)''', 1) END"""


@query("parse_genres", f"SELECT id, {GENRES_SQL} AS genres_joined, genre_count FROM c_artists")
def q_parse_genres(spark, sf_dir):
    a = cleaned_artists(spark, sf_dir)
    return a.select("id", F.array_join("genres_list", "|").alias("genres_joined"),
                    F.size("genres_list").cast("int").alias("genre_count"))


@query("primary_genre", "SELECT id, primary_genre FROM c_artists")
def q_primary_genre(spark, sf_dir):
    return cleaned_artists(spark, sf_dir).select("id", "primary_genre")


@query("genre_count", "SELECT id, genre_count FROM c_artists")
def q_genre_count(spark, sf_dir):
    return cleaned_artists(spark, sf_dir).select("id", "genre_count")


# ---------------------------------------------------------------------------
# join (J1-J3)
# ---------------------------------------------------------------------------

JOIN_OUT = "id, artist_id_key, artist_followers, artist_popularity, primary_genre, artist_genre_count"


@query("join_left", f"""
SELECT t.id, t.artist_id_key,
       coalesce(a.followers, 0) AS artist_followers, coalesce(a.popularity, 0) AS artist_popularity,
       coalesce(a.primary_genre, 'unknown') AS primary_genre,
       cast(coalesce(a.genre_count, 0) AS INTEGER) AS artist_genre_count
FROM c_tracks t LEFT JOIN c_artists a ON t.artist_id_key = a.id
""")
def q_join_left(spark, sf_dir):
    return joined(spark, sf_dir, null_safe=False).select(*JOIN_OUT.split(", "))


@query("join_left_nullsafe", f"SELECT {JOIN_OUT} FROM joined")
def q_join_left_nullsafe(spark, sf_dir):
    return joined(spark, sf_dir, null_safe=True).select(*JOIN_OUT.split(", "))


# ---------------------------------------------------------------------------
# features (F1-F12, A1-A4)
# ---------------------------------------------------------------------------

@query("feat_basic", "SELECT id, duration_min, track_age FROM feat")
def q_feat_basic(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "duration_min", "track_age")


@query("popularity_category", "SELECT id, popularity, popularity_category FROM feat")
def q_popularity_category(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "popularity", "popularity_category")


@query("energy_category", "SELECT id, energy, energy_category FROM feat")
def q_energy_category(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "energy", "energy_category")


@query("feat_products", "SELECT id, dance_energy_index, acoustic_instrumental, mood_score, vocal_density FROM feat")
def q_feat_products(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "dance_energy_index", "acoustic_instrumental",
                                               "mood_score", "vocal_density")


@query("feat_logs", "SELECT id, round(followers_log, 6) AS followers_log FROM feat")
def q_feat_logs(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", r6("followers_log").alias("followers_log"))


@query("feat_flags", "SELECT id, is_modern, is_popular_artist FROM feat")
def q_feat_flags(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "is_modern", "is_popular_artist")


@query("decade", "SELECT id, release_year, decade FROM feat")
def q_decade(spark, sf_dir):
    return dashboard_table(spark, sf_dir).select("id", "release_year", "decade")


@query("shift_to_zero", "SELECT id, loudness, loudness_shifted FROM feat")
def q_shift_to_zero(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "loudness", "loudness_shifted")


@query("minmax_norm", "SELECT id, loudness, loudness_norm FROM feat")
def q_minmax_norm(spark, sf_dir):
    return feature_table(spark, sf_dir).select("id", "loudness", "loudness_norm")


AUDIO = list(schema.AUDIO_FEATURES)

SKEW_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg((b.{c} - m.mu) * (b.{c} - m.mu) * (b.{c} - m.mu)) "
    f"/ pow(avg((b.{c} - m.mu) * (b.{c} - m.mu)), 1.5) AS skewness FROM base b, "
    f"(SELECT avg({c}) AS mu FROM base) m" for c in AUDIO)


@query("feature_skewness", f"SELECT feature, round(skewness, 6) AS skewness FROM ({SKEW_SQL})")
def q_feature_skewness(spark, sf_dir):
    df = features.basic(joined(spark, sf_dir))
    return features.skewness_frame(df).select("feature", r6("skewness").alias("skewness"))


LOG_SQL = " UNION ALL ".join(
    f"SELECT '{c}_log' AS feature, count(ln(1 + {c})) AS n_values, round(avg(ln(1 + {c})), 6) AS avg_log "
    f"FROM base WHERE {c} > -1" for c in AUDIO)


@query("skew_log_transform", f"""
SELECT l.feature, l.n_values, l.avg_log
FROM ({LOG_SQL}) l JOIN ({SKEW_SQL}) s ON l.feature = s.feature || '_log'
WHERE s.skewness > 1
""")
def q_skew_log_transform(spark, sf_dir):
    feats = feature_table(spark, sf_dir)
    logs = [c for c in feats.columns if c.endswith("_log") and c[:-4] in AUDIO]
    wide = feats.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("a")).alias(c) for c in logs])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).n.alias("n_values"),
                               round_to(F.col(c).a, 6).alias("avg_log")) for c in logs])
    if not logs:
        return spark.createDataFrame([], "feature string, n_values bigint, avg_log double")
    return wide.select(F.inline(cells))


# ---------------------------------------------------------------------------
# SQL text helpers for the oracles (generated, not parsed)
# ---------------------------------------------------------------------------

CATEGORY_ORD_SQL = ("CASE popularity_category WHEN 'Hit' THEN 1 WHEN 'Mainstream' THEN 2 "
                    "WHEN 'Emerging' THEN 3 WHEN 'Underground' THEN 4 END")


def bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    return (f"cast(CASE WHEN {hi} = {lo} THEN 1 ELSE least(greatest(floor({n} * ({x} - {lo}) / ({hi} - {lo})) + 1, 1), {n}) END"
            f" AS INTEGER)")


def corr_sql(a: str, b: str) -> str:
    """Pearson in DuckDB, NULL (not NaN) for a zero-variance side."""
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def hist_sql(src: str, cols: list[str], bins: int) -> str:
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, cast(min({c}) AS DOUBLE) AS lo, cast(max({c}) AS DOUBLE) AS hi FROM {src}"
        for c in cols)
    binned = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {bin_sql(f'cast(s.{c} AS DOUBLE)', 'st.lo', 'st.hi', bins)} AS bin "
        f"FROM {src} s, (SELECT cast(min({c}) AS DOUBLE) AS lo, cast(max({c}) AS DOUBLE) AS hi FROM {src}) st "
        f"WHERE s.{c} IS NOT NULL" for c in cols)
    return f"""
SELECT g.feature, g.bin,
       round(g.lo + (g.bin - 1) * ((g.hi - g.lo) / {bins}), 6) AS bin_lo,
       round(g.lo + g.bin * ((g.hi - g.lo) / {bins}), 6) AS bin_hi,
       cast(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT s.feature, s.lo, s.hi, cast(b.bin AS INTEGER) AS bin
      FROM ({stats}) s, range(1, {bins + 1}) b(bin) WHERE s.lo IS NOT NULL) g
LEFT JOIN (SELECT feature, bin, count(*) AS n FROM ({binned}) GROUP BY feature, bin) c
  ON g.feature = c.feature AND g.bin = c.bin
"""


EXPLORER_SRC = ("(SELECT * FROM feat WHERE popularity_category IN ('Hit', 'Mainstream', 'Emerging', "
                "'Underground') AND release_year BETWEEN 2000 AND 2020)")
EXPLORER_COLS = list(schema.EXPLORER_COLUMNS)
EXPLORER_ORDER = "popularity DESC NULLS LAST, " + ", ".join(f"{c} ASC NULLS LAST" for c in EXPLORER_COLS)
EXPLORER_SQL = f"SELECT {', '.join(EXPLORER_COLS)} FROM {EXPLORER_SRC} ORDER BY {EXPLORER_ORDER} LIMIT 500"
SEARCH_TEXT = "anvil|supplier#1[0-9]"


# ---------------------------------------------------------------------------
# dashboard aggregates
# ---------------------------------------------------------------------------

def _explore():
    from cadenza.operators import explore
    return explore


@query("overview_kpis", """
SELECT count(*) AS n_tracks, round(avg(popularity), 6) AS avg_popularity,
       count(DISTINCT artist_name) AS n_artists FROM feat
""")
def q_overview_kpis(spark, sf_dir):
    return _explore().overview_kpis(feature_table(spark, sf_dir))


@query("histogram_popularity", hist_sql("feat", ["popularity"], 50))
def q_histogram_popularity(spark, sf_dir):
    return _explore().histogram(feature_table(spark, sf_dir), ["popularity"], 50)


@query("category_counts", f"""
SELECT popularity_category, n, ord, round(n / sum(n) OVER (), 6) AS share
FROM (SELECT popularity_category, count(*) AS n, {CATEGORY_ORD_SQL} AS ord
      FROM feat WHERE popularity_category IS NOT NULL GROUP BY popularity_category)
""")
def q_category_counts(spark, sf_dir):
    return _explore().category_counts(feature_table(spark, sf_dir))


@query("peak_year", """
SELECT release_year AS peak_year, count(*) AS n FROM feat
GROUP BY release_year ORDER BY n DESC, release_year LIMIT 1
""")
def q_peak_year(spark, sf_dir):
    return _explore().peak_year(feature_table(spark, sf_dir))


@query("dataset_profile", """
SELECT round(avg(duration_min), 6) AS avg_duration_min, round(avg(explicit) * 100, 6) AS explicit_pct,
       count(DISTINCT primary_genre) AS n_genres FROM feat
""")
def q_dataset_profile(spark, sf_dir):
    return _explore().dataset_profile(feature_table(spark, sf_dir))


@query("year_bounds", "SELECT min(release_year) AS min_year, max(release_year) AS max_year FROM feat")
def q_year_bounds(spark, sf_dir):
    return _explore().year_bounds(feature_table(spark, sf_dir))


@query("explorer_kpis", f"""
SELECT count(*) AS n_tracks, round(avg(popularity), 6) AS avg_popularity,
       round(avg(energy), 6) AS avg_energy, round(avg(danceability), 6) AS avg_danceability
FROM {EXPLORER_SRC}
""")
def q_explorer_kpis(spark, sf_dir):
    ex = _explore()
    return ex.view_kpis(ex.explorer_filter(feature_table(spark, sf_dir)))


@query("histogram_filtered", hist_sql(EXPLORER_SRC, ["popularity", "energy", "danceability"], 40))
def q_histogram_filtered(spark, sf_dir):
    ex = _explore()
    return ex.histogram_view(ex.explorer_filter(feature_table(spark, sf_dir)))


@query("analytics_kpis", """
SELECT round(avg(popularity), 6) AS avg_popularity, round(avg(danceability), 6) AS avg_danceability,
       round(avg(energy), 6) AS avg_energy, round(avg(valence), 6) AS avg_valence,
       round(avg(explicit) * 100, 6) AS explicit_pct, round(avg(tempo), 6) AS avg_tempo FROM feat
""")
def q_analytics_kpis(spark, sf_dir):
    return _explore().analytics_kpis(feature_table(spark, sf_dir))


@query("popularity_by_category", """
SELECT c.popularity_category, c.ord, round(m.avg_p, 6) AS avg_popularity
FROM (VALUES ('Hit', 1), ('Mainstream', 2), ('Emerging', 3), ('Underground', 4)) c(popularity_category, ord)
LEFT JOIN (SELECT popularity_category, avg(popularity) AS avg_p FROM feat GROUP BY popularity_category) m
  ON c.popularity_category = m.popularity_category
""")
def q_popularity_by_category(spark, sf_dir):
    return _explore().popularity_by_category(feature_table(spark, sf_dir))


@query("count_by_decade", "SELECT decade, count(*) AS n FROM feat WHERE decade <> '0s' GROUP BY decade")
def q_count_by_decade(spark, sf_dir):
    return _explore().count_by_decade(dashboard_table(spark, sf_dir))


RADAR = list(schema.RADAR_FEATURES)


@query("audio_profile", f"""
SELECT popularity_category, {', '.join(f'round(avg({f}), 6) AS avg_{f}' for f in RADAR)},
       {CATEGORY_ORD_SQL} AS ord
FROM feat WHERE popularity_category IN ('Hit', 'Mainstream', 'Emerging', 'Underground')
GROUP BY popularity_category
""")
def q_audio_profile(spark, sf_dir):
    return _explore().audio_profile(feature_table(spark, sf_dir))


@query("feature_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, cast(round_even(avg({c}), 3) AS DOUBLE) AS mean, "
    f"cast(round_even(stddev_samp({c}), 3) AS DOUBLE) AS std, "
    f"cast(round_even(cast(min({c}) AS DOUBLE), 3) AS DOUBLE) AS min, "
    f"cast(round_even(cast(max({c}) AS DOUBLE), 3) AS DOUBLE) AS max FROM feat" for c in AUDIO))
def q_feature_stats(spark, sf_dir):
    return _explore().feature_stats(feature_table(spark, sf_dir))


CORR_COLS = list(schema.CORR_COLUMNS)


def corr_matrix_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:]]
    aggs = ", ".join(f"{corr_sql(f'cast({a} AS DOUBLE)', f'cast({b} AS DOUBLE)')} AS c{i}"
                     for i, (a, b) in enumerate(pairs))
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, c{i} AS v FROM w")
        if a != b:
            cells.append(f"SELECT '{b}', '{a}', c{i} FROM w")
    return (f", w AS (SELECT {aggs} FROM feat) "
            f"SELECT row_feature, col_feature, round(v, 4) AS corr, cast(round_even(v, 2) AS DOUBLE) AS label "
            f"FROM ({' UNION ALL '.join(cells)})")


@query("corr_matrix", corr_matrix_sql())
def q_corr_matrix(spark, sf_dir):
    return _explore().corr_matrix(feature_table(spark, sf_dir))


# columns with missing values: energy of explicit tracks, valence of unpopular ones
GAPS_SQL = ("(SELECT * REPLACE (CASE WHEN explicit = 1 THEN NULL ELSE energy END AS energy, "
            "CASE WHEN popularity < 20 THEN NULL ELSE valence END AS valence) FROM feat)")


@query("corr_matrix_gaps", corr_matrix_sql().replace("FROM feat)", f"FROM {GAPS_SQL})", 1))
def q_corr_matrix_gaps(spark, sf_dir):
    gaps = (feature_table(spark, sf_dir)
            .withColumn("energy", F.when(F.col("explicit") != 1, F.col("energy")))
            .withColumn("valence", F.when(F.col("popularity") >= 20, F.col("valence"))))
    return _explore().corr_matrix(gaps)


@query("corr_target_sorted", corr_matrix_sql().replace(
    "SELECT row_feature, col_feature, round(v, 4) AS corr, cast(round_even(v, 2) AS DOUBLE) AS label FROM (",
    "SELECT row_feature AS feature, round(v, 4) AS corr, CASE WHEN round(v, 4) < 0 THEN 'negative' "
    "ELSE 'positive' END AS sign FROM (") + " WHERE col_feature = 'popularity' AND row_feature <> 'popularity'")
def q_corr_target_sorted(spark, sf_dir):
    ex = _explore()
    return ex.corr_target_sorted(ex.corr_matrix(feature_table(spark, sf_dir)))


@query("histogram_audio", hist_sql("feat", AUDIO, 35))
def q_histogram_audio(spark, sf_dir):
    return _explore().histogram_audio(feature_table(spark, sf_dir), 35)


# ---------------------------------------------------------------------------
# explorer (X1-X10, S9)
# ---------------------------------------------------------------------------

@query("search_tracks", f"""
SELECT id, name, artist_name, popularity FROM feat
WHERE coalesce(regexp_matches(name, '(?i){SEARCH_TEXT}'), false)
   OR coalesce(regexp_matches(artist_name, '(?i){SEARCH_TEXT}'), false)
""")
def q_search_tracks(spark, sf_dir):
    return _explore().search(feature_table(spark, sf_dir), SEARCH_TEXT).select(
        "id", "name", "artist_name", "popularity")


@query("explorer_view", EXPLORER_SQL)
def q_explorer_view(spark, sf_dir):
    return _explore().explorer_view(feature_table(spark, sf_dir))


def _explorer_sorted(column):
    def fn(spark, sf_dir):
        return _explore().explorer_view(feature_table(spark, sf_dir), sort_col=column)
    return fn


for _column in schema.EXPLORER_SORT_CHOICES:
    query(f"explorer_by_{_column}", f"SELECT {', '.join(EXPLORER_COLS)} FROM {EXPLORER_SRC} ORDER BY {_column} DESC NULLS LAST, "
          + ", ".join(f"{c} ASC NULLS LAST" for c in EXPLORER_COLS) + " LIMIT 500")(_explorer_sorted(_column))


@query("explorer_page", f"""
SELECT * FROM (SELECT *, cast(row_number() OVER (ORDER BY {EXPLORER_ORDER}) AS INTEGER) AS row
               FROM ({EXPLORER_SQL})) WHERE row > 40 AND row <= 60
""")
def q_explorer_page(spark, sf_dir):
    ex = _explore()
    return ex.explorer_page(ex.explorer_view(feature_table(spark, sf_dir)), page=2, size=20)


SAMPLE_ORDER = "md5(concat_ws('|', id, '42')), id"


@query("sample_exact", f"SELECT id, popularity FROM feat ORDER BY {SAMPLE_ORDER} LIMIT 5000")
def q_sample_exact(spark, sf_dir):
    from cadenza.operators.sampling import sample_exact
    return sample_exact(feature_table(spark, sf_dir), 5000, "id").select("id", "popularity")


def scatter_sql(x, y, colour, n):
    return f"SELECT {x} AS x, {y} AS y, {colour} AS colour FROM feat WHERE {x} IS NOT NULL AND {y} IS NOT NULL ORDER BY {SAMPLE_ORDER} LIMIT {n}"


@query("scatter_sample", f"""
SELECT danceability, energy, popularity_category FROM feat ORDER BY {SAMPLE_ORDER} LIMIT 5000
""")
def q_scatter_sample(spark, sf_dir):
    from cadenza.operators.sampling import sample_exact
    return sample_exact(feature_table(spark, sf_dir), 5000, "id").select(
        "danceability", "energy", "popularity_category")


@query("scatter_loudness_popularity", scatter_sql("loudness", "popularity", "energy_category", 5000))
def q_scatter_loudness(spark, sf_dir):
    from cadenza.operators.explore import scatter
    return scatter(feature_table(spark, sf_dir), "loudness", "popularity", "energy_category", 5000)


@query("scatter_tempo_valence", scatter_sql("tempo", "valence", "popularity_category", 20000))
def q_scatter_tempo(spark, sf_dir):
    from cadenza.operators.explore import scatter
    return scatter(feature_table(spark, sf_dir), "tempo", "valence", "popularity_category", 20000)


SNAPSHOT_COLS = list(schema.SNAPSHOT_COLUMNS)
SNAPSHOT_SELECT = f"SELECT {', '.join(c if c != 'followers_log' else 'round(followers_log, 6) AS followers_log' for c in SNAPSHOT_COLS)} "
SNAPSHOT_SQL = SNAPSHOT_SELECT + "FROM feat"


def _snapshot(spark, sf_dir):
    from cadenza.plans.dashboard import snapshot
    return snapshot(feature_table(spark, sf_dir))


@query("dashboard_snapshot", SNAPSHOT_SQL)
def q_dashboard_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir).withColumn("followers_log", r6("followers_log"))


@query("snapshot_sample", SNAPSHOT_SELECT + f"FROM (SELECT * FROM feat ORDER BY {SAMPLE_ORDER} LIMIT {schema.SNAPSHOT_CAP})")
def q_snapshot_sample(spark, sf_dir):
    from cadenza.plans.dashboard import snapshot_sample
    return snapshot_sample(feature_table(spark, sf_dir)).withColumn("followers_log", r6("followers_log"))


@query("snapshot_roundtrip", SNAPSHOT_SQL)
def q_snapshot_roundtrip(spark, sf_dir):
    from cadenza.session import scratch_path
    from cadenza.sources import parquet
    path = scratch_path(spark, "snapshot")
    parquet.write_snapshot(_snapshot(spark, sf_dir), path)
    return parquet.read_snapshot(spark, path, with_decade=False).withColumn(
        "followers_log", r6("followers_log"))


@query("scan_parquet", f"SELECT {RAW_COLS} FROM m_tracks")
def q_scan_parquet(spark, sf_dir):
    return clean.normalise_nan(tables.music_tracks(spark, sf_dir, with_order=False))


@query("export_csv", EXPLORER_SQL)
def q_export_csv(spark, sf_dir):
    from cadenza.session import scratch_path
    from cadenza.sources import csv
    view = _explore().explorer_view(feature_table(spark, sf_dir))
    path = scratch_path(spark, "export")
    csv.export_csv(view, path)
    return csv.read_export(spark, path, view.schema)


# ---------------------------------------------------------------------------
# feature selection
# ---------------------------------------------------------------------------

CANDIDATES = list(schema.SELECTION_CANDIDATES)
LOG_CANDIDATES = [c for c in CANDIDATES if c.endswith("_log") and c[:-4] in AUDIO]

# feature rows with every possible log column; rows of absent log columns are
# dropped by the skewness condition below
FEAT_LOGS = ("(SELECT *, ln(1 + instrumentalness) AS instrumentalness_log, ln(1 + speechiness) AS speechiness_log, "
             "ln(1 + liveness) AS liveness_log FROM feat)")
SKEW_CTE = f", sk AS ({SKEW_SQL})\n"
PRESENT = ("(feature NOT IN ('instrumentalness_log', 'speechiness_log', 'liveness_log') "
           "OR feature IN (SELECT feature || '_log' FROM sk WHERE skewness > 1))")
CORR_ROWS = (f"SELECT feature, round(corr, 6) AS corr FROM ("
             + " UNION ALL ".join(f"SELECT '{c}' AS feature, {corr_sql(f'cast({c} AS DOUBLE)', 'popularity')} AS corr FROM {FEAT_LOGS}"
                                  for c in CANDIDATES)
             + f") WHERE {PRESENT}")


def mi_sql(bins: int = 10) -> str:
    comp = f"(SELECT * FROM {FEAT_LOGS} WHERE " + " AND ".join(
        f"{c} IS NOT NULL" for c in CANDIDATES + ["popularity"]) + ")"
    stats = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in CANDIDATES + ["popularity"])
    binned = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {bin_sql(f'cast(c.{c} AS DOUBLE)', f'cast(st.{c}_lo AS DOUBLE)', f'cast(st.{c}_hi AS DOUBLE)', bins)} AS bx, "
        f"{bin_sql('cast(c.popularity AS DOUBLE)', 'cast(st.popularity_lo AS DOUBLE)', 'cast(st.popularity_hi AS DOUBLE)', bins)} AS yb "
        f"FROM {comp} c, (SELECT {stats} FROM {comp}) st" for c in CANDIDATES)
    return f"""SELECT feature, round(sum((cast(nxy AS DOUBLE) / n) * ln((cast(nxy AS DOUBLE) * n) / (cast(nx AS DOUBLE) * ny))), 6) AS mi
FROM (SELECT feature, nxy, sum(nxy) OVER (PARTITION BY feature) AS n,
             sum(nxy) OVER (PARTITION BY feature, bx) AS nx, sum(nxy) OVER (PARTITION BY feature, yb) AS ny
      FROM (SELECT feature, bx, yb, count(*) AS nxy FROM ({binned}) GROUP BY feature, bx, yb))
WHERE {PRESENT}
GROUP BY feature"""


def top15(rows: str, value: str) -> str:
    return f"SELECT * FROM ({rows}) ORDER BY abs({value}) DESC NULLS LAST, feature LIMIT 15"


def _select():
    from cadenza.operators import select
    return select


@query("corr_with_target", SKEW_CTE + CORR_ROWS)
def q_corr_with_target(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    return s.corr_with_target(df, s.candidates(df))


@query("topk_abs_corr", SKEW_CTE + top15(CORR_ROWS, "corr"))
def q_topk_abs_corr(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    return s.top_k_abs(s.corr_with_target(df, s.candidates(df)), "corr")


@query("mutual_info_binned", SKEW_CTE + mi_sql())
def q_mutual_info_binned(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    return s.mutual_info_binned(df, s.candidates(df))


def mi_quantile_sql(bins: int = 10) -> str:
    cols = CANDIDATES + ["popularity"]
    comp = f"(SELECT * FROM {FEAT_LOGS} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"
    values = f"(SELECT row_number() OVER () AS r, {', '.join(f'cast({c} AS DOUBLE) AS {c}' for c in cols)} FROM {comp})"
    return f""", qv AS MATERIALIZED (SELECT * FROM {values}),
ql AS MATERIALIZED (SELECT r, feature, x FROM (UNPIVOT qv ON {', '.join(cols)} INTO NAME feature VALUE x)),
qr AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS place,
              count(*) OVER (PARTITION BY feature) AS n FROM ql),
qe AS (SELECT feature, list(DISTINCT x) AS edges FROM qr, range(1, {bins}) AS p(i)
       WHERE place = (n * i + {bins} - 1) // {bins} GROUP BY feature),
qb AS (SELECT r, feature, 1 + len([e FOR e IN edges IF ql.x > e]) AS b FROM ql JOIN qe USING (feature)),
qj AS (SELECT a.feature, a.b AS bx, y.b AS yb, count(*) AS nxy FROM qb a JOIN qb y ON a.r = y.r
       WHERE a.feature <> 'popularity' AND y.feature = 'popularity' GROUP BY a.feature, a.b, y.b)
SELECT feature, round(sum((cast(nxy AS DOUBLE) / n) * ln((cast(nxy AS DOUBLE) * n) / (cast(nx AS DOUBLE) * ny))), 6) AS mi
FROM (SELECT feature, nxy, sum(nxy) OVER (PARTITION BY feature) AS n,
             sum(nxy) OVER (PARTITION BY feature, bx) AS nx, sum(nxy) OVER (PARTITION BY feature, yb) AS ny FROM qj)
WHERE {PRESENT}
GROUP BY feature"""


@query("select_features", SKEW_CTE + f"""
SELECT DISTINCT feature FROM (
  SELECT feature FROM ({top15(CORR_ROWS, 'corr')})
  UNION ALL SELECT feature FROM ({top15(mi_sql(), 'mi')}))
""")
def q_select_features(spark, sf_dir):
    return _select().select_features(feature_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# metrics and rankings over predictions
# ---------------------------------------------------------------------------

def _metrics():
    from cadenza.operators import metrics
    return metrics


def _cat_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 70 THEN 'Hit' WHEN {x} >= 40 THEN 'Mainstream' "
            f"WHEN {x} >= 10 THEN 'Emerging' ELSE 'Underground' END")


CLS_CTES = f""", cp AS (SELECT model, ordinal, {_cat_sql('actual')} AS actual, {_cat_sql('predicted')} AS predicted FROM preds),
cmx AS (SELECT model, ordinal, actual, predicted, count(*) AS n FROM cp GROUP BY model, ordinal, actual, predicted),
reg AS (
  SELECT 'regression' AS task, model, ordinal, metric, round(value, 4) AS value FROM (
    SELECT model, ordinal, avg(abs(actual - predicted)) AS MAE,
           avg((actual - predicted) * (actual - predicted)) AS MSE,
           sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE,
           1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS R2
    FROM preds GROUP BY model, ordinal) UNPIVOT (value FOR metric IN (MAE, MSE, RMSE, R2))
),
per AS (
  SELECT coalesce(s.model, p.model) AS model, coalesce(s.ordinal, p.ordinal) AS ordinal,
         coalesce(s.cls, p.cls) AS cls, coalesce(s.support, 0) AS support, coalesce(p.pred, 0) AS pred
  FROM (SELECT model, ordinal, actual AS cls, sum(n) AS support FROM cmx GROUP BY model, ordinal, actual) s
  FULL JOIN (SELECT model, ordinal, predicted AS cls, sum(n) AS pred FROM cmx GROUP BY model, ordinal, predicted) p
    ON s.model = p.model AND s.ordinal = p.ordinal AND s.cls = p.cls
),
per2 AS (
  SELECT per.*, coalesce(t.tp, 0) AS tp FROM per
  LEFT JOIN (SELECT model, ordinal, actual AS cls, sum(n) AS tp FROM cmx WHERE actual = predicted
             GROUP BY model, ordinal, actual) t
    ON per.model = t.model AND per.ordinal = t.ordinal AND per.cls = t.cls
),
per3 AS (
  SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS p,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM per2
),
clf AS (
  SELECT 'classification' AS task, model, ordinal, metric, round(value, 4) AS value FROM (
    SELECT model, ordinal, sum(tp) / sum(support) AS Accuracy,
           sum(p * support) / sum(support) AS Precision,
           sum(r * support) / sum(support) AS Recall,
           sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * support) / sum(support) AS F1
    FROM per3 GROUP BY model, ordinal) UNPIVOT (value FOR metric IN (Accuracy, Precision, Recall, F1))
),
mt AS (SELECT * FROM reg UNION ALL SELECT * FROM clf),
cls AS (SELECT DISTINCT model, ordinal, actual AS c FROM cmx UNION SELECT DISTINCT model, ordinal, predicted FROM cmx),
cgrid AS (
  SELECT a.model, a.ordinal, a.c AS actual, b.c AS predicted, cast(coalesce(cmx.n, 0) AS BIGINT) AS n
  FROM cls a JOIN cls b ON a.model = b.model AND a.ordinal = b.ordinal
  LEFT JOIN cmx ON cmx.model = a.model AND cmx.ordinal = a.ordinal AND cmx.actual = a.c AND cmx.predicted = b.c
),
board AS (
  SELECT task, model, ordinal, metric, value,
         cast(row_number() OVER (PARTITION BY task ORDER BY value DESC, ordinal) AS INTEGER) AS rank
  FROM mt WHERE (task = 'regression' AND metric = 'R2') OR (task = 'classification' AND metric = 'F1')
),
rwide AS (
  SELECT model, ordinal, max(CASE WHEN metric = 'MAE' THEN value END) AS MAE,
         max(CASE WHEN metric = 'MSE' THEN value END) AS MSE,
         max(CASE WHEN metric = 'RMSE' THEN value END) AS RMSE,
         max(CASE WHEN metric = 'R2' THEN value END) AS R2
  FROM mt WHERE task = 'regression' GROUP BY model, ordinal
)
"""


def _preds(spark, sf_dir):
    return tables.predictions(spark, sf_dir)


def _metric_table(spark, sf_dir):
    m = _metrics()
    p = _preds(spark, sf_dir)
    return m.regression_metrics(p).unionByName(m.classification_metrics(m.with_classes(p)))


@query("regression_metrics", CLS_CTES + "SELECT * FROM reg")
def q_regression_metrics(spark, sf_dir):
    return _metrics().regression_metrics(_preds(spark, sf_dir))


@query("classification_metrics", CLS_CTES + "SELECT * FROM clf")
def q_classification_metrics(spark, sf_dir):
    m = _metrics()
    return m.classification_metrics(m.with_classes(_preds(spark, sf_dir)))


@query("confusion_matrix", CLS_CTES + "SELECT * FROM cgrid")
def q_confusion_matrix(spark, sf_dir):
    m = _metrics()
    return m.confusion_matrix(m.with_classes(_preds(spark, sf_dir)))


@query("confusion_normalised", CLS_CTES + """
SELECT *, round(n / nullif(sum(n) OVER (PARTITION BY model, actual), 0), 6) AS share FROM cgrid
""")
def q_confusion_normalised(spark, sf_dir):
    m = _metrics()
    return m.confusion_normalised(m.confusion_matrix(m.with_classes(_preds(spark, sf_dir))))


@query("leaderboard", CLS_CTES + "SELECT * FROM board")
def q_leaderboard(spark, sf_dir):
    return _metrics().leaderboard(_metric_table(spark, sf_dir))


@query("best_model", CLS_CTES + "SELECT task, model AS best_model, value AS best_value FROM board WHERE rank = 1")
def q_best_model(spark, sf_dir):
    return _metrics().best_model(_metric_table(spark, sf_dir))


@query("metrics_pivot", CLS_CTES + "SELECT * FROM rwide")
def q_metrics_pivot(spark, sf_dir):
    return _metrics().metrics_pivot(_metric_table(spark, sf_dir), "regression")


@query("leaderboard_top3", CLS_CTES + """
SELECT b.model, b.rank, w.ordinal, w.MAE, w.MSE, w.RMSE, w.R2
FROM board b JOIN rwide w ON b.model = w.model
WHERE b.task = 'regression' AND b.rank <= 3
""")
def q_leaderboard_top3(spark, sf_dir):
    return _metrics().top_k_wide(_metric_table(spark, sf_dir), "regression", 3)


IMP_ROWS = f"SELECT feature, abs(corr) AS importance FROM ({CORR_ROWS})"


@query("importance_pct", SKEW_CTE + f"""
SELECT feature, importance, cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
       round(importance / sum(importance) OVER () * 100, 2) AS pct
FROM ({IMP_ROWS})
""")
def q_importance_pct(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    imp = s.corr_with_target(df, s.candidates(df)).select("feature", F.abs("corr").alias("importance"))
    return _metrics().importance_pct(imp)


@query("importance_top20_pct", SKEW_CTE + f"""
SELECT * FROM (
  SELECT feature, importance, rank, round(importance / sum(importance) OVER () * 100, 2) AS pct
  FROM (SELECT feature, importance,
               cast(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
        FROM ({IMP_ROWS})) WHERE rank <= 20)
WHERE rank <= 5
""")
def q_importance_top20_pct(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    imp = s.corr_with_target(df, s.candidates(df)).select("feature", F.abs("corr").alias("importance"))
    return _metrics().importance_pct(imp, top=20).where(F.col("rank") <= 5)


# ---------------------------------------------------------------------------
# insights (I1-I14)
# ---------------------------------------------------------------------------

def _ins():
    from cadenza.operators import insights
    return insights


def binned_mean_sql(src: str, col: str, bins: int = 10) -> str:
    return (f"SELECT {bin_sql(f'cast(s.{col} AS DOUBLE)', 'st.lo', 'st.hi', bins)} AS bin, count(*) AS n, "
            f"round(avg(s.popularity), 6) AS avg_popularity "
            f"FROM {src} s, (SELECT cast(min({col}) AS DOUBLE) AS lo, cast(max({col}) AS DOUBLE) AS hi FROM {src} "
            f"WHERE {col} IS NOT NULL) st WHERE s.{col} IS NOT NULL GROUP BY 1")


@query("insight_recency", """
SELECT feature, corr, cast(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM (SELECT 'track_age' AS feature, round(CASE WHEN isnan(corr(cast(track_age AS DOUBLE), popularity)) THEN NULL ELSE corr(cast(track_age AS DOUBLE), popularity) END, 6) AS corr FROM feat
      UNION ALL SELECT 'is_modern', round(CASE WHEN isnan(corr(cast(is_modern AS DOUBLE), popularity)) THEN NULL ELSE corr(cast(is_modern AS DOUBLE), popularity) END, 6) FROM feat)
""")
def q_insight_recency(spark, sf_dir):
    return _ins().corr_ranked(feature_table(spark, sf_dir), ["track_age", "is_modern"])


ARTIST_F = list(_insights_module().ARTIST_FEATURES)


@query("insight_artist_vs_audio", "SELECT feature_group, round(avg(abs(c)), 6) AS mean_abs_corr, "
       "round(max(abs(c)), 6) AS max_abs_corr FROM (" + " UNION ALL ".join(
           f"SELECT '{'artist' if c in ARTIST_F else 'audio'}' AS feature_group, "
           f"{corr_sql(f'cast({c} AS DOUBLE)', 'popularity')} AS c FROM feat" for c in ARTIST_F + AUDIO)
       + ") GROUP BY feature_group")
def q_insight_artist_vs_audio(spark, sf_dir):
    return _ins().artist_vs_audio(feature_table(spark, sf_dir))


@query("insight_dance_energy", """
SELECT danceability >= 0.5 AS high_dance, energy >= 0.5 AS high_energy, count(*) AS n,
       round(avg(popularity), 6) AS avg_popularity
FROM feat WHERE danceability IS NOT NULL AND energy IS NOT NULL GROUP BY 1, 2
""")
def q_insight_dance_energy(spark, sf_dir):
    return _ins().dance_energy_quadrants(feature_table(spark, sf_dir))


@query("insight_loudness", binned_mean_sql("feat", "loudness"))
def q_insight_loudness(spark, sf_dir):
    return _ins().binned_mean(feature_table(spark, sf_dir), "loudness")


@query("insight_acousticness",
       f"SELECT *, '2010-2020' AS period FROM ({binned_mean_sql('(SELECT * FROM feat WHERE release_year BETWEEN 2010 AND 2020)', 'acousticness')}) "
       f"UNION ALL SELECT *, 'all' FROM ({binned_mean_sql('feat', 'acousticness')})")
def q_insight_acousticness(spark, sf_dir):
    return _ins().acousticness_by_period(feature_table(spark, sf_dir))


@query("insight_explicit", """
SELECT explicit, count(*) AS n, round(avg(popularity), 6) AS avg_popularity
FROM feat WHERE explicit IS NOT NULL GROUP BY explicit
""")
def q_insight_explicit(spark, sf_dir):
    return _ins().mean_by(feature_table(spark, sf_dir), "explicit")


def band_sql(col: str, bands: list) -> str:
    whens = " ".join(f"WHEN {col} >= {lo} THEN '{label}'" for label, lo in reversed(bands) if lo is not None)
    first = bands[0][0]
    ords = " ".join(f"WHEN '{label}' THEN {i + 1}" for i, (label, _) in enumerate(bands))
    return f"""
SELECT band, n, avg_popularity, hit_rate, CASE band {ords} END AS ord FROM (
  SELECT CASE {whens} ELSE '{first}' END AS band, count(*) AS n, round(avg(popularity), 6) AS avg_popularity,
         round(avg(CASE WHEN popularity_category = 'Hit' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
  FROM feat WHERE {col} IS NOT NULL GROUP BY 1)
"""


TEMPO_BANDS = _insights_module().TEMPO_BANDS
DURATION_BANDS = _insights_module().DURATION_BANDS


@query("insight_tempo", band_sql("tempo", TEMPO_BANDS))
def q_insight_tempo(spark, sf_dir):
    ins = _ins()
    return ins.banded(feature_table(spark, sf_dir), "tempo", ins.TEMPO_BANDS)


@query("insight_genre_count", """
SELECT artist_genre_count, count(*) AS n, round(avg(artist_popularity), 6) AS avg_artist_popularity
FROM feat WHERE artist_genre_count IS NOT NULL GROUP BY artist_genre_count
""")
def q_insight_genre_count(spark, sf_dir):
    return _ins().mean_by(feature_table(spark, sf_dir), "artist_genre_count", "artist_popularity")


@query("insight_decades", """
SELECT decade, n, round(m, 6) AS avg_popularity, round(m - lag(m) OVER (ORDER BY decade), 6) AS change
FROM (SELECT decade, count(*) AS n, avg(popularity) AS m FROM feat WHERE decade <> '0s' GROUP BY decade)
""")
def q_insight_decades(spark, sf_dir):
    return _ins().decades_with_change(dashboard_table(spark, sf_dir))


@query("insight_speechiness", """
SELECT speechiness > 0.66 AS above_limit, count(*) AS n,
       round(avg(CASE WHEN popularity_category = 'Hit' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM feat WHERE speechiness IS NOT NULL GROUP BY 1
""")
def q_insight_speechiness(spark, sf_dir):
    return _ins().speechiness_split(feature_table(spark, sf_dir))


@query("insight_liveness", binned_mean_sql("feat", "liveness"))
def q_insight_liveness(spark, sf_dir):
    return _ins().binned_mean(feature_table(spark, sf_dir), "liveness")


@query("insight_valence", f"""
SELECT b.*, c.corr FROM ({binned_mean_sql('feat', 'valence')}) b,
     (SELECT round(CASE WHEN isnan(corr(valence, popularity)) THEN NULL ELSE corr(valence, popularity) END, 6) AS corr FROM feat) c
""")
def q_insight_valence(spark, sf_dir):
    return _ins().valence_profile(feature_table(spark, sf_dir))


@query("insight_duration", band_sql("duration_min", DURATION_BANDS))
def q_insight_duration(spark, sf_dir):
    ins = _ins()
    return ins.banded(feature_table(spark, sf_dir), "duration_min", ins.DURATION_BANDS)


# ---------------------------------------------------------------------------
# learning: frame, labels, split, scaling (M1-M4) -- oracle-checked
# ---------------------------------------------------------------------------

SPLIT_SQL = "(('0x' || substr(md5(concat_ws('|', id, '42')), 1, 12))::BIGINT / 281474976710656.0 < 0.2)"
BASE_CANDIDATES = [c for c in CANDIDATES if c not in LOG_CANDIDATES]
COMPLETE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in BASE_CANDIDATES + ["popularity", "popularity_category"])

def selected_features(spark, sf_dir) -> list[str]:
    """E5 result as a (bounded) list of names, computed once per table set."""
    from cadenza.plans import store

    def build(s, d):
        return {"names": [r["feature"] for r in _select().select_features(feature_table(s, d)).collect()]}
    return store.bundle(spark, sf_dir, "selected", build)["names"]


def _model():
    from cadenza.operators import model
    return model


@query("training_frame", f"SELECT id, popularity, popularity_category FROM feat WHERE {COMPLETE_SQL}")
def q_training_frame(spark, sf_dir):
    feats = selected_features(spark, sf_dir)
    return _model().training_frame(feature_table(spark, sf_dir), feats).select(
        "id", "popularity", "popularity_category")


@query("label_encode", """
SELECT popularity_category, cast(dense_rank() OVER (ORDER BY popularity_category) - 1 AS DOUBLE) AS label
FROM (SELECT DISTINCT popularity_category FROM feat)
""")
def q_label_encode(spark, sf_dir):
    m = _model()
    df = feature_table(spark, sf_dir).select("popularity_category")
    return m.label_indexer().fit(df).transform(df).select("popularity_category", "label").distinct()


@query("train_test_split", f"SELECT {SPLIT_SQL} AS is_test, count(*) AS n FROM feat GROUP BY 1")
def q_train_test_split(spark, sf_dir):
    m = _model()
    return m.with_split(feature_table(spark, sf_dir)).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("train_test_split_exact", f"""
SELECT place <= ceil(0.2 * n) AS is_test, count(*) AS n, min(popularity) AS least, max(popularity) AS most, sum(popularity) AS total
FROM (SELECT popularity, row_number() OVER (ORDER BY {SAMPLE_ORDER}) AS place, count(*) OVER () AS n FROM feat) GROUP BY 1
""")
def q_train_test_split_exact(spark, sf_dir):
    from cadenza.operators.sampling import exact_split
    split = exact_split(feature_table(spark, sf_dir), "id", 0.2)
    return split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("popularity").alias("least"),
                                        F.max("popularity").alias("most"), F.sum("popularity").alias("total"))


@query("standard_scale", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std "
    f"FROM feat WHERE NOT {SPLIT_SQL}" for c in AUDIO))
def q_standard_scale(spark, sf_dir):
    m = _model()
    train = m.with_split(feature_table(spark, sf_dir)).where(~F.col("is_test"))
    stats = m.scaler_stats(train, AUDIO)
    return spark.createDataFrame([(c, float(mu), float(sd)) for c, (mu, sd) in stats.items()],
                                 "feature string, mean double, std double").select(
        "feature", r6("mean").alias("mean"), r6("std").alias("std"))


@query("reg_linear_single", f"""
SELECT round(regr_slope(popularity, danceability), 4) AS slope,
       round(regr_intercept(popularity, danceability), 4) AS intercept
FROM feat WHERE NOT {SPLIT_SQL}
""")
def q_reg_linear_single(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    m = _model()
    train = m.with_split(feature_table(spark, sf_dir)).where(~F.col("is_test"))
    vec = VectorAssembler(inputCols=["danceability"], outputCol="features").transform(train)
    lr = LinearRegression(labelCol="popularity", solver="normal").fit(vec)
    return spark.range(1).select(round_to(F.lit(float(lr.coefficients[0])), 4).alias("slope"),
                                 round_to(F.lit(float(lr.intercept)), 4).alias("intercept"))


# Closed forms of the registered estimators: one feature each, so that the optimum
# of the reproduced objective is a formula of means and (co)variances.
SINGLE = "danceability"
STEP_FEATURE = "track_age"


def _single_fit(spark, sf_dir, kind, name, feature, sizes=None):
    """(training rows with label codes, fitted model) of one registered estimator on one feature."""
    m = _model()
    train, test, classes, stats = m.prepare(feature_table(spark, sf_dir), [feature])
    agg = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("popularity").alias("s")).first()
    ests = m.regressors(agg["n"], agg["s"], sizes=sizes) if kind == "reg" else m.classifiers(agg["n"], sizes=sizes)
    return train, m.fit_one(ests[name], train, stats, [feature]), classes


def _single_sql(slope):
    """``slope`` on the scaled feature; the intercept is the mean of the target."""
    return f"""
, st AS (SELECT covar_pop(popularity, {SINGLE}) / stddev_pop({SINGLE}) AS c, count(*) AS n, avg(popularity) AS m
         FROM feat WHERE NOT {SPLIT_SQL})
SELECT round({slope}, 3) AS slope, round(m, 3) AS intercept FROM st
"""


def _single_query(name):
    def fn(spark, sf_dir):
        lr = _single_fit(spark, sf_dir, "reg", name, SINGLE)[1].stages[-1]
        return spark.range(1).select(round_to(F.lit(float(lr.coefficients[0])), 3).alias("slope"),
                                     round_to(F.lit(float(lr.intercept)), 3).alias("intercept"))
    return fn


for _key, _name, _slope in [
        ("reg_linear_closed", "Linear Regression", "c"),
        ("reg_ridge_closed", "Ridge Regression", "c * n / (n + 1)"),
        ("reg_lasso_closed", "Lasso Regression", "sign(c) * greatest(abs(c) - 0.1, 0)"),
        ("reg_elasticnet_closed", "ElasticNet", "sign(c) * greatest(abs(c) - 0.05, 0) / 1.05")]:
    query(_key, _single_sql(_slope))(_single_query(_name))


@query("reg_tree_stump", f"""
, tr AS (SELECT popularity AS y, cast({STEP_FEATURE} AS DOUBLE) AS x FROM feat WHERE NOT {SPLIT_SQL}),
cuts AS (SELECT DISTINCT x AS cut FROM tr),
gains AS (SELECT cut, sum(y) FILTER (x <= cut) ^ 2 / count(*) FILTER (x <= cut)
                    + sum(y) FILTER (x > cut) ^ 2 / count(*) FILTER (x > cut) AS gain
          FROM tr, cuts WHERE cut < (SELECT max(x) FROM tr) GROUP BY cut),
best AS (SELECT arg_max(cut, gain) AS cut FROM gains)
SELECT round(avg(y), 4) AS predicted, count(*) AS n, min(x) AS least, max(x) AS most
FROM tr, best GROUP BY x <= cut
""")
def q_reg_tree_stump(spark, sf_dir):
    """The registered tree at depth 1: the best of all cuts between neighbouring values."""
    train, model, _ = _single_fit(spark, sf_dir, "reg", "Decision Tree", STEP_FEATURE, _model().Sizes(tree_depth=1))
    return (model.transform(train).groupBy(round_to("prediction", 4).alias("predicted"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min(STEP_FEATURE).alias("least"), F.max(STEP_FEATURE).alias("most")))


@query("clf_tree_stump", f"""
, tr AS (SELECT popularity_category AS y, cast({STEP_FEATURE} AS DOUBLE) AS x FROM feat WHERE NOT {SPLIT_SQL}),
cuts AS (SELECT DISTINCT x AS cut FROM tr),
sides AS (SELECT cut, x <= cut AS low, y, count(*) AS n FROM tr, cuts WHERE cut < (SELECT max(x) FROM tr) GROUP BY ALL),
gains AS (SELECT cut, sum(purity) AS gain FROM (
            SELECT cut, low, sum(n * n) / sum(n) AS purity FROM sides GROUP BY cut, low) GROUP BY cut),
best AS (SELECT arg_max(cut, gain) AS cut FROM gains),
named AS (SELECT low, arg_max(y, n) AS predicted FROM sides WHERE cut = (SELECT cut FROM best) GROUP BY low)
SELECT named.predicted, tr.y AS actual, count(*) AS n
FROM tr, best, named WHERE named.low = (tr.x <= best.cut) GROUP BY 1, 2
""")
def q_clf_tree_stump(spark, sf_dir):
    """The registered tree at depth 1: the cut of least Gini impurity, each side's commonest class."""
    train, model, classes = _single_fit(spark, sf_dir, "clf", "Decision Tree", STEP_FEATURE, _model().Sizes(tree_depth=1))
    names = F.array(*[F.lit(c) for c in classes])
    return (model.transform(train)
                 .groupBy(F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                          F.col("popularity_category").alias("actual"))
                 .agg(F.count(F.lit(1)).alias("n")))


@query("clf_logistic_shares", f"""
, tr AS (SELECT popularity_category AS class FROM feat WHERE NOT {SPLIT_SQL})
SELECT class, round(count(*) / (SELECT count(*) FROM tr), 3) AS mean_probability FROM tr GROUP BY class
""")
def q_clf_logistic_shares(spark, sf_dir):
    """Optimality of the unpenalised intercepts: the mean probability of a class is its share."""
    from pyspark.ml.functions import vector_to_array
    train, model, classes = _single_fit(spark, sf_dir, "clf", "Logistic Regression", SINGLE)
    p = vector_to_array("probability")
    row = model.transform(train).agg(*[F.avg(p[i]).alias(c) for i, c in enumerate(classes)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), round_to(c, 3).alias("mean_probability"))
                                          for c in classes])).alias("r")).select("r.*")


GNB_FEATS = AUDIO


def gnb_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in GNB_FEATS)
    floor = "greatest(" + ", ".join(f"var_pop({c})" for c in GNB_FEATS) + ") * 1e-9"
    ll = " ".join(f"- 0.5 * ln(2 * pi() * (s.v_{c} + e.eps)) - (t.{c} - s.m_{c}) * (t.{c} - s.m_{c}) / (2 * (s.v_{c} + e.eps))"
                  for c in GNB_FEATS)
    return f"""
, gtr AS (SELECT * FROM feat WHERE NOT {SPLIT_SQL}),
gst AS (SELECT popularity_category AS cls, count(*) / (SELECT count(*) FROM gtr) AS prior, {stats}
        FROM gtr GROUP BY popularity_category),
gep AS (SELECT {floor} AS eps FROM gtr),
gsc AS (SELECT t.id, t.popularity_category AS actual, s.cls, ln(s.prior) {ll} AS ll
        FROM (SELECT * FROM feat WHERE {SPLIT_SQL}) t, gst s, gep e)
SELECT actual, predicted, count(*) AS n FROM (
  SELECT id, actual, arg_max(cls, ll) AS predicted FROM gsc GROUP BY id, actual)
GROUP BY actual, predicted
"""


@query("gnb_sql", gnb_sql())
def q_gnb_sql(spark, sf_dir):
    m = _model()
    split = m.with_split(feature_table(spark, sf_dir))
    fitted = m.gaussian_nb_fit(split.where(~F.col("is_test")), GNB_FEATS)
    test = split.where(F.col("is_test"))
    return (m.gaussian_nb_predict(test, fitted)
             .groupBy(F.col("popularity_category").alias("actual"), "predicted")
             .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# learning: models (rows-only checks: tree learners and solvers differ from
# the reproduced library; quality, not values, is compared)
# ---------------------------------------------------------------------------

def _build_prepared(spark, sf_dir):
    """The complete rows with their split and label codes, written once for all learners."""
    from cadenza.session import materialize
    m = _model()
    feats = selected_features(spark, sf_dir)
    train, test, classes, stats = m.prepare(feature_table(spark, sf_dir), feats)
    cores = spark.sparkContext.defaultParallelism
    return {"feats": feats, "train": materialize(train.repartition(cores, "id"), "train"), "test": materialize(test, "test"),
            "classes": classes, "stats": stats}


def _prepared(spark, sf_dir):
    from cadenza.plans import store
    b = store.bundle(spark, sf_dir, "prepared", _build_prepared)
    return _model(), b["feats"], b["train"], b["test"], b["classes"], b["stats"]


def _reg_query(name):
    def fn(spark, sf_dir):
        m, feats, train, test, classes, stats = _prepared(spark, sf_dir)
        t = m.train_regressors(train, test, feats, stats, names=[name])
        return t.metrics
    return fn


def _clf_query(name):
    def fn(spark, sf_dir):
        m, feats, train, test, classes, stats = _prepared(spark, sf_dir)
        t = m.train_classifiers(train, test, feats, stats, classes, names=[name])
        return t.metrics
    return fn


for _key, _name in [("reg_linear", "Linear Regression"), ("reg_ridge", "Ridge Regression"),
                    ("reg_lasso", "Lasso Regression"), ("reg_elasticnet", "ElasticNet"),
                    ("reg_tree", "Decision Tree"), ("reg_forest", "Random Forest"),
                    ("reg_gbt", "Gradient Boosting"), ("reg_gbt_deep", "Gradient Boosting (deep)")]:
    QUERIES[_key] = _reg_query(_name)

for _key, _name in [("clf_logistic", "Logistic Regression"), ("clf_tree", "Decision Tree"),
                    ("clf_forest", "Random Forest"), ("clf_gbt_ovr", "Gradient Boosting"),
                    ("clf_gnb", "Gaussian Naive Bayes"), ("clf_gbt_deep_ovr", "Gradient Boosting (deep)")]:
    QUERIES[_key] = _clf_query(_name)


def _build_tuned(spark, sf_dir):
    """Tune the forest once, save the artifacts to the shared folder, load them."""
    from cadenza.session import scratch_path
    from cadenza.sources import artifacts
    m, feats, train, test, classes, stats = _prepared(spark, sf_dir)
    model, tuned, imp = m.tune_forest(train, test, feats, stats)
    path = scratch_path(spark, "artifacts")
    artifacts.save(path, model, tuned, imp, classes=classes)
    out = artifacts.load(spark, path)
    out["path"] = path
    return out


def _tuned_bundle(spark, sf_dir):
    from cadenza.plans import store
    return store.bundle(spark, sf_dir, "tuned", _build_tuned)


def _build_confusion(spark, sf_dir):
    """The confusion matrix of the best of all classifiers."""
    from cadenza.session import materialize
    m, feats, train, test, classes, stats = _prepared(spark, sf_dir)
    t = m.train_classifiers(train, test, feats, stats, classes)
    predictions = materialize(t.predictions, "predictions")      # the six models read the test rows once
    best = _metrics().best_model(_metrics().classification_metrics(predictions)).first()["best_model"]
    cm = _metrics().confusion_matrix(predictions.where(F.col("model") == best))
    return {"confusion": materialize(cm, "confusion")}


@query("tune_forest")
def q_tune_forest(spark, sf_dir):
    return _tuned_bundle(spark, sf_dir)["metrics"]


@query("tuned_metrics")
def q_tuned_metrics(spark, sf_dir):
    return _tuned_bundle(spark, sf_dir)["metrics"].where(F.col("metric").isin("MAE", "RMSE", "R2", "best_cv_r2"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return _tuned_bundle(spark, sf_dir)["importance"]


@query("confusion_best")
def q_confusion_best(spark, sf_dir):
    from cadenza.plans import store
    return store.bundle(spark, sf_dir, "confusion", _build_confusion)["confusion"]


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Load the saved artifacts and score the held-out rows again."""
    from cadenza.sources import artifacts
    loaded = artifacts.load(spark, _tuned_bundle(spark, sf_dir)["path"])
    preds = _model().regression_predictions(loaded["model"], _prepared(spark, sf_dir)[3], "Tuned Random Forest", 1)
    return _metrics().regression_metrics(preds).withColumn("classes", F.lit(",".join(loaded["classes"])))


@query("metrics_roundtrip", CLS_CTES + "SELECT * FROM mt")
def q_metrics_roundtrip(spark, sf_dir):
    from cadenza.session import scratch_path
    path = scratch_path(spark, "metrics")
    _metric_table(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# scoring (P1-P5)
# ---------------------------------------------------------------------------

SCORE_INPUTS = list(schema.SCORE_DEFAULTS)


@query("score_features", """
SELECT id, danceability, energy, loudness, speechiness, acousticness, instrumentalness, liveness,
       valence, tempo, duration_min, cast(explicit AS DOUBLE) AS explicit, cast(track_age AS DOUBLE) AS track_age,
       artist_popularity, round(followers_log, 6) AS followers_log,
       danceability * energy AS dance_energy_index, valence * energy AS mood_score,
       greatest(0.0::DOUBLE, 1.0 - instrumentalness - speechiness) AS vocal_density,
       greatest(0.0::DOUBLE, least(1.0::DOUBLE, (loudness - (-60.0)) / 60.0)) AS loudness_norm,
       cast(is_modern AS DOUBLE) AS is_modern, cast(is_popular_artist AS DOUBLE) AS is_popular_artist,
       cast(artist_genre_count AS DOUBLE) AS artist_genre_count,
       round(ln(1 + instrumentalness), 6) AS instrumentalness_log,
       round(ln(1 + speechiness), 6) AS speechiness_log, round(ln(1 + liveness), 6) AS liveness_log,
       acousticness * instrumentalness AS acoustic_instrumental
FROM feat
""")
def q_score_features(spark, sf_dir):
    from cadenza.operators.score import request_features
    req = feature_table(spark, sf_dir).select("id", *SCORE_INPUTS)
    out = request_features(req, keep=["id"])
    for c in ["followers_log", "instrumentalness_log", "speechiness_log", "liveness_log"]:
        out = out.withColumn(c, r6(c))
    return out


@query("score_category", """
SELECT key, model, cast(printf('%.2f', greatest(0.0::DOUBLE, least(100.0::DOUBLE, predicted))) AS DOUBLE) AS predicted_score,
       CASE WHEN greatest(0.0, least(100.0, predicted)) >= 70 THEN 'Hit 🔥'
            WHEN greatest(0.0, least(100.0, predicted)) >= 40 THEN 'Mainstream 🎵'
            WHEN greatest(0.0, least(100.0, predicted)) >= 10 THEN 'Emerging 🌱'
            ELSE 'Underground 🎸' END AS predicted_category
FROM preds
""")
def q_score_category(spark, sf_dir):
    from cadenza.functions.numeric import clip, round_score, score_label
    p = _preds(spark, sf_dir)
    s = clip(F.col("predicted"), 0.0, 100.0)
    return p.select("key", "model", round_score(s).alias("predicted_score"),
                    score_label(s).alias("predicted_category"))


def _scoring_model(spark, sf_dir):
    b = _tuned_bundle(spark, sf_dir)
    return b["model"], b["features"], None


@query("score_batch")
def q_score_batch(spark, sf_dir):
    from cadenza.operators.score import score_requests
    model, feats, test = _scoring_model(spark, sf_dir)
    req = feature_table(spark, sf_dir).select("id", *SCORE_INPUTS)
    return score_requests(model, req, feats, keep=["id"])


@query("score_stream")
def q_score_stream(spark, sf_dir):
    from cadenza.session import scratch_path
    from cadenza.streaming.scoring import score_files
    model, feats, test = _scoring_model(spark, sf_dir)
    req = feature_table(spark, sf_dir).select("id", *SCORE_INPUTS)
    src = scratch_path(spark, "requests")
    req.write.mode("overwrite").parquet(src)
    return score_files(spark, model, feats, src, spark.read.parquet(src).schema, keep=["id"])


# ---------------------------------------------------------------------------
# CSV source (S1): the mapped tracks written as headed CSV, scanned back with
# the explicit schema
# ---------------------------------------------------------------------------

@query("scan_csv", f"SELECT {RAW_COLS} FROM m_tracks")
def q_scan_csv(spark, sf_dir):
    """The files' columns stand in reverse order, beside one that isn't in the schema. They are
    compressed (a file is read by one task, so it has at most 1,000,000 rows)."""
    from cadenza.plans import store
    from cadenza.schema import TRACKS_SCHEMA
    from cadenza.session import scratch_path, shuffles_for
    from cadenza.sources.csv import scan_csv

    def write_csv(s, d):
        path = scratch_path(s, "tracks-csv")
        tracks = tables.music_tracks(s, d, with_order=False)
        with shuffles_for(s, fact_rows(s, d)):
            (tracks.select(*reversed(tracks.columns), F.lit("x").alias("note")).write.mode("overwrite")
             .option("header", True).option("escape", '"').option("compression", "gzip")
             .option("maxRecordsPerFile", 1_000_000).csv(path))
        return {"path": path}
    path = store.bundle(spark, sf_dir, "tracks_csv", write_csv)["path"]
    return scan_csv(spark, path, TRACKS_SCHEMA)


# ---------------------------------------------------------------------------
# suggested extras: genre-relative popularity, top-k, mood, artist profile
# ---------------------------------------------------------------------------

def _prof():
    from cadenza.operators import profiles
    return profiles


@query("genre_zscore", """
SELECT f.id, f.primary_genre, f.popularity,
       round(CASE WHEN g.s = 0 OR g.s IS NULL THEN NULL ELSE (f.popularity - g.m) / g.s END, 6) AS genre_z
FROM feat f JOIN (SELECT primary_genre, avg(popularity) AS m, stddev_samp(popularity) AS s
                  FROM feat GROUP BY primary_genre) g ON f.primary_genre = g.primary_genre
""")
def q_genre_zscore(spark, sf_dir):
    return _prof().genre_zscore(feature_table(spark, sf_dir))


@query("top_dance_energy", """
SELECT id, name, artist_name, dance_energy_index FROM feat
ORDER BY dance_energy_index DESC NULLS LAST, id, name, artist_name LIMIT 10
""")
def q_top_dance_energy(spark, sf_dir):
    return _prof().top_k(feature_table(spark, sf_dir), "dance_energy_index", 10)


@query("mood_quadrant", """
SELECT CASE WHEN valence >= 0.5 AND energy >= 0.5 THEN 'Happy-Energetic'
            WHEN valence >= 0.5 THEN 'Calm-Positive'
            WHEN energy >= 0.5 THEN 'Tense-Energetic' ELSE 'Sad-Calm' END AS mood,
       count(*) AS n, round(avg(popularity), 6) AS avg_popularity, round(avg(mood_score), 6) AS avg_mood_score
FROM feat WHERE valence IS NOT NULL AND energy IS NOT NULL GROUP BY 1
""")
def q_mood_quadrant(spark, sf_dir):
    return _prof().mood_profile(feature_table(spark, sf_dir))


@query("artist_vs_genre", " UNION ALL ".join(
    f"SELECT a.artist_name, a.primary_genre, '{c}' AS feature, round(a.m, 6) AS artist_mean, "
    f"round(g.m, 6) AS genre_mean, round(a.m - g.m, 6) AS diff "
    f"FROM (SELECT artist_name, primary_genre, avg({c}) AS m FROM feat GROUP BY artist_name, primary_genre) a "
    f"JOIN (SELECT primary_genre, avg({c}) AS m FROM feat GROUP BY primary_genre) g "
    f"ON a.primary_genre = g.primary_genre" for c in AUDIO))
def q_artist_vs_genre(spark, sf_dir):
    return _prof().artist_vs_genre(feature_table(spark, sf_dir))


@query("mutual_info_quantile", SKEW_CTE + mi_quantile_sql())
def q_mutual_info_quantile(spark, sf_dir):
    s = _select()
    df = feature_table(spark, sf_dir)
    return s.mutual_info_quantile(df, s.candidates(df))
