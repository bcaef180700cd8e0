"""DuckDB SQL that rebuilds the feature table from the driver's tables.

Every oracle query is ``FEATURE_CTES`` followed by one final SELECT. The CTEs
mirror, step by step, what the Spark operators compute: mapped views, keep-first
dedup, cleaning, the left join, derived features.
"""

M_TRACKS = r"""
m_tracks AS (
  SELECT concat(cast(l_orderkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR)) AS id,
         p_name AS name,
         l_quantity * 2 AS popularity,
         l_extendedprice * 4 AS duration_ms,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS explicit,
         concat('[''Supplier#', cast(l_suppkey AS VARCHAR), ''']') AS artists,
         concat('[''', cast(l_suppkey AS VARCHAR), ''']') AS id_artists,
         substr(cast(o_orderdate AS VARCHAR), 1,
                CASE l_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 4 END) AS release_date,
         l_tax * 12.5 AS danceability,
         l_discount * 10 AS energy,
         l_extendedprice / 2000 - 60 AS loudness,
         (l_discount * 10) * (l_discount * 10) * (l_discount * 10) * (l_discount * 10) AS speechiness,
         o_totalprice / 500000 AS acousticness,
         (l_linenumber - 1) / 6 AS instrumentalness,
         ((l_partkey % 100) / 99) * ((l_partkey % 100) / 99) * ((l_partkey % 100) / 99)
           * ((l_partkey % 100) / 99) AS liveness,
         p_size / 50 AS valence,
         l_extendedprice / 500 AS tempo,
         l_partkey AS k_part, l_suppkey AS k_supp, l_extendedprice AS k_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

M_ARTISTS = r"""
m_artists AS (
  SELECT cast(s_suppkey AS VARCHAR) AS id,
         CASE WHEN s_acctbal > 0 THEN s_acctbal * 100 ELSE 0 END AS followers,
         cast(s_suppkey % 101 AS DOUBLE) AS popularity,
         CASE s_suppkey % 7 WHEN 0 THEN '[]'
              WHEN 1 THEN concat('[''', n_name, ''']')
              ELSE concat('[''', n_name, ''', "', r_name, '''s"]') END AS genres
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal >= 1000
)"""

CLEAN = r"""
t_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY k_part, k_supp, k_price) AS rn
    FROM m_tracks) WHERE rn = 1
),
t_clean AS (
  SELECT id, popularity, duration_ms, danceability, energy, loudness, speechiness, acousticness,
         instrumentalness, liveness, valence, tempo,
         trim(name) AS name,
         cast(explicit AS INTEGER) AS explicit,
         release_date, artists, id_artists,
         cast(coalesce(year(try_strptime(release_date, '%Y-%m-%d')),
                       try_cast(substr(release_date, 1, 4) AS INTEGER), 0) AS INTEGER) AS release_year,
         coalesce(nullif(regexp_extract(artists, '^\[''([^'']*)''', 1), ''), 'Unknown') AS artist_name,
         nullif(regexp_extract(id_artists, '^\[''([^'']*)''', 1), '') AS artist_id_key
  FROM t_first
  WHERE popularity IS NOT NULL AND name IS NOT NULL
),
c_tracks AS (
  SELECT * FROM t_clean
  WHERE tempo > 0 AND duration_ms > 0 AND release_year BETWEEN 1920 AND 2021
),
c_artists AS (
  SELECT *,
         coalesce(nullif(regexp_extract(genres, '^\[''([^'']*)''', 1), ''), 'unknown') AS primary_genre,
         cast(CASE WHEN genres = '[]' THEN 0
                   ELSE length(genres) - length(replace(genres, ',', '')) + 1 END AS INTEGER) AS genre_count
  FROM m_artists
)"""

FEATURES = r"""
joined AS (
  SELECT t.*,
         coalesce(a.followers, 0) AS artist_followers,
         coalesce(a.popularity, 0) AS artist_popularity,
         coalesce(a.primary_genre, 'unknown') AS primary_genre,
         cast(coalesce(a.genre_count, 0) AS INTEGER) AS artist_genre_count
  FROM c_tracks t LEFT JOIN c_artists a ON t.artist_id_key IS NOT DISTINCT FROM a.id
),
base AS (
  SELECT *, duration_ms / 60000 AS duration_min,
         cast(greatest(0, 2021 - release_year) AS INTEGER) AS track_age
  FROM joined
),
lstats AS (SELECT min(loudness) AS lmin, max(loudness) AS lmax FROM base),
feat AS (
  SELECT b.*,
         b.loudness - s.lmin AS loudness_shifted,
         CASE WHEN popularity >= 70 THEN 'Hit' WHEN popularity >= 40 THEN 'Mainstream'
              WHEN popularity >= 10 THEN 'Emerging' ELSE 'Underground' END AS popularity_category,
         CASE WHEN energy > 0 AND energy <= 0.33 THEN 'Low'
              WHEN energy > 0.33 AND energy <= 0.66 THEN 'Medium'
              WHEN energy > 0.66 AND energy <= 1.0 THEN 'High' END AS energy_category,
         danceability * energy AS dance_energy_index,
         acousticness * instrumentalness AS acoustic_instrumental,
         valence * energy AS mood_score,
         CASE WHEN instrumentalness IS NULL OR speechiness IS NULL THEN NULL
              ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - instrumentalness - speechiness)) END AS vocal_density,
         ln(1 + artist_followers) AS followers_log,
         CASE WHEN release_year >= 2010 THEN 1 ELSE 0 END AS is_modern,
         CASE WHEN artist_popularity >= 60 THEN 1 ELSE 0 END AS is_popular_artist,
         (b.loudness - s.lmin) / nullif(s.lmax - s.lmin, 0) AS loudness_norm,
         cast(release_year // 10 * 10 AS VARCHAR) || 's' AS decade
  FROM base b CROSS JOIN lstats s
)"""

PREDICTIONS = r"""
p_base AS (
  SELECT concat(cast(l_orderkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR), '-',
                cast(l_partkey AS VARCHAR)) AS key,
         l_quantity * 2 AS actual, l_discount, l_tax, l_linenumber
  FROM lineitem
),
preds AS (
  SELECT key, 'Discount rule' AS model, 1 AS ordinal, actual,
         cast(40.0 + l_discount * 300 AS DOUBLE) AS predicted FROM p_base
  UNION ALL
  SELECT key, 'Tax rule', 2, actual, cast(20.0 + l_tax * 500 AS DOUBLE) FROM p_base
  UNION ALL
  SELECT key, 'Line rule', 3, actual, cast(10.0 + l_linenumber * 10 AS DOUBLE) FROM p_base
)"""

FEATURE_CTES = "WITH " + ",".join([M_TRACKS, M_ARTISTS, CLEAN, FEATURES, PREDICTIONS]) + "\n"


def with_features(select_sql: str) -> str:
    """Full oracle text: the feature CTEs, then ``select_sql``."""
    return FEATURE_CTES + select_sql
