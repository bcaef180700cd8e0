"""Schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------
CURRENT_YEAR = 2021
YEAR_RANGE = (1920, 2021)

AUDIO_FEATURES = [
    "danceability", "energy", "loudness", "speechiness", "acousticness",
    "instrumentalness", "liveness", "valence", "tempo",
]

SELECTION_CANDIDATES = [
    "danceability", "energy", "loudness", "speechiness", "acousticness",
    "instrumentalness", "liveness", "valence", "tempo", "duration_min",
    "explicit", "track_age", "artist_popularity", "followers_log",
    "dance_energy_index", "mood_score", "vocal_density", "loudness_norm",
    "is_modern", "is_popular_artist", "artist_genre_count",
    "instrumentalness_log", "speechiness_log", "liveness_log",
]
SELECTION_TOP_K = 15

SNAPSHOT_COLUMNS = [
    "name", "artist_name", "popularity", "popularity_category",
    "release_year", "primary_genre", "explicit", "duration_min",
    "danceability", "energy", "loudness", "speechiness", "acousticness",
    "instrumentalness", "liveness", "valence", "tempo",
    "track_age", "artist_popularity", "followers_log",
    "dance_energy_index", "mood_score", "vocal_density", "loudness_norm",
    "is_modern", "is_popular_artist", "artist_genre_count",
]
SNAPSHOT_CAP = 150_000
SEED = 42

EXPLORER_COLUMNS = [
    "name", "artist_name", "popularity", "popularity_category",
    "release_year", "danceability", "energy", "valence",
    "tempo", "duration_min", "explicit", "primary_genre",
]
EXPLORER_SORT_CHOICES = ["popularity", "danceability", "energy",
                         "valence", "tempo", "acousticness"]
EXPLORER_LIMIT = 500
EXPLORER_YEARS = (2000, 2020)
PAGE_SIZE = 20

CATEGORY_ORDER = ["Hit", "Mainstream", "Emerging", "Underground"]
# popularity >= 70 Hit, >= 40 Mainstream, >= 10 Emerging, else Underground
CATEGORY_THRESHOLDS = [(70, "Hit"), (40, "Mainstream"), (10, "Emerging")]
CATEGORY_FALLBACK = "Underground"
# energy bins, right-closed: (0, .33] Low, (.33, .66] Medium, (.66, 1] High
ENERGY_BINS = [(0.0, 0.33, "Low"), (0.33, 0.66, "Medium"), (0.66, 1.0, "High")]
MODERN_YEAR = 2010
POPULAR_ARTIST = 60
SKEW_THRESHOLD = 1.0

CORR_COLUMNS = [
    "popularity", "danceability", "energy", "loudness", "speechiness",
    "acousticness", "instrumentalness", "liveness", "valence", "tempo",
    "duration_min", "explicit", "track_age", "artist_popularity",
]
RADAR_FEATURES = ["danceability", "energy", "valence", "acousticness", "liveness"]
STATS_FEATURES = ["danceability", "energy", "loudness", "speechiness", "acousticness",
                  "instrumentalness", "liveness", "valence", "tempo"]

HIST_BINS_OVERVIEW = 50
HIST_BINS_EXPLORER = 40
HIST_BINS_AUDIO = 35

# scoring request defaults (17 inputs)
SCORE_DEFAULTS = {
    "danceability": 0.7, "energy": 0.8, "loudness": -5.0,
    "speechiness": 0.05, "acousticness": 0.1, "instrumentalness": 0.0,
    "liveness": 0.1, "valence": 0.6, "tempo": 120.0, "duration_min": 3.5,
    "explicit": 0, "track_age": 2, "artist_popularity": 70,
    "followers_log": 12.0, "is_modern": 1, "is_popular_artist": 1,
    "artist_genre_count": 3,
}
SCORE_LOUDNESS_BOUNDS = (-60.0, 0.0)
SCORE_LABELS = {"Hit": "Hit 🔥", "Mainstream": "Mainstream 🎵",
                "Emerging": "Emerging 🌱", "Underground": "Underground 🎸"}

# text that a CSV reader treats as missing
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
                   "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                   "NaN", "None", "n/a", "nan", "null"]

# random search space of the tuned forest
TUNE_GRID = {
    "numTrees": [50, 75, 100],
    "maxDepth": [8, 12, 15],
    "minInstancesPerNode": [1, 2],
    "minRowsToSplit": [2, 5],
}
TUNE_CANDIDATES = 3
TUNE_FOLDS = 2

# ---------------------------------------------------------------------------
# Source schemas (explicit, never inferred)
# ---------------------------------------------------------------------------
TRACKS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("popularity", T.DoubleType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("explicit", T.IntegerType()),
    T.StructField("artists", T.StringType()),
    T.StructField("id_artists", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("danceability", T.DoubleType()),
    T.StructField("energy", T.DoubleType()),
    T.StructField("loudness", T.DoubleType()),
    T.StructField("speechiness", T.DoubleType()),
    T.StructField("acousticness", T.DoubleType()),
    T.StructField("instrumentalness", T.DoubleType()),
    T.StructField("liveness", T.DoubleType()),
    T.StructField("valence", T.DoubleType()),
    T.StructField("tempo", T.DoubleType()),
])

ARTISTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("followers", T.DoubleType()),
    T.StructField("popularity", T.DoubleType()),
    T.StructField("genres", T.StringType()),
])

# where a row stands in the files it was read from: file, start of the split, row
POSITION = ["_file", "_block", "_row"]
