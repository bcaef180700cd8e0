"""Music-shaped views over the driver's star-schema tables.

The catalogue operators work on a ``tracks`` and an ``artists`` table. On the
test data both are mapped from the TPC-H-like tables: line items become
tracks (joined to their order and part), suppliers become artists (joined to
nation and region). The mapping keeps the raw text shapes the cleaning has to
handle: list literals, dates of mixed precision, duplicate ids, unmatched keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# columns after the key that make the keep-first order total on these tables
TRACK_ORDER = ["k_part", "k_supp", "k_price"]
MUSIC_COLUMNS = ["id", "name", "popularity", "duration_ms", "explicit", "artists", "id_artists", "release_date",
                 "danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness",
                 "liveness", "valence", "tempo"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracks under their order and line, without the columns that
    :func:`music_rows` and :func:`music_columns` compute from the others. Orders
    are joined last: where that join shuffles, its rows are left grouped by order.
    AQE turns joins into broadcasts where the dimension is small at run time."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    j = (li.join(p, li.l_partkey == p.p_partkey)
           .join(o, li.l_orderkey == o.o_orderkey))
    key = F.col("l_orderkey")
    date_len = (F.when(key % 3 == 0, 10).when(key % 3 == 1, 7).otherwise(4))
    return j.select(
        key.alias("k_order"), F.col("l_linenumber").alias("k_line"),
        F.col("p_name").alias("name"),
        (F.col("l_quantity") * 2).alias("popularity"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("explicit"),
        F.substring(F.col("o_orderdate").cast("string"), F.lit(1), date_len).alias("release_date"),
        (F.col("l_tax") * 12.5).alias("danceability"),
        (F.col("l_discount") * 10).alias("energy"),
        (F.col("o_totalprice") / 500000).alias("acousticness"),
        (F.col("p_size") / 50).alias("valence"),
        F.col("l_partkey").alias("k_part"), F.col("l_suppkey").alias("k_supp"),
        F.col("l_extendedprice").alias("k_price"))


def with_ids(rows: DataFrame) -> DataFrame:
    """:func:`order_rows` with the columns that are functions of order and line."""
    made = {
        "id": F.concat(F.col("k_order").cast("string"), F.lit("-"), F.col("k_line").cast("string")),
        "instrumentalness": (F.col("k_line") - 1) / 6,
    }
    return rows.select(*[made[c].alias(c) if c in made else F.col(c)
                         for c in ["id", "name", "popularity", "explicit", "release_date", "danceability", "energy",
                                   "acousticness", "instrumentalness", "valence"] + TRACK_ORDER])


def music_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tracks without the columns that :func:`music_columns` computes from
    the others."""
    return with_ids(order_rows(spark, sf_dir))


def music_columns(rows: DataFrame, with_order: bool = False) -> DataFrame:
    """:func:`music_rows` with the columns that are functions of single other ones,
    all of them of the order or before theirs: rows that agree on what is carried
    agree on these, so a keep-first may run on either form."""
    ext, speech = F.col("k_price"), F.col("energy")
    live = (F.col("k_part") % 100) / 99
    made = {
        "duration_ms": ext * 4,
        "artists": F.concat(F.lit("['Supplier#"), F.col("k_supp").cast("string"), F.lit("']")),
        "id_artists": F.concat(F.lit("['"), F.col("k_supp").cast("string"), F.lit("']")),
        "loudness": ext / 2000 - 60,
        "speechiness": speech * speech * speech * speech,
        "liveness": live * live * live * live,
        "tempo": ext / 500,
    }
    return rows.select(*[made[c].alias(c) if c in made else F.col(c)
                         for c in MUSIC_COLUMNS + (TRACK_ORDER if with_order else [])])


def music_tracks(spark: SparkSession, sf_dir: str, with_order: bool = True) -> DataFrame:
    """Raw tracks (before any cleaning)."""
    return music_columns(music_rows(spark, sf_dir), with_order)


def music_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw artists: suppliers above a balance limit, genres as list literals."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (s.where(F.col("s_acctbal") >= 1000)
          .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
          .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("s_suppkey")
    genres = (F.when(k % 7 == 0, F.lit("[]"))
               .when(k % 7 == 1, F.concat(F.lit("['"), F.col("n_name"), F.lit("']")))
               .otherwise(F.concat(F.lit("['"), F.col("n_name"), F.lit("', \""),
                                   F.col("r_name"), F.lit("'s\"]"))))
    return j.select(
        k.cast("string").alias("id"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 100).otherwise(0.0).alias("followers"),
        (k % 101).cast("double").alias("popularity"),
        genres.alias("genres"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictions of three fixed rules against the popularity
    target (no training): input of the metric and ranking operators."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    actual = F.col("l_quantity") * 2
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                   F.col("l_linenumber").cast("string"), F.lit("-"),
                   F.col("l_partkey").cast("string"))
    rules = [
        ("Discount rule", 1, F.lit(40.0) + F.col("l_discount") * 300),
        ("Tax rule", 2, F.lit(20.0) + F.col("l_tax") * 500),
        ("Line rule", 3, F.lit(10.0) + F.col("l_linenumber") * 10),
    ]
    base = li.select(key.alias("key"), actual.alias("actual"),
                     F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"))
    arms = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(o).alias("ordinal"),
                              e.cast("double").alias("predicted")) for n, o, e in rules])
    return (base.select("key", "actual", F.explode(arms).alias("r"))
                .select("key", F.col("r.model").alias("model"), F.col("r.ordinal").alias("ordinal"),
                        "actual", F.col("r.predicted").alias("predicted")))
