"""Cleaning and the dimension join: keep-first, missing values, ranges."""

from pyspark.sql import functions as F

from cadenza.operators import clean, features, join


TRACK_COLS = ("id string, name string, popularity double, duration_ms double, explicit int, artists string, "
              "id_artists string, release_date string, danceability double, energy double, loudness double, "
              "speechiness double, acousticness double, instrumentalness double, liveness double, "
              "valence double, tempo double, ord int")


def track(i, id_, **kw):
    base = dict(id=id_, name=f"song {i}", popularity=50.0, duration_ms=200000.0, explicit=0,
                artists="['Uli']", id_artists="['a1']", release_date="2001-05-01", danceability=0.5,
                energy=0.5, loudness=-10.0, speechiness=0.1, acousticness=0.2, instrumentalness=0.0,
                liveness=0.1, valence=0.5, tempo=120.0, ord=i)
    base.update(kw)
    return tuple(base[c.split()[0]] for c in TRACK_COLS.split(", "))


def test_dedup_keep_first_by_order(spark):
    rows = [track(2, "x", popularity=10.0), track(1, "x", popularity=90.0), track(3, "y"), track(4, None),
            track(5, None, popularity=1.0)]
    df = spark.createDataFrame(rows, TRACK_COLS)
    out = clean.dedup_keep_first(df, "id", ["ord"])
    got = {r["id"]: (r["popularity"], r["ord"]) for r in out.collect()}
    assert got == {"x": (90.0, 1), "y": (50.0, 3), None: (50.0, 4)}
    # idempotent
    again = clean.dedup_keep_first(out, "id", ["ord"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_dedup_hot_key_is_combined_map_side(spark):
    """A key holding a third of the rows is reduced before the shuffle."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                  F.col("id").alias("v")).repartition(6)
    out = clean.dedup_keep_first(df, "k", ["v"])
    assert out.where("k = 'hot'").first()["v"] == 0
    assert out.count() == 2001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_clean_tracks_filters(spark):
    rows = [
        track(1, "a"),
        track(2, "b", popularity=None),
        track(3, "c", name=None),
        track(4, "d", tempo=0.0),
        track(5, "e", tempo=float("nan")),
        track(6, "f", release_date="1919"),
        track(7, "g", release_date="1920"),
        track(8, "h", release_date="2021-12"),
        track(9, "i", release_date="2022"),
        track(10, "j", release_date="5/1/2001"),
        track(11, "k", name="  spaced\t", artists="  ", duration_ms=-1.0),
        track(12, "l", name="  spaced\t", artists="['  Bo ']"),
    ]
    df = clean.normalise_nan(spark.createDataFrame(rows, TRACK_COLS))
    out = clean.clean_tracks(df, order_by=["ord"])
    got = {r["id"]: r for r in out.collect()}
    assert sorted(got) == ["a", "g", "h", "l"]
    assert got["g"]["release_year"] == 1920 and got["h"]["release_year"] == 2021
    assert got["l"]["name"] == "spaced" and got["l"]["artist_name"] == "Bo"
    assert got["a"]["artist_id_key"] == "a1"


def test_clean_artists_genres(spark):
    df = spark.createDataFrame([("1", 10.0, 50.0, "['pop', 'rock']"), ("2", 5.0, 20.0, "[]"),
                                ("2", 7.0, 30.0, "['late']"), ("3", None, None, "junk")],
                               "id string, followers double, popularity double, genres string")
    out = {r["id"]: r for r in clean.clean_artists(df).collect()}
    assert out["1"]["primary_genre"] == "pop" and out["1"]["genre_count"] == 2
    assert out["2"]["genre_count"] == 0 and out["2"]["primary_genre"] == "unknown"
    assert out["3"]["genre_count"] == 0


def test_join_null_safe_and_fill(spark):
    tracks = spark.createDataFrame([("t1", "a1"), ("t2", "zz"), ("t3", None)], "id string, artist_id_key string")
    artists = spark.createDataFrame([("a1", 100.0, 70.0, "pop", 2), (None, 5.0, 10.0, "nullgenre", 1)],
                                    "id string, followers double, popularity double, primary_genre string, genre_count int")
    safe = {r["id"]: r for r in join.join_artists(tracks, artists).collect()}
    assert safe["t1"]["artist_followers"] == 100.0 and safe["t1"]["primary_genre"] == "pop"
    assert safe["t2"]["artist_followers"] == 0.0 and safe["t2"]["primary_genre"] == "unknown"
    assert safe["t2"]["artist_genre_count"] == 0
    assert safe["t3"]["primary_genre"] == "nullgenre"  # missing matches missing
    sql = {r["id"]: r for r in join.join_artists(tracks, artists, null_safe=False).collect()}
    assert sql["t3"]["primary_genre"] == "unknown"
    assert join.join_artists(tracks, artists).count() == tracks.count()


def test_feature_statistics(spark):
    df = spark.createDataFrame([(float(i), -5.0, 10.0 ** i, -1.0) for i in range(5)],
                               "release_year double, loudness double, speechiness double, liveness double")
    df = df.withColumn("release_year", F.col("release_year").cast("int") + 2000)
    stats = features.table_stats(df, "loudness", ["speechiness", "liveness"])
    assert stats["min"] == -5.0 and stats["max"] == -5.0
    normed = features.minmax(df, "loudness", stats["min"], stats["max"])
    assert all(r["loudness_norm"] is None for r in normed.collect())
    logged = features.log_skewed(df, stats["skew"], 1.0)
    assert "speechiness_log" in logged.columns and "liveness_log" not in logged.columns
    lim = spark.createDataFrame([(-1.0,), (-5.0,)], "x double").select(F.log1p("x")).collect()
    assert [r[0] for r in lim] == [None, None]


def test_join_missing_keys_salted(spark):
    fact = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("a1")).alias("artist_id_key"))
    artists = spark.createDataFrame([("a1", 100.0, 70.0, "pop", 2), (None, 5.0, 10.0, "nullgenre", 1)],
                                    "id string, followers double, popularity double, primary_genre string, genre_count int")
    out = join.join_artists(fact, artists)
    assert out.count() == 3000
    assert out.where("artist_id_key IS NULL AND primary_genre = 'nullgenre'").count() == 1000
    assert out.where("artist_id_key = 'a1' AND primary_genre = 'pop'").count() == 2000
    sql = join.join_artists(fact, artists, null_safe=False)
    assert sql.where("artist_id_key IS NULL AND primary_genre = 'unknown'").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan.split("Exchange")[0] or "_salt" in plan


def test_join_hot_key_salted(spark):
    fact = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("artist_id_key"))
    artists = spark.createDataFrame([("hot", 1.0, 90.0, "pop", 1)] + [(str(i), 2.0, 10.0, "rock", 2) for i in range(50)],
                                    "id string, followers double, popularity double, primary_genre string, genre_count int")
    assert join.hot_keys(fact, "artist_id_key", fraction=0.05) == ["hot"]
    out = join.join_dimension(fact, join.slim_dimension(artists), "artist_id_key", join.ARTIST_FILL,
                              hot_fraction=0.05)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 3000
    assert out.where("artist_id_key = 'hot' AND primary_genre = 'pop'").count() == 1000
    assert out.where("artist_id_key <> 'hot' AND primary_genre = 'rock'").count() == 2000
    no_detect = join.join_dimension(fact, join.slim_dimension(artists), "artist_id_key", hot_fraction=None)
    assert no_detect.where("primary_genre = 'pop'").count() == 1000


def test_write_fact_finds_hot_keys_and_dimension_is_read_once(spark, tmp_dir):
    fact = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None).cast("string"))
         .otherwise(F.col("id").cast("string")).alias("artist_id_key"))
    written, hot = join.write_fact(fact, "fact", "artist_id_key")
    assert hot == ["hot"] and written.count() == 3000
    assert join.write_fact(fact.limit(0), "fact", "artist_id_key")[1] == []
    spark.createDataFrame([("hot", 1.0, 90.0, "pop", 1), (None, 2.0, 5.0, "none", 1)],
                          "id string, followers double, popularity double, primary_genre string, genre_count int") \
         .write.parquet(f"{tmp_dir}/artists")
    artists = spark.read.parquet(f"{tmp_dir}/artists")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join.join_artists(written, artists, hot=hot)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2 and "_salt" in plan and "Union" not in plan
        assert {r["primary_genre"]: r["count"] for r in out.groupBy("primary_genre").count().collect()} == \
            {"pop": 1000, "none": 1000, "unknown": 1000}
        # the hot key's rows are dealt over many partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spread = out.where("artist_id_key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_genre_zscore_without_a_small_group_table(spark):
    from cadenza.operators.profiles import genre_zscore
    df = spark.range(900).select(
        F.col("id"), (F.col("id") % 17).cast("double").alias("popularity"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 101 == 1, F.lit(None).cast("string"))
         .otherwise((F.col("id") % 40).cast("string")).alias("primary_genre"))
    small, salted = genre_zscore(df), genre_zscore(df, broadcast_rows=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "hot" in plan and "strategy=broadcast" not in plan
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))
    assert small.where("primary_genre IS NULL").count() == 0


def _music(spark, folder):
    """Tables with repeated and missing keys, and ties in all of the order's columns."""
    at = "timestamp'2001-02-03'"
    li = [(1, 7, 3, 1, 5.0, 900.0, 0.05, 0.02, "R"), (1, 7, 3, 1, 5.0, 900.0, 0.01, 0.02, "N"), (1, 7, 3, 1, 4.0, 900.0, 0.09, 0.02, "N"),
          (1, 8, 2, 2, 9.0, 800.0, 0.05, 0.02, "R"), (1, 7, 9, 2, 1.0, 100.0, 0.05, 0.02, "R"), (2, 7, 3, None, 5.0, 700.0, 0.05, 0.0, "A"),
          (3, 8, None, None, 6.0, None, None, 0.0, None), (None, 7, 3, 1, 5.0, 1.0, 0.0, 0.0, "R"), (2, 99, 3, 1, 5.0, 1.0, 0.0, 0.0, "R")]
    frames = {
        "lineitem": spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                                              "l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
        "orders": spark.sql(f"select k o_orderkey, {at} + make_dt_interval(d) o_orderdate, cast(d * 10 as double) o_totalprice "
                            "from values (1L, 1), (1L, 40), (2L, 2), (3L, 3) t(k, d)"),
        "part": spark.sql("select k p_partkey, n p_name, s p_size from values (7L, 'b', 5), (7L, 'a', 9), (8L, 'c', 1) t(k, n, s)")}
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_dedup_of_narrow_rows_picks_the_same_rows(spark, tmp_dir):
    from cadenza.sources import tables
    d = _music(spark, tmp_dir)
    wide = clean.dedup_keep_first(tables.music_tracks(spark, d), "id", tables.TRACK_ORDER, drop_order=True)
    narrow = clean.first_rows(tables.music_rows(spark, d), "id", tables.TRACK_ORDER, tables.music_columns)
    assert narrow.columns == wide.columns == tables.MUSIC_COLUMNS
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect())) and wide.count() == 3
    # what the shuffle carries doesn't hold the computed columns
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert "Supplier#" in plan and "Supplier#" not in below


def test_written_dimension_is_broadcast_if_counted_small(spark):
    artists = spark.createDataFrame([("a", 1.0, 2.0, "g", 1), (None, 3.0, 4.0, "h", 2)],
                                    "id string, followers double, popularity double, primary_genre string, genre_count int")
    tracks = spark.range(50).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "z").alias("artist_id_key"))
    tracks = tracks.groupBy("id").agg(F.max("artist_id_key").alias("artist_id_key"))
    want = sorted(map(str, join.join_artists(tracks, artists).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        small, large = join.join_written(tracks, artists), join.join_written(tracks, artists, max_rows=1)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_models_still_run_after_a_fact_was_written(spark):
    """An Observation would leave a manager in the session that tasks can't carry."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    join.write_fact(spark.range(20).select(F.lit("k").alias("artist_id_key")), "fact", "artist_id_key")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(40).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("x")))
    done = NaiveBayes(modelType="gaussian").fit(rows).transform(rows)
    assert done.groupBy("prediction").count().agg(F.sum("count")).first()[0] == 40


def test_first_of_lines_are_the_first_tracks_without_another_shuffle(spark, tmp_dir):
    from cadenza.plans import catalog
    d = _music(spark, tmp_dir)
    want = sorted(map(str, catalog.first_tracks(spark, d).collect()))
    broadcast, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    old = {k: spark.conf.get(k) for k in (broadcast, adaptive)}
    try:
        lines = catalog.first_of_lines(spark, d)
        assert sorted(map(str, lines.collect())) == want and len(want) == 3
        spark.conf.set(broadcast, "-1")
        spark.conf.set(adaptive, "false")
        lines = catalog.first_of_lines(spark, d)
        assert sorted(map(str, lines.collect())) == want
        plan = lines._jdf.queryExecution().executedPlan().toString()
        with_line = plan[:plan.index("isnull(l_linenumber")]
        assert "hashpartitioning(l_orderkey" in with_line and "hashpartitioning(k_order" not in with_line
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shuffles_of_a_built_table_grow_with_its_rows(spark):
    from cadenza.session import ROWS_A_PARTITION, shuffles_for
    key, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts, unset = spark.conf.get(key), spark.conf.get(size, None)
    with shuffles_for(spark, 1000 * ROWS_A_PARTITION + 1):
        assert spark.conf.get(key) == "1001" and spark.conf.get(size) != unset
    with shuffles_for(spark, 1):
        assert spark.conf.get(key) == parts
    assert (spark.conf.get(key), spark.conf.get(size, None)) == (parts, unset)
