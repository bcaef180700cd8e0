"""Scoring (batch and stream), CSV / parquet sources, artifacts."""

import os

import pytest
from pyspark.sql import functions as F

from cadenza.operators.score import align, request_features, score
from cadenza.schema import ARTISTS_SCHEMA, TRACKS_SCHEMA
from cadenza.sources import artifacts, parquet
from cadenza.sources.csv import scan_csv


class FixedModel:
    """Stands in for a PipelineModel: the prediction is the ``raw`` column."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("raw"))


def test_score_clip_and_category(spark):
    df = spark.createDataFrame([(104.0,), (-3.0,), (69.999,), (12.125,)], "raw double")
    out = score(FixedModel(), df, keep=["raw"]).collect()
    got = {r["raw"]: (r["predicted_score"], r["predicted_category"]) for r in out}
    assert got[104.0] == (100.0, "Hit 🔥")
    assert got[-3.0] == (0.0, "Underground 🎸")
    assert got[69.999] == (70.0, "Mainstream 🎵")    # category from the unrounded score
    assert got[12.125][0] == round(12.125, 2)


def test_request_defaults_and_alignment(spark):
    req = spark.createDataFrame([("r1", 0.5, None)], "id string, danceability double, energy double")
    f = request_features(req, keep=["id"]).first()
    assert f["energy"] == 0.8 and abs(f["dance_energy_index"] - 0.4) < 1e-12
    assert abs(f["loudness_norm"] - (55 / 60)) < 1e-12
    al = align(request_features(req, keep=["id"]), ["tempo", "not_a_feature"], keep=["id"]).first()
    assert al["tempo"] == 120.0 and al["not_a_feature"] == 0.0


def test_scan_csv_markers_and_quotes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tracks.csv")
    header = ",".join(f.name for f in TRACKS_SCHEMA.fields)
    rows = [
        'a,"Say ""hi""",50,200000,0,"[\'A\', ""B\'s""]","[\'x\']",2001-05-01,0.5,0.5,-5,0.1,0.1,0,0.1,0.5,120',
        'b,NA,40,200000,1,[],[],1999,0.5,0.5,-5,0.1,0.1,0,0.1,0.5,NaN',
        'c,None,,200000,1,[],[],1999,0.5,0.5,-5,0.1,0.1,0,0.1,0.5,100',
    ]
    with open(path, "w") as fh:
        fh.write(header + "\n" + "\n".join(rows) + "\n")
    df = {r["id"]: r for r in scan_csv(spark, path, TRACKS_SCHEMA).collect()}
    assert df["a"]["name"] == 'Say "hi"' and df["a"]["artists"] == "['A', \"B's\"]"
    assert df["b"]["name"] is None and df["b"]["tempo"] is None
    assert df["c"]["name"] is None and df["c"]["popularity"] is None


def test_scan_csv_binds_columns_by_name(spark, tmp_dir):
    from cadenza.sources.csv import bad_values
    path = os.path.join(tmp_dir, "artists.csv")
    with open(path, "w") as fh:
        fh.write("name,genres,id,popularity,followers\nAnn,\"['pop']\",a1,50,1e3\nBob,[],a2,many,NA\nCy,[],a3,1,2,3\n")
    got = {r["id"]: r for r in scan_csv(spark, path, ARTISTS_SCHEMA).collect()}
    assert got["a1"].asDict() == {"id": "a1", "followers": 1000.0, "popularity": 50.0, "genres": "['pop']"}
    assert got["a2"]["popularity"] is None and got["a2"]["followers"] is None
    counts = {r["column"]: (r["n_missing"], r["n_bad"]) for r in bad_values(spark, path, ARTISTS_SCHEMA).collect()}
    assert counts == {"id": (0, 0), "followers": (1, 0), "popularity": (0, 1), "genres": (0, 0), None: (0, 1)}
    with pytest.raises(ValueError, match="duration_ms"):
        scan_csv(spark, path, TRACKS_SCHEMA)


def test_keep_first_in_file_order(spark, tmp_dir):
    from cadenza.operators.clean import clean_artists
    from cadenza.plans.training import in_files
    path = os.path.join(tmp_dir, "artists.csv")
    with open(path, "w") as fh:
        fh.write("id,followers,popularity,genres\n" + "".join(f"a{i % 500},{5000 - i},{i % 7},[]\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = scan_csv(spark, path, ARTISTS_SCHEMA, positions=True)
        assert df.rdd.getNumPartitions() > 4
        got = {r["id"]: r["followers"] for r in clean_artists(df, order_by=in_files(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"a{i}": 5000.0 - i for i in range(500)}


def test_round_score_is_pythons_round(spark):
    from cadenza.functions.numeric import round_score
    values = [2.675, 1.115, 12.125, 12.375, 0.005, 0.125, 99.995, 100.0, 0.0] + [i / 1000 for i in range(0, 100_000, 5)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", round_score("v").alias("r"))
    assert [r for r in df.collect() if r["r"] != (None if r["v"] is None else round(r["v"], 2))] == []


def test_classes_of_test_rows_are_known(spark):
    from cadenza.operators import model
    rows = [(f"k{i}", float(i), float(i % 90), "Hit") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, x double, popularity double, popularity_category string")
    label = F.when(model.split_flag("id"), "Underground").otherwise("Hit")
    train, test, classes, _ = model.prepare(df.withColumn("popularity_category", label), ["x"], cap=10)
    assert classes == ["Hit", "Underground"] and train.count() == 10
    assert {r["label"] for r in test.select("label").collect()} == {1.0}
    assert test.count() == df.where(model.split_flag("id")).count()


def test_snapshot_roundtrip_and_artifacts_missing(spark, tmp_dir):
    df = spark.createDataFrame([("s", 1994, 50.0)], "name string, release_year int, popularity double")
    path = parquet.write_snapshot(df, os.path.join(tmp_dir, "snap"))
    back = parquet.read_snapshot(spark, path).first()
    assert back["decade"] == "1990s" and back["popularity"] == 50.0
    assert sorted(artifacts.missing(spark, os.path.join(tmp_dir, "nothing"))) == sorted(artifacts.REQUIRED)
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, os.path.join(tmp_dir, "nothing"))


def test_stream_equals_batch(spark, tmp_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from cadenza.operators.score import score_requests
    from cadenza.streaming.scoring import score_files
    train = spark.createDataFrame([(float(i) / 10, float(i) * 7 % 100) for i in range(50)],
                                  "danceability double, label double")
    pm = Pipeline(stages=[VectorAssembler(inputCols=["danceability"], outputCol="features"),
                          LinearRegression(labelCol="label")]).fit(train)
    req = spark.createDataFrame([(f"r{i}", i / 20) for i in range(20)], "id string, danceability double")
    src = os.path.join(tmp_dir, "req")
    req.repartition(3).write.parquet(src)
    batch = {r["id"]: tuple(r[1:]) for r in score_requests(pm, req, ["danceability"], keep=["id"]).collect()}
    stream = {r["id"]: tuple(r[1:]) for r in score_files(spark, pm, ["danceability"], src, req.schema, keep=["id"]).collect()}
    assert batch == stream and len(stream) == 20


def test_artists_schema_has_genres():
    assert "genres" in ARTISTS_SCHEMA.fieldNames()


def test_stage_url_then_scan(spark, tmp_dir):
    from cadenza.sources.csv import stage_url
    src = os.path.join(tmp_dir, "artists.csv")
    with open(src, "w") as fh:
        fh.write("id,followers,popularity,genres\na1,10,50,\"['pop']\"\n")
    local = stage_url("file://" + src, os.path.join(tmp_dir, "staged"))
    got = scan_csv(spark, local, ARTISTS_SCHEMA).first()
    assert got["id"] == "a1" and got["genres"] == "['pop']"


def test_scan_csv_query_writes_compressed_files(spark, tmp_dir):
    """All rows come back; the text takes less than half of its plain size on disk."""
    import gzip

    from cadenza.plans import catalog
    from cadenza.sources import tables

    n = 400
    spark.range(n).selectExpr("id div 4 AS l_orderkey", "id % 9 AS l_partkey", "id % 5 AS l_suppkey", "cast(id % 4 + 1 AS int) AS l_linenumber",
                              "cast(id % 50 AS double) AS l_quantity", "id * 1.5D AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax",
                              "if(id % 3 = 0, 'R', 'N') AS l_returnflag").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.range(n // 4).selectExpr("id AS o_orderkey", "timestamp_ntz'1998-03-04 00:00:00' AS o_orderdate", "id * 10.25D AS o_totalprice").write.parquet(f"{tmp_dir}/orders.parquet")
    spark.range(9).selectExpr("id AS p_partkey", "concat('old \"gizmo, ', id) AS p_name", "cast(id AS int) AS p_size").write.parquet(f"{tmp_dir}/part.parquet")
    got = catalog.QUERIES["scan_csv"](spark, tmp_dir)
    want = tables.music_tracks(spark, tmp_dir, with_order=False).select("id", "name")
    assert got.count() == n and got.select("id", "name").exceptAll(want).isEmpty()
    files = [f.removeprefix("file:").replace("///", "/") for f in got.inputFiles()]
    assert files and all(f.endswith(".gz") for f in files)
    assert 2 * sum(os.path.getsize(f) for f in files) < sum(len(gzip.open(f).read()) for f in files)
