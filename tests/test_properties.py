"""Property tests: parsers against plain-Python statements of the rules.
Each example is a batch of values evaluated in one Spark job."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions.dates import release_year
from cadenza.functions.text import first_of_list, list_or_empty

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

text = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=12)


@settings(**SETTINGS)
@given(st.lists(st.lists(text, max_size=4), min_size=1, max_size=40))
def test_list_literals_round_trip(spark, lists):
    rows = [(i, repr(v)) for i, v in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = df.orderBy("i").select(first_of_list("s", "Unknown").alias("f"),
                                 list_or_empty("s").alias("l")).collect()
    for v, r in zip(lists, got):
        assert r["l"] == v
        assert r["f"] == (v[0] if v else "Unknown")


def year_rule(s):
    """Full ``YYYY-MM-DD`` date -> its year; else the first four characters
    as a number; else 0."""
    if s is None:
        return 0
    try:
        if len(s) == 10 and s[4] == "-" and s[7] == "-":
            return dt.date(int(s[:4]), int(s[5:7]), int(s[8:10])).year
    except ValueError:
        pass
    head = s[:4]
    return int(head) if head.isdigit() and head.isascii() else 0


dates = st.one_of(
    st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2030, 12, 31)).map(lambda d: d.isoformat()),
    st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2030, 12, 31)).map(lambda d: d.isoformat()[:7]),
    st.integers(1000, 9999).map(str),
    st.tuples(st.integers(1900, 2030), st.integers(13, 19), st.integers(32, 39)).map(lambda t: f"{t[0]}-{t[1]}-{t[2]}"),
    st.text(alphabet="abc/-.x ", max_size=10),
    st.none(),
)


@settings(**SETTINGS)
@given(st.lists(dates, min_size=1, max_size=60))
def test_release_year_rule(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(release_year(F.col("s"))).collect()]
    assert got == [year_rule(v) for v in values]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=8)
                .map(lambda t: t) | st.builds(lambda a, b, c: a + b + c,
                                              st.sampled_from([" ", "\t", "\x1c", "\x85", "　", " ", ""]),
                                              st.text(max_size=5),
                                              st.sampled_from([" ", "\n", "\x1f", "\xa0", " ", ""])),
                min_size=1, max_size=60))
def test_trim_matches_python_strip(spark, values):
    from cadenza.functions.text import trim_space
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(trim_space(F.col("s"))).collect()]
    assert got == [v.strip() for v in values]


cell = st.one_of(st.sampled_from(["NA", "None", "null", "", "n/a", "a,b", 'say "hi"', "two\nlines", " pad "]),
                 st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc")), max_size=6))


@settings(**SETTINGS)
@given(st.lists(st.tuples(cell, cell), min_size=1, max_size=30))
def test_scan_csv_matches_pandas_reader(spark, tmp_path_factory, rows):
    import pandas as pd
    from pyspark.sql import types as T
    from cadenza.sources.csv import scan_csv
    d = tmp_path_factory.mktemp("csv")
    path = str(d / "t.csv")
    pd.DataFrame({"k": [str(i) for i in range(len(rows))], "a": [r[0] for r in rows],
                  "b": [r[1] for r in rows]}).to_csv(path, index=False)
    ref = pd.read_csv(path, dtype=str, keep_default_na=True)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["k", "a", "b"]])
    got = {r["k"]: (r["a"], r["b"]) for r in scan_csv(spark, path, schema, multi_line=True).collect()}
    for _, r in ref.iterrows():
        want = tuple(None if pd.isna(v) else v for v in (r["a"], r["b"]))
        assert got[r["k"]] == want


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), st.integers(0, 5),
                          st.integers(-3, 3)), min_size=1, max_size=40))
def test_dedup_matches_pandas_keep_first(spark, rows):
    import pandas as pd
    from cadenza.operators.clean import dedup_keep_first
    data = [(k, o, v, i) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, o int, v int, i int")
    got = sorted((r["k"] or "", r["o"], r["v"], r["i"]) for r in dedup_keep_first(df, "k", ["o", "v", "i"]).collect())
    pdf = pd.DataFrame(data, columns=["k", "o", "v", "i"]).sort_values(["o", "v", "i"], kind="stable")
    want = sorted((k or "", o, v, i) for k, o, v, i in
                  pdf.drop_duplicates(subset="k", keep="first").itertuples(index=False, name=None))
    assert got == want


def test_exact_sample_and_split(spark):
    import hashlib

    from cadenza.operators import sampling
    keys = [f"k{i}" for i in range(1000)] + ["same"] * 30
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "id string, v int").repartition(7)
    order = sorted((hashlib.md5(f"{k}|42".encode()).hexdigest(), k) for k in keys)
    for bucket in (1, 4):                      # one digit a step refines several times
        sampling.BUCKET_HEX, kept, limit = bucket, sampling.BUCKET_HEX, sampling.BOUNDARY
        sampling.BOUNDARY = 5
        try:
            for n in (0, 1, 7, 333, 1029, 1030, 5000):
                got = sorted(r.id for r in sampling.sample_exact(df, n, "id").collect())
                assert got == sorted(k for _, k in order[:n])
            split = sampling.exact_split(df.where("id <> 'same'"), "id", 0.2)
            assert {r.id for r in split.where("is_test").collect()} == {k for _, k in [x for x in order if x[1] != "same"][:200]}
        finally:
            sampling.BUCKET_HEX, sampling.BOUNDARY = kept, limit


def test_scatter_axes(spark):
    from cadenza.operators.explore import scatter
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, None, 2.0, "a"), (3, 3.0, None, "b"), (4, 4.0, 5.0, None)], "id int, u double, w double, c string")
    assert sorted(tuple(r) for r in scatter(df, "u", "w", "c", 10).collect()) == [(1.0, 2.0, "a"), (4.0, 5.0, None)]
    assert scatter(df, "w", "u", n=1).columns == ["x", "y"] and scatter(df, "w", "u", n=1).count() == 1


def test_half_written_artifacts_are_not_read(spark, tmp_dir):
    import pytest

    from cadenza.sources import artifacts
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[]).fit(spark.range(1))
    m = spark.createDataFrame([("a", 1.0)], "metric string, value double")
    imp = spark.createDataFrame([("f", 0.5)], "feature string, importance double")
    path = artifacts.save(tmp_dir + "/x", model, m, imp, classes=["Emerging", "Hit"])
    got = artifacts.load(spark, path)
    assert got["classes"] == ["Emerging", "Hit"] and "confusion" not in got
    artifacts._manifest(spark, []).write.mode("overwrite").parquet(path + "/manifest")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, path)
    artifacts._manifest(spark, ["model", "confusion"]).write.mode("overwrite").parquet(path + "/manifest")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, path)
