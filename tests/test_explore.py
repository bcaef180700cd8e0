"""Dashboard operators: histograms, group profiles, correlation, sampling."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.operators import explore
from cadenza.operators.sampling import sample_exact, train_test_split


def test_histogram_edges_and_counts(spark):
    vals = [0.0, 1.0, 2.5, 5.0, 10.0, None]
    df = spark.createDataFrame([(v, 3.0) for v in vals], "x double, c double")
    h = {(r["feature"], r["bin"]): r for r in explore.histogram(df, ["x", "c"], 4).collect()}
    xs = [h[("x", b)]["n"] for b in range(1, 5)]
    assert xs == [2, 1, 1, 1]                  # left-closed bins: 2.5 opens bin 2, 5.0 bin 3; max in the last
    assert sum(xs) == 5                        # missing value not counted
    assert h[("x", 1)]["bin_lo"] == 0.0 and h[("x", 4)]["bin_hi"] == 10.0
    assert h[("c", 1)]["n"] == 6 and h[("c", 2)]["n"] == 0   # single value -> all in bin 1


def test_peak_year_tie_takes_earlier(spark):
    df = spark.createDataFrame([(1990,), (1991,), (1991,), (1990,), (1995,)], "release_year int")
    r = explore.peak_year(df).first()
    assert (r["peak_year"], r["n"]) == (1990, 2)


def test_absent_class(spark):
    df = spark.createDataFrame([("Mainstream", 50.0), ("Emerging", 20.0), ("Emerging", 30.0)],
                               "popularity_category string, popularity double")
    counts = explore.category_counts(df).collect()
    assert [r["popularity_category"] for r in counts] == ["Mainstream", "Emerging"]
    assert math.isclose(sum(r["share"] for r in counts), 1.0)
    means = {r["popularity_category"]: r["avg_popularity"] for r in explore.popularity_by_category(df).collect()}
    assert means == {"Hit": None, "Mainstream": 50.0, "Emerging": 25.0, "Underground": None}


def test_corr_matrix_matches_pandas_pairwise(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=200), "c": rng.normal(size=200), "k": 1.0})
    for cols in (["a", "b", "c", "k"],):
        complete = spark.createDataFrame(pdf)
        holes = pdf.copy()
        holes.loc[::7, "b"] = np.nan
        holes.loc[::5, "c"] = np.nan
        sparse = spark.createDataFrame(holes.astype(object).where(holes.notna(), None),
                                       "a double, b double, c double, k double")
        for frame, ref in ((complete, pdf), (sparse, holes)):
            m = {(r["row_feature"], r["col_feature"]): r["corr"] for r in explore.corr_matrix(frame, cols).collect()}
            expect = ref[cols].corr()
            for x in cols:
                for y in cols:
                    e = expect.loc[x, y]
                    if x == "k" or y == "k":
                        assert m[(x, y)] is None
                    else:
                        assert abs(m[(x, y)] - e) < 1e-4, (x, y)
                        assert m[(x, y)] == m[(y, x)]
            assert m[("a", "a")] == 1.0


def test_sample_exact_size_and_partition_independence(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    s1 = sorted(r["k"] for r in sample_exact(df.repartition(3), 700, "k").collect())
    s2 = sorted(r["k"] for r in sample_exact(df.repartition(17), 700, "k").collect())
    assert len(s1) == 700 and s1 == s2
    assert sample_exact(df, 10_000, "k").count() == 5000


def test_split_is_repeatable(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tr, te = train_test_split(df.repartition(5), "k")
    tr2, te2 = train_test_split(df.repartition(11), "k")
    assert sorted(r[0] for r in te.collect()) == sorted(r[0] for r in te2.collect())
    assert tr.count() + te.count() == 4000
    assert 0.15 < te.count() / 4000 < 0.25


def test_explorer_view_and_page(spark):
    rows = [(f"s{i}", "A", float(i % 10), "Emerging", 2005, 0.1, 0.2, 0.3, 100.0, 3.0, 0, "pop")
            for i in range(700)]
    df = spark.createDataFrame(rows, "name string, artist_name string, popularity double, popularity_category string, "
                                     "release_year int, danceability double, energy double, valence double, tempo double, "
                                     "duration_min double, explicit int, primary_genre string")
    view = explore.explorer_view(df)
    got = view.collect()
    assert len(got) == 500 and got[0]["popularity"] == 9.0
    assert explore.explorer_view(df, classes=[]).count() == 0
    assert explore.explorer_view(df, years=(2010, 2020)).count() == 0
    page = explore.explorer_page(view, page=1, size=20).collect()
    assert [r["row"] for r in page] == list(range(21, 41))


def test_mutual_info_ranks_dependence(spark):
    from cadenza.operators.select import mutual_info_binned, mutual_info_quantile
    rng = np.random.default_rng(11)
    y = rng.normal(size=3000)
    pdf = pd.DataFrame({"dep": y + rng.normal(size=3000) * 0.1, "noise": rng.normal(size=3000), "popularity": y})
    df = spark.createDataFrame(pdf)
    for fn in (mutual_info_binned, mutual_info_quantile):
        mi = {r["feature"]: r["mi"] for r in fn(df, ["dep", "noise"]).collect()}
        assert mi["dep"] > 1.0 > 0.1 > mi["noise"] >= 0.0


def test_mutual_info_with_missing_values_uses_complete_rows(spark):
    from cadenza.operators.select import column_profile, mutual_info_binned
    rows = [(float(i % 10), None if i % 4 == 0 else float(i % 7), float(i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, popularity double")
    prof = column_profile(df, ["a", "b", "popularity"])
    shared = {r["feature"]: r["mi"] for r in mutual_info_binned(df, ["a", "b"], profile=prof).collect()}
    alone = {r["feature"]: r["mi"] for r in mutual_info_binned(df, ["a", "b"]).collect()}
    assert shared == alone


def test_exact_quantiles_match_order(spark):
    from cadenza.operators.select import exact_quantiles
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"normal": rng.normal(size=4000), "ties": rng.integers(0, 6, 4000).astype(float),
                        "hot": np.where(rng.random(4000) < 0.4, 1.0, rng.exponential(size=4000)), "one": 2.0})
    df = spark.createDataFrame(pdf).repartition(5)
    expect = {c: [sorted(pdf[c])[-(-4000 * i // 10) - 1] for i in range(1, 10)] for c in pdf}
    for accuracy, boundary in ((10_000, 10_000), (50, 100), (20, 0)):     # ordered at once; brackets first; brackets only
        assert exact_quantiles(df, list(pdf), 10, accuracy, boundary) == expect, (accuracy, boundary)
    assert exact_quantiles(df.limit(0), ["normal"], 4) == {"normal": []}


def test_corr_matrix_is_one_pass_and_survives_empty_pairs(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, 2.0, 6.0), (3.0, None, 9.0)], "a double, b double, c double")
    m = {(r["row_feature"], r["col_feature"]): r["corr"] for r in explore.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(m) == 9 and m[("a", "b")] is None and m[("a", "a")] == 1.0 and m[("a", "c")] == m[("c", "a")] == 1.0
    assert {r["corr"] for r in explore.corr_matrix(df.limit(0), ["a", "b"]).collect()} == {None}
    from conftest import SF_SMALL
    plan = explore.corr_matrix(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"), ["l_quantity", "l_tax"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "partial_covar_pop" in plan


def test_corr_matrix_emits_blocks_not_pairs(spark):
    """17 columns have 153 pairs; a row gives at most one row per four of them and column."""
    cols = [f"c{i}" for i in range(17)]
    df = spark.range(400).select(*[F.when(F.col("id") % (i + 2) != 0, (F.col("id") * (i * 37 + 11)) % 101).cast("double").alias(c)
                                   for i, c in enumerate(cols)])
    got = explore.corr_matrix(df, cols)
    ref = df.toPandas()[cols].corr()
    assert all(abs(r["corr"] - ref.loc[r["row_feature"], r["col_feature"]]) < 1e-4 for r in got.collect())
    assert got.count() == 17 * 17
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    try:
        spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
        plan = explore.corr_matrix(df, cols)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    emitted = [line for line in plan.split("\n") if "Generate inline" in line][-1]
    assert 17 <= emitted.count("struct(block,") <= 17 * 5


def test_scores_are_made_a_few_columns_at_a_time(spark):
    """No aggregate or row generator holds the expressions of all columns."""
    from cadenza.operators.select import MI_BLOCK, corr_with_target, mutual_info_binned, mutual_info_quantile
    cols = [f"c{i}" for i in range(11)]
    df = spark.range(600).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(cols)],
                                 (F.col("id") % 13).cast("double").alias("popularity"))
    ref = df.toPandas()
    got = {r["feature"]: r["corr"] for r in corr_with_target(df, cols).collect()}
    assert list(got) == cols and all(abs(got[c] - ref[c].corr(ref["popularity"])) < 1e-6 for c in cols)
    plan = corr_with_target(df, cols)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [corr(") == -(-11 // explore.CORR_BLOCK)
    for fn in (mutual_info_binned, mutual_info_quantile):
        whole = {r["feature"]: r["mi"] for r in fn(df, cols).collect()}
        assert whole == {c: fn(df.select(c, *[x for x in cols if x != c], "popularity"), [c]).first()["mi"] for c in cols}
        assert fn(df, cols)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(") == -(-11 // MI_BLOCK)
