"""Column functions: list literals, dates, trimming, categories, rounding."""

import math

from pyspark.sql import functions as F

from cadenza.functions.dates import release_year
from cadenza.functions.numeric import (clip, decade, energy_category, pearson,
                                       popularity_category, round_to, score_label)
from cadenza.functions.text import (first_of_list, list_or_empty,
                                    missing_marker_to_null, search_match, trim_space)


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_first_of_list(spark):
    vals = ["['Uli']", "[\"Guns N' Roses\"]", "['A', \"B's\"]", "['a\\xa0b']", "[]", "Uli", "", None]
    names = col_values(spark, vals, lambda c: first_of_list(c, "Unknown"))
    assert names == ["Uli", "Guns N' Roses", "A", "a\xa0b", "Unknown", "Unknown", "Unknown", "Unknown"]
    ids = col_values(spark, vals, lambda c: first_of_list(c, None))
    assert ids[:4] == ["Uli", "Guns N' Roses", "A", "a\xa0b"] and ids[4:] == [None] * 4


def test_list_or_empty(spark):
    vals = ["['pop', \"rock'n\"]", "[]", "not a list", None]
    out = col_values(spark, vals, list_or_empty)
    assert out == [["pop", "rock'n"], [], [], []]


def test_release_year(spark):
    vals = ["1922-02-22", "1922", "2001-05", "1999-13-45", "5/1/2001", "abcd-01-01", None]
    assert col_values(spark, vals, release_year) == [1922, 1922, 2001, 1999, 0, 0, 0]


def test_trim_space(spark):
    vals = ["  a b \t", "\nx\n", "a\xa0b", None]
    assert col_values(spark, vals, trim_space) == ["a b", "x", "a\xa0b", None]


def test_missing_markers(spark):
    vals = ["NA", "None", "null", "N/A", "", "Real"]
    assert col_values(spark, vals, missing_marker_to_null) == [None] * 5 + ["Real"]


def test_popularity_category_limits(spark):
    vals = [70.0, 69.99, 40.0, 10.0, 9.99, 0.0, None]
    out = col_values(spark, vals, popularity_category, "double")
    assert out == ["Hit", "Mainstream", "Mainstream", "Emerging", "Underground", "Underground", "Underground"]


def test_energy_category_limits(spark):
    vals = [0.0, 0.33, 0.34, 0.66, 1.0, 1.01, None]
    out = col_values(spark, vals, energy_category, "double")
    assert out == [None, "Low", "Medium", "Medium", "High", None, None]


def test_clip_and_vocal_density(spark):
    df = spark.createDataFrame([(0.8, 0.5), (0.1, 0.1), (None, 0.1)], "ins double, sp double")
    out = [r[0] for r in df.select(clip(1 - F.col("ins") - F.col("sp"), 0.0, 1.0)).collect()]
    assert out[0] == 0.0 and abs(out[1] - 0.8) < 1e-12 and out[2] is None


def test_decade(spark):
    assert col_values(spark, [1994, 2000, 0], decade, "int") == ["1990s", "2000s", "0s"]


def test_search_is_regex_and_ignores_case(spark):
    df = spark.createDataFrame([("ABC", "x"), ("a.c", "y"), (None, "abc"), ("zzz", None)], "name string, artist string")
    hits = lambda q: [r[0] for r in df.where(search_match(["name", "artist"], q)).select("name").collect()]
    assert hits("abc") == ["ABC", None]
    assert sorted(hits("a.c"), key=str) == sorted(["ABC", "a.c", None], key=str)
    assert len(hits("")) == 4
    lit = [r[0] for r in df.where(search_match(["name"], "a.c", literal=True)).collect()]
    assert lit == ["a.c"]


def test_round_to_binary_value(spark):
    out = col_values(spark, [0.30215, 2.5, -2.5, 1.005], lambda c: round_to(c, 4), "double")
    assert out == [round(0.30215, 4), 2.5, -2.5, 1.005]
    assert col_values(spark, [2.5, -2.5], lambda c: round_to(c, 0), "double") == [3.0, -3.0]


def test_pearson_null_on_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(pearson("x", "y")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.0)], "x double, y double")
    import numpy as np
    r = df2.agg(pearson("x", "y")).first()[0]
    assert math.isclose(r, np.corrcoef([1, 2, 4], [2, 4.1, 8])[0, 1], rel_tol=1e-12)


def test_score_label(spark):
    out = col_values(spark, [100.0, 69.999, 10.0, 0.0], score_label, "double")
    assert out == ["Hit 🔥", "Mainstream 🎵", "Emerging 🌱", "Underground 🎸"]


def test_sized_conf():
    from cadenza.session import sized_conf
    c = sized_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert int(sized_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_list_literal_escapes(spark):
    vals = [repr(["a\\x41\x07"]), repr(["\U00018cd6z"]), repr(["\\U00018cd6"]), repr(["x\x00\U000e0001y", "b"])]
    out = col_values(spark, vals, lambda c: first_of_list(c, "Unknown"))
    assert out == ["a\\x41\x07", "\U00018cd6z", "\\U00018cd6", "x\x00\U000e0001y"]
