"""Physical-plan properties the design relies on (checked on sf0.001)."""

from pyspark.sql import functions as F

import re

from conftest import SF_SMALL

from cadenza.plans import catalog


def plan_of(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_explorer_prunes_columns_and_keeps_top_k(spark):
    p = plan_of(spark, "explorer_view")
    assert "TakeOrderedAndProject(limit=500" in p
    scan = [l for l in p.split("\n") if "FileScan" in l][0]
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert "acousticness" not in cols and "liveness" not in cols and "popularity" in cols


def test_aggregates_are_partial_then_final(spark):
    p = plan_of(spark, "overview_kpis")
    assert "partial_avg" in p and "partial_count" in p


def test_exact_sample_cuts_before_ordering(spark):
    from cadenza.operators.sampling import sample_exact
    # more rows wanted than there are: nothing is put in order
    p = plan_of(spark, "sample_exact")
    assert "TakeOrderedAndProject" not in p and "Sort" not in p
    # else only the bucket on the boundary is, behind its filter
    rows = spark.range(20000).withColumn("id", F.col("id").cast("string"))
    p = sample_exact(rows, 500, "id")._jdf.queryExecution().toString()
    assert "Union" in p and "StartsWith" in p and sample_exact(rows, 500, "id").count() == 500


def test_salted_join_scans_the_fact_once(spark):
    p = plan_of(spark, "join_left_nullsafe")
    assert len(re.findall(r"FileScan parquet \[l_orderkey", p)) == 1
    assert "_salt" in p


def test_windows_only_over_aggregated_rows(spark):
    for name in ["category_counts", "leaderboard", "confusion_normalised", "insight_decades"]:
        p = plan_of(spark, name)
        for m in re.finditer(r"Window \[", p):
            below = p[m.start():]
            assert "Aggregate" in below, name
