"""Registered queries against their DuckDB oracle (the driver's check), on
the smallest table set. Learning queries (no oracle) only need to run."""

import importlib.util
import os

import pytest

from conftest import ROOT, SF_SMALL

spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

import __spark_entry__ as entry  # noqa: E402

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
FAST_ROWS_ONLY = ["reg_linear", "clf_gnb", "metrics_roundtrip"]


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    line = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert " OK " in line, line


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "popularity" in df.columns


def test_every_survey_key_registered():
    keys = set(QUERIES)
    for k in ["dedup_keep_first", "join_left_nullsafe", "explorer_view", "sample_exact", "corr_matrix",
              "mutual_info_binned", "confusion_matrix", "tune_forest", "score_stream", "scan_csv"]:
        assert k in keys
