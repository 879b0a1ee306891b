"""Registered queries against their SQL. ``ICUFLOW_ALL=1`` runs every one of them."""

import os

import pytest
from check_queries import difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from icuflow.registry.queries import QUERIES, _statics
from icuflow.registry.sql import SQL

ROOT = "/root/testdata/sf0.001"
QUICK = (
    "cohort_select", "cohort_first_row", "cohort_attrition", "convert_units", "trim_quantiles",
    "low_with_context", "flag_near", "rolling_stddev", "fuse_sources", "combine_components",
    "bin_aggregate", "window_labels_outlast", "build_windows", "impute", "split_subjects",
    "undersample", "apply_scaler", "roc_curve", "metrics", "threshold_sweep", "calibration",
    "risk_trend", "high_risk", "top_factors", "stream_bins", "stream_alerts",
    "landing_report", "dataset_roundtrip", "documents_json", "high_risk_all", "risk_summary",
    "confusion_own_threshold", "complete_windows", "lost_positives", "global_importance",
)
NAMES = sorted(QUERIES) if os.environ.get("ICUFLOW_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    left = queries()[name](spark, ROOT).toPandas()
    assert difference(left, con.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_patients_are_not_broadcast_to_the_stays(spark, con):
    statics = _statics(spark, ROOT)
    n = statics.count()
    plan = statics._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    both = con.sql(f"SELECT DISTINCT user_id FROM '{ROOT}/events.parquet' JOIN '{ROOT}/customer.parquet' ON user_id = c_custkey")
    assert n == len(both.df()) > 0
