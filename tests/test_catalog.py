"""Named queries agree with their SQL on the smallest tables; every operator group is represented."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from sensorframe.plans.views import TABLES
from tools_check import compare

SF = "/root/testdata/sf0.001"
NAMES = ["dwell_alert_counts", "alerts_of_all_rules", "run_counters", "representation_changes", "anomaly_scores",
         "class_metrics", "fusion_contributors", "frames_of_folder", "coco_subset", "frame_manifest_violations",
         "hook_tracker", "hook_encoder", "hook_detector"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")


def test_every_statement_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"run_id", "alert_type", "label", "alerts", "frame_sum"}
