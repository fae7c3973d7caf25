"""A cross-section of the registered queries against their SQL on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "weekly_store_sales", "baseline_stats", "pre_vs_during", "period_sales_seven_days", "nearest_control",
    "store_uplift_report", "global_matching", "media_taxonomy", "concurrent_campaigns", "campaign_stockout_rate",
    "control_shoppers", "sku_conversions", "shopper_summary", "conversion_summary", "partial_pooling", "keyed_replace",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, note, _, _ = check.compare(spark, con, name, FOLDER)
    assert status == "ok", note


def test_every_query_has_a_stable_name_and_most_have_sql():
    import __spark_entry__ as entry
    from counterlift.catalog.all_queries import ORACLES, QUERIES

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert len(QUERIES) - len(ORACLES) <= 3
