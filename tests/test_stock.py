"""Hourly stock and coverage against plain loops."""

import datetime
import random

import pytest

from counterlift.operators import stock as K


@pytest.mark.parametrize("piece_days", [1, 3, 28])
def test_panel_carries_the_last_reading_over_pieces(spark, piece_days):
    rng = random.Random(piece_days)
    day = datetime.date(2024, 1, 30)
    days = [day + datetime.timedelta(d) for d in (0, 1, 2, 5, 9, 40, 41)]
    rows = [(a, s, d, h, float(rng.randint(0, 3)) if rng.random() < 0.8 else None) for a in "xy" for s in (1, 2) for d in days for h in rng.sample(range(24), 2)]
    rows += [("x", 1, days[1], 5, 9.0), ("x", 1, days[1], 5, 2.0), ("x", 1, days[1], 5, 4.0)]  # three readings in one hour
    got = K.hourly_stock(spark.createDataFrame(rows, "article string, site long, soh_date date, soh_hour int, soh double"), piece_days=piece_days).collect()
    lowest = {}
    for a, s, d, h, v in rows:
        known = [x for x in (lowest.get((a, s, d, h)), v) if x is not None]
        lowest[a, s, d, h] = min(known) if known else None
    want = {}
    for a in "xy":
        for s in (1, 2):
            last = None
            for d in days:
                for h in range(24):
                    now = lowest.get((a, s, d, h))
                    last = last if now is None else now
                    want[d, h, s, a] = last
    assert {(r.soh_date, r.hour, r.site, r.article): r.stock_level for r in got} == want
    assert len(got) == len(want)


def test_coverage_counts_a_sku_once_per_store(spark):
    day = datetime.date(2024, 1, 1)
    cohorts = spark.createDataFrame([("A", day, 1, "l1", 1), ("A", day, 1, "l2", 0), ("A", day, 2, "l1", 1)], "campaign_id string, campaign_start_date date, site long, line_name string, is_compliant int")
    bookings = spark.createDataFrame([("A", "l1", "p1,p2"), ("A", "l2", "p2,p3,p3")], "booking_number string, line_name string, quoteline_sku string")
    oos = spark.createDataFrame([(1, day, "p2", 9, 0), (1, datetime.date(2024, 2, 1), "p1", 9, 0)], "site long, soh_date date, article string, total_trading_hours long, n_trading_hours_oos long")
    got = {(r.campaign_id, r.site): (r.total_store_skus, r.unchecked_skus) for r in K.store_coverage(cohorts, bookings, oos).collect()}
    assert got == {("A", 1): (3, 2), ("A", 2): (2, 2)}
    assert K.coverage_gate(K.store_coverage(cohorts, bookings, oos), 0.7).count() == 1


def test_panel_is_not_joined(spark):
    """A panel joined back to its carried readings went to the driver as a broadcast of all its rows."""
    rows = [("x", s, datetime.date(2024, 1, 1 + d), 5, 1.0) for s in range(20) for d in range(5)] + [(None, 1, datetime.date(2024, 1, 1), 5, 1.0), ("x", None, datetime.date(2024, 1, 1), 5, 1.0)]
    panel = K.hourly_stock(spark.createDataFrame(rows, "article string, site long, soh_date date, soh_hour int, soh double"))
    assert "Join" not in panel._jdf.queryExecution().optimizedPlan().toString()
    assert panel.count() == 20 * 5 * 24  # rows without a key are dropped


def test_trading_hours_are_counted_per_day(spark):
    monday = datetime.date(2024, 1, 1)
    panel = spark.createDataFrame([(monday, h, 1, "x", 0.0 if h < 9 else 2.0 if h < 12 else None) for h in range(24)], "soh_date date, hour int, site long, article string, stock_level double")
    hours = "site long, weekday string, opening_hour int, closing_hour int"
    got = K.oos_hours(panel, spark.createDataFrame([(1, "Monday", 7, 20), (1, "Monday", 7, 20), (1, "Tuesday", 6, 24), (2, "Monday", 0, 24)], hours)).collect()
    assert [(r.site, r.total_trading_hours, r.n_trading_hours_oos) for r in got] == [(1, 14, 2)]
    assert K.oos_hours(panel, spark.createDataFrame([(1, "Monday", 7, 0), (1, "Monday", 9, None)], hours)).collect() == []
    whole = K.oos_hours(panel, spark.createDataFrame([(1, "Monday", 0, 24)], hours)).collect()
    assert [(r.total_trading_hours, r.n_trading_hours_oos) for r in whole] == [(24, 9)]
