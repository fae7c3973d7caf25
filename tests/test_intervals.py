"""Open sets of windows and factorised conversions against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from counterlift.operators import exposure as X
from counterlift.operators.intervals import segments, with_open_set


@pytest.mark.parametrize("salts", [1, 5])
def test_open_sets_equal_a_comparison_of_all(spark, salts):
    rng = random.Random(salts)
    windows = [("a", 5, 30), ("b", 10, 20), ("b", 10, 20), ("c", 20, 21), ("d", 25, 25), ("e", 70, 90), ("f", 0, 100), ("g", None, 4), (None, 40, 55)]
    windows += [(f"w{i}", x := rng.randint(0, 200), x + rng.randint(0, 60)) for i in range(30)]
    events = [(i, rng.randint(-20, 320), "x") for i in range(300)] + [(900 + i, 50, "x") for i in range(200)] + [(2000, None, "x"), (2001, 50, "x"), (2001, 50, "x")]
    w = spark.createDataFrame(windows, "booking string, lo long, hi long")
    e = spark.createDataFrame(events, "id long, ts long, at_page string")
    cuts, members = segments(w, ["booking"], width=7)
    got = with_open_set(e, F.col("ts"), cuts, width=7, salts=salts).collect()
    assert len(got) == len(events)
    by_set = {}
    for r in members.collect():
        by_set.setdefault(r.set_id, set()).add(r.booking)
    for r in got:
        want = {b for b, lo, hi in windows if None not in (lo, hi, r.ts) and lo <= r.ts < hi}
        assert by_set.get(r.set_id, set()) == want and r.n_open == len(want)
    assert members.count() == sum(map(len, by_set.values()))


def test_no_windows_or_no_events(spark):
    w = spark.createDataFrame([], "booking string, lo long, hi long")
    e = spark.createDataFrame([(1, 5)], "id long, ts long")
    cuts, members = segments(w, ["booking"], width=7)
    assert [(r.id, r.set_id, r.n_open) for r in with_open_set(e, F.col("ts"), cuts, width=7).collect()] == [(1, None, 0)]
    cuts, members = segments(spark.createDataFrame([("a", 1, 9)], "booking string, lo long, hi long"), ["booking"], width=7)
    assert with_open_set(e.limit(0), F.col("ts"), cuts, width=7).collect() == [] and members.count() == 1


def test_conversion_lines_stand_for_all_conversions(spark):
    """Grouped rows of ``conversions`` over every set of a control equal the factorised lines."""
    rng = random.Random(3)
    day = datetime.date(2024, 3, 1)
    step = datetime.timedelta(1)
    campaigns = {"A": (day, day + 20 * step), "B": (day + 5 * step, day + 30 * step)}
    sets = [(b, s, f"p{i}") for b in campaigns for s in ("s1", "s2", "s3") for i in rng.sample(range(12), 5)]
    brands = [(f"p{i}", f"b{i % 4}") for i in range(11)]
    seen = [(day + rng.randint(0, 25) * step, b, *campaigns[b], rng.choice(["c1", "c2"]), "Web", f"x{k}", f"{k}", rng.choice(["s1", "s2"])) for k in range(8) for b in campaigns for _ in range(2)]
    seen = sorted(set(seen))
    controls = [(b, *campaigns[b], f"x{k}", f"{k}") for k in range(8, 16) for b in campaigns]
    txns = [("Online Order", datetime.datetime(2024, 3, 1) + rng.randint(0, 35) * step, f"{rng.randint(0, 17)}", f"p{a}", f"b{a % 4}", f"k{i % 40}", 1.5) for i in range(200) for a in [rng.randint(0, 11)]]
    txns += txns[:5]  # repeated lines
    e = spark.createDataFrame(seen, "date date, booking_id string, campaign_start_date date, campaign_end_date date, ci_id string, media_type string, shopper_id string, crn string, sku_set string")
    c = spark.createDataFrame(controls, "booking_id string, campaign_start_date date, campaign_end_date date, shopper_id string, crn string")
    t = spark.createDataFrame(txns, "order_context string, start_txn_time timestamp, shopper_id string, article string, brand string, basket_key string, amount double")
    s = spark.createDataFrame(sets, "booking_id string, sku_set string, article string")
    m = spark.createDataFrame(brands, "article string, brand string")
    for level in ("sku", "brand"):
        every = X.conversions(X.union_cohorts(e, c), t, s, level, m).collect()
        want = {}
        for r in every:
            k = (r.booking_id, r.exposure_context, r.exposure_crn, r.converted_crn, r.start_txn_time, r.basket_key, r.article, r.amount)
            n, latest, missing = want.get(k, (0, None, 0))
            want[k] = (n + 1, max(filter(None, (latest, r.impression_date)), default=None), missing + r.n_unmatched)
        got = X.conversion_lines(e, c, t, s, level, m).collect()
        assert len(got) == len(want)
        for r in got:
            n, latest, missing = want[r.booking_id, r.exposure_context, r.exposure_crn, r.converted_crn, r.start_txn_time, r.basket_key, r.article, r.amount]
            if r.converted_crn is None:
                assert r.n_unmatched == missing
            else:
                assert (r.n_rows, r.last_exposure) == (n, latest)
        for window in ("3 Days", "7 Days"):
            cols = ["booking_id", "exposure_context", "exposure_crn", "converted_crn", "basket_key", "article"]
            a = {tuple(r[c] for c in cols) for r in X.distinct_sales(X.conversion_lines(e, c, t, s, level, m), window).collect()}
            b = {tuple(r[c] for c in cols) for r in X.distinct_sales(X.conversions(X.union_cohorts(e, c), t, s, level, m), window).collect()}
            assert a == b
