"""Calendar, NULL and string rules on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from counterlift.functions import (
    greatest_strict,
    labelled_bucket,
    local_date,
    packed_part,
    pair_diff,
    prefix_before_dash,
    safe_divide,
    trailing_digit,
    week_diff_sunday,
    week_start,
    within_dates_inclusive,
)
from counterlift.operators.exposure import identity_asof
from counterlift.operators.stock import hourly_stock, trading_hours

D = dt.date


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def day(s):
    return F.lit(s).cast("date")


def test_week_starts(spark):
    d = day("2024-09-17")
    row = one(spark, week_start(d), week_start(d, "MON"), week_start(d, "WED"), week_start(day("2024-09-15")))
    assert list(row) == [D(2024, 9, 15), D(2024, 9, 16), D(2024, 9, 11), D(2024, 9, 15)]


def test_week_difference_counts_sundays(spark):
    row = one(spark, week_diff_sunday(day("2024-09-22"), day("2024-09-21")), week_diff_sunday(day("2024-09-28"), day("2024-09-22")))
    assert list(row) == [1, 0]


def test_zero_division_and_strict_greatest(spark):
    null = F.lit(None).cast("double")
    row = one(spark, safe_divide(F.lit(1), F.lit(0)), greatest_strict(F.lit(1.0), null), greatest_strict(F.lit(1.0), F.lit(2.0)))
    assert list(row) == [None, None, 2.0]


def test_midnight_after_the_end_still_counts(spark):
    def inside(ts):
        return within_dates_inclusive(F.lit(ts).cast("timestamp_ntz"), day("2024-01-01"), day("2024-01-07"))

    row = one(spark, inside("2024-01-08 00:00:00"), inside("2024-01-08 00:00:01"), inside("2024-01-01 00:00:00"))
    assert list(row) == [True, False, True]


def test_strings(spark):
    row = one(
        spark, packed_part(F.lit("BK01:web:x:L0"), 3), packed_part(F.lit("BK01"), 3), prefix_before_dash(F.lit("12-EA")),
        prefix_before_dash(F.lit("12")), trailing_digit(F.lit("Week 12")),
    )
    assert list(row) == ["L0", None, "12", None, 2]


def test_local_date(spark):
    assert one(spark, local_date(F.lit("2024-01-01 13:30:00").cast("timestamp_ntz")))[0] == D(2024, 1, 2)


def test_pair_differences(spark):
    a, b = F.lit(2.0), F.lit(-1.0)
    row = one(spark, *[pair_diff(a, b, m) for m in ("control_abs", "sum_abs", "half_sum_abs", "greatest", "sign_flip")])
    assert [round(v, 9) for v in row] == [3.0, 1.0, 2.0, 150.0, 3.0]
    zero = F.lit(0.0)
    assert one(spark, pair_diff(zero, zero, "greatest"))[0] == 0.0


def test_buckets(spark):
    row = one(spark, *[labelled_bucket(F.lit(float(v)), [1, 5])["bucket"] for v in (0, 1, 5)])
    assert list(row) == ["< 1", "1 - 5", ">= 5"]


def test_identity_windows_do_not_duplicate_hits(spark):
    hits = spark.sql("""SELECT * FROM VALUES (1, 'v', timestamp_ntz'2024-01-05 00:00:00'), (2, 'v', timestamp_ntz'2024-01-10 00:00:00'),
        (3, 'v', timestamp_ntz'2024-02-10 00:00:00'), (4, 'w', timestamp_ntz'2024-01-05 00:00:00') AS t(id, visitor_id, date_time)""")
    maps = spark.sql("""SELECT * FROM VALUES ('v', 'a', timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-12 00:00:00'),
        ('v', 'b', timestamp_ntz'2024-01-09 00:00:00', timestamp_ntz'2024-01-31 00:00:00')
        AS t(visitor_id, crn, effective_time, expiry_time)""")
    got = {r.id: r.crn for r in identity_asof(hits, maps).collect()}
    assert got == {1: "a", 2: "b", 3: None, 4: None}


def test_stock_is_carried_forward(spark):
    stock = spark.sql("""SELECT * FROM VALUES ('a', 1L, date'2024-01-01', 3, 5.0D), ('a', 1L, date'2024-01-01', 20, 0.0D),
        ('a', 1L, date'2024-01-03', 2, 7.0D) AS t(article, site, soh_date, soh_hour, soh)""")
    rows = hourly_stock(stock).orderBy("soh_date", "hour").collect()
    assert len(rows) == 48
    levels = [r.stock_level for r in rows]
    assert levels[:3] == [None] * 3 and levels[3:20] == [5.0] * 17 and levels[20:26] == [0.0] * 6 and levels[26] == 7.0


def test_trading_hours_round_up_and_midnight(spark):
    cols = {}
    for d in ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]:
        cols[f"{d}_open"], cols[f"{d}_close"] = "070000", "213000"
    cols["Sunday_close"] = "240000"
    rows = {r.weekday: r for r in trading_hours(spark.createDataFrame([{"site": 1, **cols}])).collect()}
    assert (rows["Monday"].opening_hour, rows["Monday"].closing_hour) == (7, 22)
    assert rows["Sunday"].closing_hour == 0
