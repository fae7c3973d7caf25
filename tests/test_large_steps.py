"""Steps whose rows or task memory must not grow by a factor: plans, and results against plain loops."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from counterlift.operators import exposure as X
from counterlift.operators import store_sales as S

D = dt.date
START = D(2024, 1, 7)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sales_rows():
    rows = []
    for i in range(400):
        day = START + dt.timedelta(days=(i * 7) % 90 - 60)
        basket = None if i % 11 == 0 else f"b{i % 37}"
        site = None if i % 13 == 0 else i % 3
        rows.append((site, f"a{i % 5}", day, basket, float(i), None if i % 17 == 0 else float(i % 4), "In Store", 1005))
    return rows


def frames(spark):
    sales = spark.createDataFrame(
        sales_rows(), "site long, article string, txn_date date, basket_key string, sales_amount double, units double, channel string, sales_org int")
    end = START + dt.timedelta(days=27)
    campaigns = spark.createDataFrame(
        [("A", START, end, START, end)],
        "campaign_id string, media_start_date date, media_end_date date, campaign_start_date date, campaign_end_date date")
    skus = spark.createDataFrame([("A", f"a{i}") for i in range(4)], "campaign_id string, article string")
    return sales, campaigns, skus


def test_period_sales_does_not_repeat_lines_per_window(spark):
    got = S.period_sales(*frames(spark), S.LONG_WINDOWS, with_all_baskets=False)
    assert "Expand" not in optimized(got)
    windows = {"history": (D(2023, 7, 7), START - dt.timedelta(1)), "campaign": (START, START + dt.timedelta(7)),
               "post": (START + dt.timedelta(7), START + dt.timedelta(28))}
    want = defaultdict(lambda: {n: (set(), [], set()) for n in windows})
    for site, article, day, basket, amount, *_ in sales_rows():
        if article == "a4" or day > windows["post"][1]:
            continue
        for n, (lo, hi) in windows.items():
            days, amounts, baskets = want[site][n]
            if lo <= day <= hi:
                days.add(day)
                amounts.append(amount)
                baskets.update([basket] if basket else [])
    rows = {r.site: r for r in got.collect()}
    assert rows.keys() == want.keys()
    for site, parts in want.items():
        for n, (days, amounts, baskets) in parts.items():
            assert rows[site][f"n_days_{n}"] == len(days) and rows[site][f"baskets_{n}"] == len(baskets)
            assert rows[site][f"sales_{n}"] == (sum(amounts) if amounts else None)


def test_price_per_unit_marks_weeks_in_one_aggregate(spark):
    sales, campaigns, skus = frames(spark)
    old = sales.withColumn("txn_date", F.date_sub("txn_date", 560))
    for lookback in (13, 100):  # 100 weeks need two words of bits
        got = S.price_per_unit(sales.unionByName(old), campaigns, skus, lookback_weeks=lookback)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate(keys=[campaign_id") == 2
        weeks = defaultdict(set)
        for site, article, day, *_ in sales_rows():
            for d in (day, day - dt.timedelta(560)):
                if START - dt.timedelta(7 * lookback) <= d <= START - dt.timedelta(7):
                    weeks[site, article].add(d - dt.timedelta((d.weekday() + 1) % 7))
        rows = {(r.site, r.article): r.history_weeks for r in got.collect()}
        assert rows and all(rows[k] == len(weeks[k]) for k in rows)


def test_purchases_are_cut_to_the_cohorts_before_the_lines_are_joined(spark, tmp_path):
    spark.createDataFrame([(i, f"c{i % 7}") for i in range(50)], "o long, shopper_id string").write.parquet(f"{tmp_path}/orders")
    spark.createDataFrame([(i % 50, i) for i in range(300)], "o long, line int").write.parquet(f"{tmp_path}/lines")
    txns = spark.read.parquet(f"{tmp_path}/lines").join(spark.read.parquet(f"{tmp_path}/orders"), "o")
    people = spark.createDataFrame([("c1",), ("c1",), ("c4",), ("x",)], "crn string")
    got = X.purchases_of(people, txns)
    plan = optimized(got)
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
    assert sorted(r.line for r in got.collect()) == [i for i in range(300) if (i % 50) % 7 in (1, 4)]


def test_exposures_of_a_customer_lie_together(spark):
    rows = [(dt.datetime(2024, 1, 1 + i % 20), f"BK{i % 4}", START, START, "L", "m", "S1", f"{i % 30}", "L") for i in range(2000)]
    hits = spark.createDataFrame(rows, "date_time timestamp_ntz, booking_id string, campaign_start_date date, campaign_end_date date, "
                                       "ci_id string, media_type string, shopper_id string, crn string, sku_set string")
    got = X.distinct_exposures(hits)
    assert got.count() == len({(r[0], r[1], r[7]) for r in rows})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
        assert {r.n for r in got.withColumn("p", F.spark_partition_id()).groupBy("crn").agg(F.count_distinct("p").alias("n")).collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
