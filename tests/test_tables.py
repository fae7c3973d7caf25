"""Readers, writers and the run log."""

import datetime as dt

from counterlift.sources import tables as IO


def test_keyed_replace_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("A", 1), ("B", 2)], "campaign_id string, v int")
    IO.replace_keyed(first, path)
    again = spark.createDataFrame([("A", 9)], "campaign_id string, v int")
    IO.replace_keyed(again, path)
    got = IO.replace_keyed(again, path)
    assert sorted(map(tuple, got.select("campaign_id", "v").collect())) == [("A", 9), ("B", 2)]


def test_pairs_csv(spark, tmp_path):
    path = str(tmp_path / "pairs.csv")
    with open(path, "w") as f:
        f.write("study_id,test_store,control_store,abs_perc_diff\nS,1,2,0.5\nS,3,4,0.25\n")
    pairs = IO.read_pairs_csv(spark, path)
    assert pairs.columns == ["test_store", "control_store", "abs_perc_diff"]
    out = str(tmp_path / "out")
    IO.write_pairs_csv(pairs, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2 and back.columns == pairs.columns


def test_keyed_table_replaces_deletes_and_survives_a_lost_writer(spark, tmp_path):
    path = str(tmp_path / "keyed")
    shape = "campaign_id string, x long"
    frame = lambda *rows: spark.createDataFrame(list(rows), shape)
    table = IO.KeyedTable(spark, path, frame(("A", 1)).schema)
    assert table.rows().collect() == []

    def held():
        return sorted(tuple(r) for r in table.rows().collect())

    table.replace(frame(("A", 1), ("A", 2), ("B", 3)))
    table.replace(frame(("B", 4)))
    assert held() == [("A", 1), ("A", 2), ("B", 4)]
    table.replace(frame(("C", 5)), keys=spark.createDataFrame([("A",), ("Z",)], "campaign_id string"))  # A found nothing
    assert held() == [("B", 4), ("C", 5)]
    # a writer that wrote rows, and a manifest that it did not commit
    frame(("B", 9)).selectExpr("x", "'lost' AS _version", "campaign_id").write.mode("append").partitionBy("_version", "campaign_id").parquet(f"{path}/data")
    spark.createDataFrame([("B", "lost")], "campaign_id string, _version string").write.parquet(f"{path}/manifest/99")
    (tmp_path / "keyed" / "manifest" / "99" / "_SUCCESS").unlink()
    assert held() == [("B", 4), ("C", 5)]
    assert table.delete_old() == 2 and held() == [("B", 4), ("C", 5)]
    table.replace(IO.empty_like(frame(("A", 1))), keys=spark.createDataFrame([("B",), ("C",)], "campaign_id string"))
    assert held() == []


def test_zero_sku_campaigns_are_logged(spark):
    t = dt.datetime(2024, 1, 1)
    campaigns = spark.createDataFrame([("A",), ("B",), ("C",), ("B",)], "campaign_id string")
    skus = spark.createDataFrame([("A", "p"), ("B", None)], "campaign_id string, article string")
    log = IO.zero_sku_log(campaigns, skus, t, t + dt.timedelta(seconds=30))
    assert log.schema.simpleString() == IO.log_entry(spark, "x", "1", "k", t, t).schema.simpleString()
    assert sorted((r.campaign_id, r.query_step, r.query_type, r.query_duration_in_seconds) for r in log.collect()) == [
        (c, "1", "Excluded for having zero promoted skus", 30) for c in "BC"]


def test_log_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    t = dt.datetime(2024, 1, 1)
    IO.append(IO.log_entry(spark, "A", "6", "done", t, t + dt.timedelta(seconds=90)), path)
    IO.append(IO.log_entry(spark, "B", "2", "begun", t, t), path)
    log = spark.read.parquet(path)
    assert log.filter("campaign_id = 'A'").first().query_duration_in_minutes == 1.5
    campaigns = spark.createDataFrame([("A",), ("B",), ("C",)], "campaign_id string")
    assert {r.campaign_id for r in IO.unfinished(campaigns, log, "6").collect()} == {"B", "C"}
    assert IO.empty_like(log).count() == 0


def test_date_filter_reaches_the_scan(spark, tmp_path):
    """On a table with a plain date column the campaign span is pushed to the files."""
    from pyspark.sql import functions as F

    from counterlift.operators.store_sales import tag_sales

    path = str(tmp_path / "sales")
    spark.sql("""SELECT 1L AS site, 'a' AS article, date_add(date'2024-01-01', cast(id AS int)) AS txn_date,
        'b' AS basket_key, 1D AS sales_amount, 'x' AS unused FROM range(100)""").write.parquet(path)
    campaigns = spark.sql("SELECT 'A' AS campaign_id, date'2024-02-01' AS media_start_date, date'2024-02-07' AS media_end_date")
    skus = spark.sql("SELECT 'A' AS campaign_id, 'a' AS article")
    df = tag_sales(spark.read.parquet(path), campaigns, skus, F.col("media_start_date"), F.col("media_end_date"))
    out = df.groupBy("campaign_id").agg(F.sum("sales_amount").alias("s"))
    assert out.first().s == 7.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan
    assert "txn_date" in plan.split("PushedFilters")[1].split("]")[0] or "dataFilters" in plan or "DataFilters" in plan


def test_conversions_tag_only_sets_that_cohorts_name(spark):
    """Purchases were tagged with every set of their booking, however few of them the cohorts have."""
    import datetime

    from counterlift.operators.exposure import conversions

    day, at = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 2)
    cohorts = spark.createDataFrame([("B", day, day + datetime.timedelta(6), "s0", "1", day, "Exposed", "s0", "Screen")],
                                    "booking_id string, campaign_start_date date, campaign_end_date date, sku_set string, crn string, date date, cohort string, ci_id string, media_type string")
    txns = spark.createDataFrame([("In", at, day, "1", "x", "br", "k", 2.0)], "order_context string, start_txn_time timestamp_ntz, start_txn_date date, shopper_id string, article string, brand string, basket_key string, amount double")
    sets = spark.createDataFrame([("B", f"s{i}", a) for i in range(50) for a in "xy"], "booking_id string, sku_set string, article string")
    got = conversions(cohorts, txns, sets)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.exposure_crn, r.article or "", r.n_unmatched) for r in got.collect()) == [("1", "", 1), ("1", "x", 0)]
