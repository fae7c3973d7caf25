"""Relational building blocks on their own: filters, joins, aggregates, windows, sets, I/O."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.catalog import matching_queries as mq
from counterlift.catalog import search_queries as sq
from counterlift.catalog import store_queries as q
from counterlift.catalog.registry import query
from counterlift.functions import (
    greatest_strict,
    local_date,
    packed_part,
    prefix_before_dash,
    random_key,
    safe_divide,
    week_diff_sunday,
    week_start,
    weekday_name,
)
from counterlift.operators import design as D
from counterlift.operators import quantiles as Q
from counterlift.session import shared_folder
from counterlift.sources import tables as IO

# ---- sources and sinks ---------------------------------------------------


def _fresh(r, name):
    return f"{shared_folder(r.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("pairs_csv_round_trip", "SELECT test_store, control_store, abs_perc_diff FROM area_nearest", ratio="abs_perc_diff")
def _(r):
    path = _fresh(r, "pairs")
    full = mq.area_nearest(r).select(F.col("campaign_id").alias("study_id"), "test_store", "control_store", "abs_perc_diff")
    full.write.option("header", True).csv(path)
    return IO.read_pairs_csv(r.spark, path)


@query("keyed_replace", """
SELECT campaign_id, site, CASE WHEN campaign_id < 'BK06' THEN 2 * total_sales_campaign_period
  ELSE total_sales_campaign_period END AS total_sales_campaign_period FROM during WHERE campaign_id NOT IN ('BK03', 'BK08')""",
       money="total_sales_campaign_period")
def _(r):
    path = _fresh(r, "during")
    first = q.during(r).select("campaign_id", "site", "total_sales_campaign_period")
    IO.replace_keyed(first, path)
    again = first.filter("campaign_id < 'BK06'").withColumn(
        "total_sales_campaign_period", F.col("total_sales_campaign_period") * 2)
    IO.replace_keyed(again, path)
    IO.replace_keyed(again, path)  # a second run leaves one copy
    keys = r.campaigns.select("campaign_id").filter("campaign_id IN ('BK03', 'BK08')")
    return IO.replace_keyed(IO.empty_like(first), path, keys=keys)  # a run that finds nothing leaves none


@query("zero_sku_log", """
SELECT DISTINCT campaign_id, '1' AS query_step, 'Excluded for having zero promoted skus' AS query_type,
       CAST(90 AS BIGINT) AS query_duration_in_seconds, 1.5 AS query_duration_in_minutes
FROM campaigns c WHERE NOT EXISTS (SELECT 1 FROM campaign_skus s WHERE s.campaign_id = c.campaign_id AND s.article LIKE '%37')""",
       ratio="query_duration_in_minutes")
def _(r):
    start = dt.datetime(2024, 1, 1)
    path = _fresh(r, "log")
    IO.append(IO.zero_sku_log(r.campaigns, r.campaign_skus.filter("article LIKE '%37'"), start, start + dt.timedelta(seconds=90)), path)
    return r.spark.read.parquet(path).drop("query_start_time", "query_end_time")


@query("create_and_append", """
SELECT campaign_id, site FROM during UNION ALL SELECT campaign_id, site FROM during WHERE site % 2 = 0""")
def _(r):
    path = _fresh(r, "appended")
    rows = q.during(r).select("campaign_id", "site")
    IO.create_or_replace(IO.empty_like(rows).unionByName(rows), path)
    IO.append(rows.filter("site % 2 = 0"), path)
    return r.spark.read.schema(rows.schema).parquet(path)


@query("unfinished_campaigns", """
SELECT campaign_id, media_start_date FROM campaigns
WHERE campaign_id NOT IN (SELECT campaign_id FROM run_log WHERE query_step = '6')
  AND date_trunc('month', media_start_date) <> DATE '2024-01-01'""")
def _(r):
    left = IO.unfinished(r.campaigns, sq.run_log(r), "6")
    return left.filter(F.trunc("media_start_date", "month") != F.lit("2024-01-01").cast("date")).select(
        "campaign_id", "media_start_date")


@query("run_progress", """
SELECT d.*, n - n_done AS n_remaining, avg_minutes * (n - n_done) / 60 AS hours_remaining
FROM (SELECT count(DISTINCT campaign_id) AS n_done, avg(minutes) AS avg_minutes, sum(minutes) / 60 AS hours_elapsed
      FROM run_log WHERE query_step = '7') d CROSS JOIN (SELECT count(DISTINCT campaign_id) AS n FROM campaigns) c""",
       ratio="avg_minutes hours_elapsed hours_remaining")
def _(r):
    return IO.run_progress(sq.run_log(r), r.campaigns, "7")


@query("run_log_summary", """
SELECT campaign_id, max(query_step) AS latest_step, max(minutes) AS minutes FROM run_log GROUP BY 1""", ratio="minutes")
def _(r):
    return IO.log_summary(sq.run_log(r))


# ---- projections and predicates ------------------------------------------


@query("predicate_filter", """
SELECT o_orderkey, o_custkey, 'checked' AS tag FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_totalprice BETWEEN 1000 AND 200000
  AND (lower(o_orderpriority) LIKE '%urgent%' OR o_orderpriority NOT LIKE '%HIGH%') AND o_custkey IS NOT NULL""")
def _(r):
    p = F.col("o_orderpriority")
    return r.table("orders").filter(
        F.col("o_orderstatus").isin("F", "O") & ~p.isin("5-LOW") & F.col("o_totalprice").between(1000, 200000)
        & (F.lower(p).like("%urgent%") | ~p.like("%HIGH%")) & F.col("o_custkey").isNotNull()
    ).select("o_orderkey", "o_custkey", F.lit("checked").alias("tag"))


@query("first_match_case", """
SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority LIKE '1%' THEN 'urgent'
            WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def _(r):
    t = F.col("o_totalprice")
    kind = (F.when(t < 50000, "small").when(F.col("o_orderpriority").like("1%"), "urgent")
            .when(t < 200000, "middle").otherwise("large"))
    return r.table("orders").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("all_columns_except", """
SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")
def _(r):
    o = r.table("orders")
    mean = o.select(F.avg("o_totalprice")).scalar()
    return o.filter(F.col("o_totalprice") > mean).drop("o_totalprice", "o_orderdate")


@query("quality_filter", """
SELECT shopper_id, count(*) AS n FROM transactions WHERE length(shopper_id) > 2 AND order_context <> 'Online Order'
GROUP BY 1""")
def _(r):
    return r.transactions.filter((F.length("shopper_id") > 2) & (F.col("order_context") != "Online Order")).groupBy(
        "shopper_id").agg(F.count(F.lit(1)).alias("n"))


@query("top_pairs", """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM area_nearest
ORDER BY abs_perc_diff, campaign_id, test_store, control_store LIMIT 160""", ratio="abs_perc_diff")
def _(r):
    order = ["abs_perc_diff", "campaign_id", "test_store", "control_store"]
    return mq.area_nearest(r).orderBy(*order).limit(160)


@query("date_semantics", """
SELECT DISTINCT d, d - CAST(dayofweek(d) AS INTEGER) AS sunday_week, CAST(date_trunc('week', d) AS DATE) AS monday_week,
       d - CAST((dayofweek(d) + 4) % 7 AS INTEGER) AS wednesday_week, CAST(date_trunc('month', d) AS DATE) AS month_start,
       dayname(d) AS day_name, d + 7 AS next_week, CAST(d + INTERVAL 1 MONTH AS DATE) AS next_month,
       CAST(date_diff('day', DATE '2023-09-03', d - CAST(dayofweek(d) AS INTEGER)) / 7 AS BIGINT) AS sundays_crossed
FROM (SELECT txn_date AS d FROM sales) x""")
def _(r):
    d = F.col("d")
    return r.sales.select(F.col("txn_date").alias("d")).distinct().select(
        d, week_start(d).alias("sunday_week"), week_start(d, "MON").alias("monday_week"),
        week_start(d, "WED").alias("wednesday_week"), F.trunc(d, "month").alias("month_start"),
        weekday_name(d).alias("day_name"), F.date_add(d, 7).alias("next_week"), F.add_months(d, 1).alias("next_month"),
        week_diff_sunday(d, F.lit("2023-09-03").cast("date")).alias("sundays_crossed"))


@query("string_semantics", """
SELECT event_id, string_split(packed_key, ':')[1] AS part0, string_split(packed_key, ':')[4] AS part3,
       regexp_extract(search_term, '^([^|]*)', 1) AS before_bar, regexp_replace(search_term, '[^a-zA-Z0-9 &-''@]', '', 'g') AS cleaned,
       upper(replace(page_name, ':', '/')) AS path, sha256(visitor_id) AS hashed,
       CAST(CAST(date_time AS TIMESTAMP) + INTERVAL 11 HOUR AS DATE) AS sydney_date,
       CASE WHEN strpos(page_name, '-') > 0 THEN string_split(page_name, '-')[1] END AS prefix
FROM hits""")
def _(r):
    return r.hits.select(
        "event_id", packed_part("packed_key", 0).alias("part0"), packed_part("packed_key", 3).alias("part3"),
        F.regexp_extract("search_term", r"^([^|]*)", 1).alias("before_bar"),
        F.regexp_replace("search_term", r"[^a-zA-Z0-9 &-'@]", "").alias("cleaned"),
        F.upper(F.replace("page_name", F.lit(":"), F.lit("/"))).alias("path"),
        F.sha2(F.col("visitor_id"), 256).alias("hashed"), local_date("date_time").alias("sydney_date"),
        prefix_before_dash("page_name").alias("prefix"))


@query("null_semantics", """
SELECT campaign_id, site, sales_amount / nullif(weeks_count - 8, 0) AS divided,
       CASE WHEN stddev_sales_amount IS NULL OR sales_amount IS NULL THEN NULL
            ELSE greatest(stddev_sales_amount, sales_amount) END AS strict_greatest,
       coalesce(stddev_sales_amount, 0) AS filled, nullif(weeks_count, 8) AS not_eight, TRY_CAST('x1' AS BIGINT) AS not_a_number
FROM baseline""", money="divided strict_greatest filled")
def _(r):
    return q.baseline(r).select(
        "campaign_id", "site", safe_divide("sales_amount", F.col("weeks_count") - 8).alias("divided"),
        greatest_strict("stddev_sales_amount", "sales_amount").alias("strict_greatest"),
        F.coalesce("stddev_sales_amount", F.lit(0.0)).alias("filled"),
        F.nullif("weeks_count", F.lit(8)).alias("not_eight"), F.lit("x1").try_cast("long").alias("not_a_number"))


# ---- joins ---------------------------------------------------------------


@query("left_join_keeps_rows", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY 1""")
def _(r):
    c, o = r.table("customer"), r.table("orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(r):
    big = r.table("orders").filter("o_totalprice > 400000 AND o_custkey IS NOT NULL")
    c = r.table("customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_anti").select("c_custkey")


@query("semi_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(r):
    big = r.table("orders").filter("o_totalprice > 400000")
    c = r.table("customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query("date_range_join", """
SELECT c.campaign_id, count(*) AS n_lines, sum(s.sales_amount) AS sales FROM campaigns c
JOIN store_sales s ON s.txn_date BETWEEN c.media_start_date AND c.media_end_date GROUP BY 1""", money="sales")
def _(r):
    # no equality key: sum per day first, then meet the unrolled campaign days
    from counterlift.operators.store_sales import in_store
    daily = in_store(r.sales).groupBy("txn_date").agg(F.count(F.lit(1)).alias("n"), F.sum("sales_amount").alias("s"))
    days = r.campaigns.select("campaign_id", F.explode(F.sequence("media_start_date", "media_end_date")).alias("txn_date"))
    return daily.join(days, "txn_date").groupBy("campaign_id").agg(
        F.sum("n").alias("n_lines"), F.sum("s").alias("sales"))


@query("set_overlap", """
SELECT a.campaign_id, a.line_name, list_has_any(a.subcats, ['ECONOMY', 'SMALL']) AS overlaps FROM comp_info a""")
def _(r):
    from counterlift.catalog.campaign_queries import info
    wanted = F.array(F.lit("ECONOMY"), F.lit("SMALL"))
    return info(r).select("campaign_id", "line_name", F.arrays_overlap("subcats", wanted).alias("overlaps"))


@query("cohort_pivot", """
SELECT campaign_id, avg(CASE WHEN test_or_control = 'Test' THEN total_sales_campaign_period END) AS test_sales,
       avg(CASE WHEN test_or_control = 'Control' THEN total_sales_campaign_period END) AS control_sales
FROM during GROUP BY 1""", money="test_sales control_sales")
def _(r):
    wide = q.during(r).groupBy("campaign_id").pivot("test_or_control", ["Test", "Control"]).agg(
        F.avg("total_sales_campaign_period"))
    return wide.withColumnsRenamed({"Test": "test_sales", "Control": "control_sales"})


# ---- aggregates and windows ----------------------------------------------


@query("conditional_aggregates", """
SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned_orders,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned_quantity,
       sum(l_quantity) / count(DISTINCT l_orderkey) AS quantity_per_order FROM lineitem GROUP BY 1""",
       ratio="returned_quantity quantity_per_order")
def _(r):
    back = F.col("l_returnflag") == "R"
    return r.table("lineitem").groupBy("l_suppkey").agg(
        F.count_distinct(F.when(back, F.col("l_orderkey"))).alias("returned_orders"),
        F.sum(F.when(back, F.col("l_quantity")).otherwise(0.0)).alias("returned_quantity"),
        safe_divide(F.sum("l_quantity"), F.count_distinct("l_orderkey")).alias("quantity_per_order"))


@query("percentile_summary", """
SELECT campaign_id, quantile_cont(total_sales_campaign_period, 0.5) AS median,
       quantile_cont(total_sales_campaign_period, 0.25) AS q25, quantile_cont(total_sales_campaign_period, 0.75) AS q75
FROM during GROUP BY 1""", money="median q25 q75")
def _(r):
    return Q.quantile_list(q.during(r), ["campaign_id"], "total_sales_campaign_period", {"median": 0.5, "q25": 0.25, "q75": 0.75})


@query("line_price_quantiles", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50,
       quantile_cont(l_extendedprice, 0.999) AS p999 FROM lineitem GROUP BY 1""", money="p01 p50 p999")
def _(r):
    # groups as large as these are narrowed in rounds
    return Q.quantile_list(r.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p999": 0.999}, few=1000)


@query("category_codes", """
SELECT o_orderkey, CASE WHEN o_clerk IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY o_clerk NULLS LAST) - 1 END AS code FROM (
  SELECT o_orderkey, 'c' || CAST(o_custkey * 7919 % 1009 AS VARCHAR) AS o_clerk FROM orders) x""")
def _(r):
    clerks = r.table("orders").select("o_orderkey", F.concat(F.lit("c"), (F.col("o_custkey") * 7919 % 1009).cast("string")).alias("clerk"))
    return Q.category_codes(clerks, "clerk").select("o_orderkey", "code")


@query("pair_label_numbers", """
SELECT o_orderkey, label, CAST(CAST(regexp_extract(label, '(\\d+\\.?\\d*)_(\\d+\\.?\\d*)', 1) AS DOUBLE) AS BIGINT) AS test_store,
       CAST(CAST(regexp_extract(label, '(\\d+\\.?\\d*)_(\\d+\\.?\\d*)', 2) AS DOUBLE) AS BIGINT) AS control_store
FROM (SELECT o_orderkey, 'p' || CAST(o_orderkey AS VARCHAR) || '.0_' || CAST(o_custkey AS VARCHAR) AS label FROM orders) x""")
def _(r):
    labels = r.table("orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_orderkey").cast("string"), F.lit(".0_"), F.col("o_custkey").cast("string")).alias("label"))
    test, control = Q.number_pair("label")
    return labels.select("o_orderkey", "label", test.alias("test_store"), control.alias("control_store"))


@query("case_in_order_by", """
SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '5-LOW' THEN 1
         WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 3 END, o_orderpriority) AS position
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) x""")
def _(r):
    groups = r.table("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    place = F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    # the report's few rows in the order of the cases; the position makes that order visible
    return groups.orderBy(place, "o_orderpriority").withColumn("position", F.row_number().over(W.orderBy(place, "o_orderpriority")))


@query("ordered_distinct_array", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities,
       len(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS n_chars FROM orders GROUP BY 1""")
def _(r):
    # five priorities exist, so the set stays small whatever the group size
    arr = F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")
    return r.table("orders").groupBy("o_custkey").agg(arr.alias("priorities")).withColumn(
        "n_chars", F.length("priorities").cast("long"))


@query("mean_written_back", """
SELECT campaign_id, site, total_sales_campaign_period - avg(total_sales_campaign_period) OVER (PARTITION BY campaign_id)
  AS above_mean FROM during""", money="above_mean")
def _(r):
    # mean by aggregate and join: a campaign's rows never have to sit in one task
    d = q.during(r)
    mean = d.groupBy("campaign_id").agg(F.avg("total_sales_campaign_period").alias("m"))
    return d.join(mean, "campaign_id").select(
        "campaign_id", "site", (F.col("total_sales_campaign_period") - F.col("m")).alias("above_mean"))


@query("distinct_in_delimited_string", """
SELECT booking_number, line_name, array_to_string(list_sort(list_distinct(list_transform(
  string_split(quoteline_sku, ','), lambda x: substr(x, 1, 1)))), ',') AS first_digits FROM bookings""")
def _(r):
    digits = F.transform(F.split("quoteline_sku", ","), lambda x: F.substring(x, 1, 1))
    return r.bookings.select("booking_number", "line_name", F.array_join(F.array_sort(F.array_distinct(digits)), ",").alias("first_digits"))


@query("top_one_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) x WHERE n = 1""")
def _(r):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")
    return r.table("orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.*")


@query("lag_and_running_mean", """
SELECT o_orderkey, CAST(date_diff('day', lag(d) OVER w, d) AS BIGINT) AS days_since,
       avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY d RANGE UNBOUNDED PRECEDING) AS running_mean,
       min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY d) AS lowest_so_far,
       max(d) OVER (PARTITION BY o_custkey) AS last_order
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) x WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)""",
       money="running_mean lowest_so_far")
def _(r):
    o = r.table("orders").withColumn("d", F.col("o_orderdate").cast("date"))
    in_order = W.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    so_far = W.partitionBy("o_custkey").orderBy("d").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("o_custkey")
    return o.select(
        "o_orderkey", F.datediff("d", F.lag("d").over(in_order)).alias("days_since"),
        F.avg("o_totalprice").over(so_far).alias("running_mean"), F.min("o_totalprice").over(so_far).alias("lowest_so_far"),
        F.max("d").over(whole).alias("last_order"))


@query("global_row_number", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|global')) AS n FROM orders""")
def _(r):
    keyed = r.table("orders").select("o_orderkey", random_key("global", "o_orderkey").alias("h"))
    return D.global_row_number(keyed, "h", "n").select("o_orderkey", "n")


# ---- set operations ------------------------------------------------------


@query("tagged_union", """
SELECT 'order' AS tag, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS DATE) AS day FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT 'line', l_orderkey, NULL, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity >= 50""")
def _(r):
    a = r.table("orders").filter("o_totalprice > 450000").select(
        F.lit("order").alias("tag"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = r.table("lineitem").filter("l_quantity >= 50").select(
        F.lit("line").alias("tag"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").alias("day"))
    return a.unionByName(b, allowMissingColumns=True)


@query("difference_on_all_columns", """
SELECT campaign_id, article FROM campaign_skus c WHERE NOT EXISTS (SELECT 1 FROM asset_skus a
  WHERE split_part(a.campaign_id, '_', 1) = c.campaign_id AND a.article = c.article)""")
def _(r):
    from counterlift.catalog.campaign_queries import assets
    from counterlift.operators.campaigns import campaign_skus
    listed = campaign_skus(assets(r)).select(F.substring_index("campaign_id", "_", 1).alias("campaign_id"), "article")
    return r.campaign_skus.join(listed, ["campaign_id", "article"], "left_anti")
