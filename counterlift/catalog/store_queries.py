"""Store-side queries: baselines, windows, uplift."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.operators import store_sales as S
from counterlift.sources.retail_views import Retail

VIEWS["tagged"] = """
SELECT s.*, c.* FROM sales s JOIN campaign_skus k ON k.article = s.article
JOIN campaigns c ON c.campaign_id = k.campaign_id"""
VIEWS["store_tagged"] = "SELECT * FROM tagged WHERE lower(channel) <> 'online' AND sales_org = 1005"

# Sunday of the week of d
SUN = "txn_date - CAST(dayofweek(txn_date) AS INTEGER)"

VIEWS["weekly"] = f"""
SELECT campaign_id, site, {SUN} AS sales_week, count(DISTINCT basket_key) AS n_transactions,
       sum(sales_amount) AS sales_amount
FROM store_tagged
WHERE txn_date BETWEEN media_start_date - 91 AND media_start_date - 7
GROUP BY 1, 2, 3"""
VIEWS["baseline"] = """
SELECT campaign_id, site, avg(n_transactions) AS mean_transactions, stddev_samp(n_transactions) AS stddev_transactions,
       var_samp(n_transactions) AS variance_transactions, min(n_transactions) AS min_transactions,
       max(n_transactions) AS max_transactions, CAST(sum(n_transactions) AS BIGINT) AS total_transactions,
       stddev_samp(sales_amount) AS stddev_sales_amount, sum(sales_amount) AS sales_amount,
       count(sales_week) AS weeks_count
FROM weekly GROUP BY 1, 2"""
VIEWS["baseline_sales"] = """
SELECT campaign_id, site, avg(sales_amount) AS weekly_avg_sales_amount, stddev_samp(sales_amount) AS stddev_sales_amount,
       count(sales_week) AS weeks_count, stddev_samp(sales_amount) / avg(sales_amount) AS cv
FROM weekly GROUP BY 1, 2"""
VIEWS["during"] = """
SELECT d.*, CASE WHEN t.site IS NOT NULL THEN 'Test' ELSE 'Control' END AS test_or_control
FROM (SELECT campaign_id, media_start_date, media_end_date, site,
             count(DISTINCT txn_date) AS n_days_campaign_period,
             sum(sales_amount) AS total_sales_campaign_period,
             count(DISTINCT basket_key) AS total_baskets_campaign_period
      FROM store_tagged WHERE txn_date BETWEEN media_start_date AND media_end_date GROUP BY 1, 2, 3, 4) d
LEFT JOIN (SELECT DISTINCT campaign_id, site FROM campaign_stores) t
       ON t.campaign_id = d.campaign_id AND t.site = d.site"""
VIEWS["pre_during"] = """
SELECT d.*, p.total_sales_pre_period, p.n_days_pre_period, p.total_baskets_pre_period,
       b.* EXCLUDE (campaign_id, site)
FROM during d
JOIN (SELECT d.campaign_id, d.site, sum(s.sales_amount) AS total_sales_pre_period,
             count(DISTINCT s.txn_date) AS n_days_pre_period, count(DISTINCT s.basket_key) AS total_baskets_pre_period
      FROM during d JOIN store_tagged s ON s.campaign_id = d.campaign_id AND s.site = d.site
       AND s.txn_date >= d.media_start_date - CAST(d.n_days_campaign_period AS INTEGER)
       AND s.txn_date < d.media_start_date
      GROUP BY 1, 2) p ON p.campaign_id = d.campaign_id AND p.site = d.site
LEFT JOIN baseline b ON b.campaign_id = d.campaign_id AND b.site = d.site"""
VIEWS["uplifted"] = """
SELECT *, total_sales_campaign_period / nullif(total_sales_pre_period, 0) - 1 AS perc_sales_uplift,
       total_sales_campaign_period - total_sales_pre_period AS raw_sales_uplift
FROM pre_during"""

_WINDOWS = {
    "pre": ("campaign_start_date - 7", "campaign_start_date - 1"),
    "campaign": ("campaign_start_date", "campaign_start_date + 6"),
    "post": ("campaign_end_date + 1", "campaign_end_date + 7"),
}


def _period_sql(windows, source="tagged"):
    cols, both = [], []
    for n, (lo, hi) in windows.items():
        hit = f"txn_date BETWEEN {lo} AND {hi}"
        both.append(f"({hit})")
        cols.append(
            f"count(DISTINCT CASE WHEN {hit} THEN txn_date END) AS n_days_{n}, "
            f"sum(CASE WHEN {hit} THEN sales_amount END) AS sales_{n}, "
            f"count(DISTINCT CASE WHEN {hit} THEN basket_key END) AS baskets_{n}"
        )
    # rows between the first and the last window count as present
    first, last = windows and (
        f"least({', '.join(lo for lo, _ in windows.values())})",
        f"greatest({', '.join(hi for _, hi in windows.values())})",
    )
    return (
        f"SELECT campaign_id, site, {', '.join(cols)} FROM {source} "
        f"WHERE txn_date BETWEEN {first} AND {last} GROUP BY 1, 2"
    )


VIEWS["all_baskets"] = (
    "SELECT w.campaign_id, s.site, "
    + ", ".join(
        f"count(DISTINCT CASE WHEN txn_date BETWEEN {lo} AND {hi} THEN basket_key END) AS all_baskets_{n}"
        for n, (lo, hi) in _WINDOWS.items()
    )
    + " FROM campaigns w JOIN sales s ON s.txn_date BETWEEN w.campaign_start_date - 7 AND w.campaign_end_date + 7"
    " GROUP BY 1, 2"
)
VIEWS["periods"] = (
    "SELECT p.*, nullif(a.all_baskets_pre, 0) AS all_baskets_pre, nullif(a.all_baskets_campaign, 0) AS all_baskets_campaign,"
    " nullif(a.all_baskets_post, 0) AS all_baskets_post FROM ("
    + _period_sql(_WINDOWS)
    + ") p LEFT JOIN all_baskets a ON a.campaign_id = p.campaign_id AND a.site = p.site"
)
VIEWS["panel"] = (
    "SELECT *, "
    + ", ".join(
        f"sales_{n} / 7 AS daily_sales_{n}, baskets_{n} / 7 AS daily_baskets_{n}, "
        f"baskets_{n} / nullif(all_baskets_{n}, 0) AS basket_share_{n}"
        for n in _WINDOWS
    )
    + ", sales_campaign / nullif(sales_pre, 0) - 1 AS perc_change_in_sales,"
    " (baskets_campaign / nullif(all_baskets_campaign, 0)) / nullif(baskets_pre / nullif(all_baskets_pre, 0), 0) - 1"
    " AS perc_change_in_share FROM periods WHERE n_days_pre >= 1 AND n_days_campaign >= 1"
)

BASE_MONEY = "stddev_sales_amount sales_amount"
BASE_RATIO = "mean_transactions stddev_transactions variance_transactions"


def weekly(r: Retail):
    return S.weekly_store_sales(r.sales, r.campaigns, r.campaign_skus)


def baseline(r: Retail):
    return r.stage("baseline", lambda: S.baseline_stats(weekly(r)))


def during(r: Retail):
    return r.stage(
        "during", lambda: S.campaign_sales(r.sales, r.campaigns, r.campaign_skus, r.campaign_stores))


def pre_during(r: Retail):
    return r.stage(
        "pre_during",
        lambda: S.pre_vs_during(during(r), r.sales, r.campaigns, r.campaign_skus, baseline(r)))


def uplifted(r: Retail):
    return S.uplift(pre_during(r))


def periods(r: Retail):
    return S.period_sales(r.sales, r.campaigns, r.campaign_skus)


def panel(r: Retail):
    return S.period_panel(periods(r), full_days=1)


@query("channel_org_filter", "SELECT site, count(*) AS n_lines FROM store_sales GROUP BY 1")
def _(r):
    return S.in_store(r.sales).groupBy("site").agg(F.count(F.lit(1)).alias("n_lines"))


@query("weekly_store_sales", "SELECT * FROM weekly", money="sales_amount")
def _(r):
    return weekly(r)


@query("weekly_store_sales_wednesday", """
SELECT campaign_id, site, txn_date - CAST((dayofweek(txn_date) + 4) % 7 AS INTEGER) AS sales_week,
       count(DISTINCT basket_key) AS n_transactions, sum(sales_amount) AS sales_amount
FROM store_tagged WHERE txn_date BETWEEN media_start_date - 84 AND media_start_date - 7 GROUP BY 1, 2, 3""",
       money="sales_amount")
def _(r):
    return S.weekly_store_sales(r.sales, r.campaigns, r.campaign_skus, 12, 1, "WED")


@query("baseline_stats", "SELECT * FROM baseline", money=BASE_MONEY, ratio=BASE_RATIO)
def _(r):
    return S.baseline_stats(weekly(r))


@query("baseline_sales_only", "SELECT * FROM baseline_sales",
       money="weekly_avg_sales_amount stddev_sales_amount", ratio="cv")
def _(r):
    return S.baseline_sales(weekly(r))


@query("baseline_sales_by_article", f"""
SELECT campaign_id, site, article, avg(a) AS weekly_avg_sales_amount, stddev_samp(a) AS stddev_sales_amount,
       count(w) AS weeks_count, stddev_samp(a) / nullif(avg(a), 0) AS cv
FROM (SELECT campaign_id, site, article, {SUN} AS w, sum(sales_amount) AS a FROM store_tagged
      WHERE txn_date BETWEEN media_start_date - 91 AND media_start_date - 7 GROUP BY 1, 2, 3, 4) x
GROUP BY 1, 2, 3""", money="weekly_avg_sales_amount stddev_sales_amount", ratio="cv")
def _(r):
    w = S.weekly_store_sales(r.sales, r.campaigns, r.campaign_skus, by=("article",))
    return S.baseline_sales(w, by=("article",))


@query("history_gate", """
SELECT campaign_id, min(share) AS lowest_share FROM (
  SELECT b.campaign_id, t.site IS NOT NULL AS is_test,
         count(CASE WHEN weeks_count >= 7 THEN 1 END) / count(*) AS share
  FROM baseline b LEFT JOIN campaign_stores t ON t.campaign_id = b.campaign_id AND t.site = b.site
  GROUP BY 1, 2) x GROUP BY 1 HAVING min(share) >= 0.4""", ratio="lowest_share")
def _(r):
    return S.history_gate(baseline(r), r.campaign_stores, weeks=7, min_share=0.4)


@query("campaign_sales", "SELECT * FROM during", money="total_sales_campaign_period")
def _(r):
    return S.campaign_sales(r.sales, r.campaigns, r.campaign_skus, r.campaign_stores)


@query("campaign_sales_with_skus", """
SELECT d.*, s.campaign_skus FROM during d JOIN (
  SELECT campaign_id, site, string_agg(DISTINCT article, ',' ORDER BY article) AS campaign_skus
  FROM store_tagged WHERE txn_date BETWEEN media_start_date AND media_end_date GROUP BY 1, 2) s
ON s.campaign_id = d.campaign_id AND s.site = d.site""", money="total_sales_campaign_period")
def _(r):
    out = S.campaign_sales(r.sales, r.campaigns, r.campaign_skus, r.campaign_stores, with_skus=True)
    return out.withColumn("campaign_skus", F.array_join("campaign_skus", ","))


@query("campaign_store_skus", """
SELECT campaign_id, site, article, sum(sales_amount) AS sales_amount, count(DISTINCT basket_key) AS n_baskets
FROM store_tagged WHERE txn_date BETWEEN media_start_date AND media_end_date GROUP BY 1, 2, 3""", money="sales_amount")
def _(r):
    return S.campaign_store_skus(r.sales, r.campaigns, r.campaign_skus)


@query("pre_vs_during", "SELECT * FROM pre_during",
       money=f"total_sales_campaign_period total_sales_pre_period {BASE_MONEY}", ratio=BASE_RATIO, result="pre_during")
def _(r):
    return pre_during(r)


_P_MONEY = "sales_pre sales_campaign sales_post"


@query("period_sales_seven_days", "SELECT * FROM periods", money=_P_MONEY)
def _(r):
    return periods(r)


@query("period_sales_long", _period_sql({
    "history": ("CAST(campaign_start_date - INTERVAL 6 MONTH AS DATE)", "campaign_start_date - 1"),
    "campaign": ("campaign_start_date", "campaign_start_date + 7"),
    "post": ("campaign_start_date + 7", "campaign_start_date + 28")}, "tagged"),
       money="sales_history sales_campaign sales_post")
def _(r):
    return S.period_sales(r.sales, r.campaigns, r.campaign_skus, S.LONG_WINDOWS, with_all_baskets=False)


@query("complete_periods", """
SELECT campaign_id, site, n_days_campaign_period, total_baskets_campaign_period FROM (
  SELECT *, max(n_days_campaign_period) OVER (PARTITION BY campaign_id) AS top FROM during) x
WHERE n_days_campaign_period = top""")
def _(r):
    return S.complete_periods(during(r)).select(
        "campaign_id", "site", "n_days_campaign_period", "total_baskets_campaign_period")


@query("sales_uplift", """
SELECT campaign_id, site, test_or_control, perc_sales_uplift, raw_sales_uplift FROM uplifted""",
       money="raw_sales_uplift", ratio="perc_sales_uplift")
def _(r):
    return uplifted(r).select(
        "campaign_id", "site", "test_or_control", "perc_sales_uplift", "raw_sales_uplift")


@query("basket_volume_filter", """
SELECT campaign_id, site, total_baskets_campaign_period, total_baskets_pre_period FROM pre_during
WHERE total_baskets_campaign_period / (n_days_campaign_period / 7) >= 5
  AND total_baskets_pre_period / (n_days_campaign_period / 7) >= 5""")
def _(r):
    return S.min_baskets_per_week(pre_during(r), 5).select(
        "campaign_id", "site", "total_baskets_campaign_period", "total_baskets_pre_period")


@query("period_panel", "SELECT * FROM panel",
       money=_P_MONEY + " daily_sales_pre daily_sales_campaign daily_sales_post",
       ratio="daily_baskets_pre daily_baskets_campaign daily_baskets_post basket_share_pre "
             "basket_share_campaign basket_share_post perc_change_in_sales perc_change_in_share")
def _(r):
    return panel(r)


@query("within_range_counts", """
SELECT campaign_id,
       count(CASE WHEN perc_change_in_sales <= -0.15 OR perc_change_in_sales >= 0.15 THEN 1 END) AS out_of_range,
       count(CASE WHEN perc_change_in_sales >= -0.15 AND perc_change_in_sales <= 0.15 THEN 1 END) AS within_range
FROM panel GROUP BY 1""")
def _(r):
    return S.within_range(panel(r), "perc_change_in_sales", 0.15, by=("campaign_id",))


@query("price_per_unit", f"""
SELECT campaign_id, site, article, count(DISTINCT CASE WHEN h THEN {SUN} END) AS history_weeks,
       sum(CASE WHEN h THEN sales_amount END) / sum(CASE WHEN h THEN units END) AS history_price,
       sum(CASE WHEN c THEN sales_amount END) / sum(CASE WHEN c THEN units END) AS campaign_price
FROM (SELECT *, txn_date BETWEEN media_start_date - 91 AND media_start_date - 7 AS h,
             txn_date BETWEEN media_start_date AND media_end_date AS c FROM store_tagged) x
WHERE h OR c GROUP BY 1, 2, 3 HAVING sum(CASE WHEN h THEN units END) IS NOT NULL""",
       money="history_price campaign_price")
def _(r):
    return S.price_per_unit(r.sales, r.campaigns, r.campaign_skus)


@query("rolling_monthly_orders", """
SELECT t.shopper_id, t.order_month, t.n_orders, t.rolling_orders, s.subcat, s.n_orders_subcat, s.rolling_orders_subcat
FROM (SELECT *, avg(n_orders) OVER (PARTITION BY shopper_id ORDER BY order_month RANGE UNBOUNDED PRECEDING) AS rolling_orders
      FROM (SELECT shopper_id, CAST(date_trunc('month', start_txn_date) AS DATE) AS order_month,
                   count(DISTINCT basket_key) AS n_orders FROM transactions GROUP BY 1, 2) a) t
LEFT JOIN (SELECT *, avg(n_orders_subcat) OVER (PARTITION BY shopper_id, subcat ORDER BY order_month
                                                RANGE UNBOUNDED PRECEDING) AS rolling_orders_subcat
      FROM (SELECT shopper_id, subcat, CAST(date_trunc('month', start_txn_date) AS DATE) AS order_month,
                   count(DISTINCT basket_key) AS n_orders_subcat FROM transactions GROUP BY 1, 2, 3) b) s
ON s.shopper_id = t.shopper_id AND s.order_month = t.order_month""",
       ratio="rolling_orders rolling_orders_subcat")
def _(r):
    return S.rolling_monthly_orders(r.transactions)


@query("article_week_profile", """
SELECT article, CAST(date_trunc('week', txn_date) AS DATE) AS sales_week, count(DISTINCT site) AS n_stores,
       count(DISTINCT basket_key) AS n_baskets, sum(sales_amount) AS sales_amount,
       count(DISTINCT basket_key) / count(DISTINCT site) AS baskets_per_store,
       sum(sales_amount) / count(DISTINCT basket_key) AS spend_per_basket
FROM store_sales GROUP BY 1, 2""", money="sales_amount spend_per_basket", ratio="baskets_per_store")
def _(r):
    return S.article_week_profile(r.sales)


@query("basket_bucket_histogram", """
SELECT CASE WHEN m < 1.2 THEN '< 1.2' WHEN m < 1.5 THEN '1.2 - 1.5' WHEN m < 2.0 THEN '1.5 - 2.0' ELSE '>= 2.0' END AS bucket,
       CAST(CASE WHEN m < 1.2 THEN 0 WHEN m < 1.5 THEN 1 WHEN m < 2.0 THEN 2 ELSE 3 END AS BIGINT) AS sort_key,
       count(*) AS n_stores
FROM (SELECT mean_transactions AS m FROM baseline) x GROUP BY 1, 2""")
def _(r):
    return S.basket_histogram(baseline(r), "mean_transactions", [1.2, 1.5, 2.0])
