"""Digital exposure queries: impressions to shopper and campaign uplift."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog.campaign_queries import taxonomy
from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.operators import exposure as X
from counterlift.operators import shoppers as P

VIEWS["hits_id"] = """
SELECT h.*, m.shopper_id, m.crn FROM hits h LEFT JOIN (
  SELECT *, lead(effective_time) OVER (PARTITION BY visitor_id ORDER BY effective_time) AS nxt FROM id_map) m
ON m.visitor_id = h.visitor_id AND h.date_time BETWEEN m.effective_time AND m.expiry_time
   AND (m.nxt IS NULL OR h.date_time < m.nxt)"""
VIEWS["page_hits"] = """
SELECT * FROM hits_id
WHERE (string_split(page_name, ':')[3] = 'catalogue' OR lower(section) = 'catalogue' OR page_name = 'ww:homepage'
       OR string_split(packed_key, ':')[4] IS NOT NULL)
  AND channel <> 'Order Confirmation Section' AND (shopper_id IS NOT NULL OR crn IS NOT NULL)"""
VIEWS["impressions"] = """
SELECT event_id, visitor_id, date_time, shopper_id, crn, page_name, action, site_platform, search_term,
       CAST(CASE WHEN string_split(page_name, ':')[3] = 'catalogue' OR lower(section) = 'catalogue' THEN 1 ELSE 0 END AS BIGINT)
         AS catalogue_flag,
       CAST(CASE WHEN page_name = 'ww:homepage' THEN 1 ELSE 0 END AS BIGINT) AS homepage_flag,
       coalesce(string_split(packed_key, ':')[1], 'Not Found') AS booking_id, string_split(packed_key, ':')[4] AS ci_id
FROM page_hits"""
VIEWS["active"] = "SELECT DISTINCT CAST(date_time AS DATE) AS date, shopper_id, crn FROM page_hits"
VIEWS["tax_lines"] = """
SELECT DISTINCT booking_number, line_name, media_type, campaign_start_date, campaign_end_date, media_start_date,
       media_end_date FROM taxonomy"""
_HIT = """
SELECT {method} AS join_method, i.date_time, i.shopper_id, i.crn, l.booking_number AS booking_id, i.ci_id,
       l.media_type, l.campaign_start_date, l.campaign_end_date, l.media_start_date, l.media_end_date, {sku_set} AS sku_set
FROM impressions i JOIN {lines} l ON {cond}
 AND i.date_time BETWEEN CAST(l.media_start_date AS TIMESTAMP) AND CAST(l.media_end_date + 1 AS TIMESTAMP)"""
_MEDIA_LINES = """(SELECT DISTINCT booking_number, media_type, campaign_start_date, campaign_end_date, media_start_date,
 media_end_date FROM taxonomy WHERE media_type = '{m}')"""
VIEWS["exposed_hits"] = " UNION ALL ".join([
    _HIT.format(method="'CI ID Rows'", sku_set="i.ci_id", lines="tax_lines",
                cond="l.line_name = i.ci_id AND l.booking_number = i.booking_id"),
    _HIT.format(method="'Catalogue'", sku_set="'Catalogue'", lines=_MEDIA_LINES.format(m="Catalogue"),
                cond="i.catalogue_flag = 1 AND i.booking_id = 'Not Found'"),
    _HIT.format(method="'Homepage Rows'", sku_set="'Home Page'", lines=_MEDIA_LINES.format(m="Home Page"),
                cond="i.homepage_flag = 1 AND i.booking_id = 'Not Found'"),
])
VIEWS["exposures"] = """
SELECT DISTINCT CAST(date_time AS DATE) AS date, booking_id, campaign_start_date, campaign_end_date, ci_id, media_type,
       shopper_id, crn, sku_set FROM exposed_hits WHERE crn IS NOT NULL"""
VIEWS["sku_set_items"] = """
SELECT DISTINCT booking_number AS booking_id, line_name AS sku_set, article FROM taxonomy
UNION SELECT DISTINCT booking_number, media_type, article FROM taxonomy WHERE media_type IN ('Catalogue', 'Home Page')"""
VIEWS["controls"] = """
SELECT DISTINCT c.booking_id, c.campaign_start_date, c.campaign_end_date, a.shopper_id, a.crn
FROM active a JOIN (SELECT DISTINCT booking_id, campaign_start_date, campaign_end_date FROM exposures) c
  ON a.date BETWEEN c.campaign_start_date AND c.campaign_end_date
WHERE a.crn IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM exposures e WHERE e.booking_id = c.booking_id AND e.shopper_id = a.shopper_id
                  AND e.campaign_start_date = c.campaign_start_date)
  AND NOT EXISTS (SELECT 1 FROM exposures e WHERE e.booking_id = c.booking_id AND e.crn = a.crn
                  AND e.campaign_start_date = c.campaign_start_date)"""
VIEWS["test_control"] = """
SELECT date, booking_id, campaign_start_date, campaign_end_date, ci_id, media_type, shopper_id, crn, sku_set,
       'Exposed' AS cohort FROM exposures
UNION ALL
SELECT NULL, k.booking_id, k.campaign_start_date, k.campaign_end_date, NULL, NULL, k.shopper_id, k.crn, s.sku_set, 'Not Exposed'
FROM controls k JOIN (SELECT DISTINCT booking_id, sku_set FROM exposures) s ON s.booking_id = k.booking_id"""


def _conv(join):
    # one row per cohort row and member of its set, bought or not
    return f"""
SELECT c.date AS impression_date, c.booking_id, c.sku_set, c.cohort AS exposure_context, c.ci_id, c.media_type,
       c.crn AS exposure_crn, t.order_context, t.start_txn_time, t.basket_key, t.brand, t.article, t.amount,
       t.shopper_id AS converted_crn, CASE WHEN t.shopper_id IS NULL THEN 1 ELSE 0 END AS missing,
       CASE WHEN CAST(t.start_txn_time AS DATE) < c.date + 3 THEN '3 Days' ELSE '7 Days' END AS exposure_to_purchase_window
FROM test_control c {join}
 AND CAST(t.start_txn_time AS DATE) BETWEEN c.campaign_start_date AND c.campaign_end_date"""


VIEWS["sku_conv_raw"] = _conv("""JOIN sku_set_items m ON m.booking_id = c.booking_id AND m.sku_set = c.sku_set
LEFT JOIN transactions t ON t.shopper_id = c.crn AND t.article = m.article""")
VIEWS["brand_conv_raw"] = _conv("""JOIN (SELECT DISTINCT s.booking_id, s.sku_set, a.brand FROM sku_set_items s
  JOIN articles a ON a.article = s.article) m ON m.booking_id = c.booking_id AND m.sku_set = c.sku_set
LEFT JOIN transactions t ON t.shopper_id = c.crn AND t.brand = m.brand""")
for _lv in ("sku", "brand"):
    VIEWS[f"{_lv}_conv"] = f"""
SELECT * EXCLUDE (missing), CAST(0 AS BIGINT) AS n_unmatched FROM {_lv}_conv_raw WHERE missing = 0
UNION ALL
SELECT * EXCLUDE (missing), count(*) AS n_unmatched FROM {_lv}_conv_raw WHERE missing = 1 GROUP BY ALL"""
    for _d in (3, 7):
        _w = "WHERE exposure_to_purchase_window = '3 Days' OR converted_crn IS NULL" if _d == 3 else ""
        VIEWS[f"{_lv}_sales_{_d}"] = f"""
SELECT DISTINCT booking_id, exposure_context, order_context, exposure_crn, converted_crn, start_txn_time, basket_key,
       brand, article, amount FROM {_lv}_conv {_w}"""
        VIEWS[f"{_lv}_agg_{_d}"] = f"""
SELECT booking_id, count(DISTINCT exposure_crn) AS exposed_shoppers, count(DISTINCT converted_crn) AS converted_shoppers,
       count(DISTINCT basket_key) AS baskets,
       sum(CASE WHEN order_context = 'Online Order' THEN amount ELSE 0 END) AS sales_online,
       sum(CASE WHEN order_context <> 'Online Order' THEN amount ELSE 0 END) AS sales_instore
FROM {_lv}_sales_{_d} GROUP BY 1"""


def impressions(r):
    return r.stage("impressions", lambda: X.asset_impressions(r.hits, r.id_map))


def sets_source(r):
    return r.stage("taxonomy", lambda: taxonomy(r))


def sets(r):
    return X.sku_sets(sets_source(r))


def exposures(r):
    return r.stage(
        "exposures", lambda: X.distinct_exposures(X.attribute_exposures(impressions(r), sets_source(r))))


def controls(r):
    return r.stage("controls", lambda: X.control_shoppers(exposures(r), X.active_visitors(r.hits, r.id_map)))


def test_control(r):
    return r.stage("test_control", lambda: X.union_cohorts(exposures(r), controls(r)))


def everyone(r):
    """Customers of both cohorts; a campaign without exposure has no control either."""
    return r.stage("everyone", lambda: X.cohort_people(exposures(r), controls(r)))


def brands(r):
    return X.brand_map(r.products)


def purchases(r):
    """What the customers of both cohorts bought; most buyers are in none."""
    return r.stage("purchases", lambda: X.purchases_of(everyone(r), r.transactions))


def sku_conv(r):
    return r.stage("sku_conv", lambda: X.conversions(test_control(r), r.transactions, sets(r)))


def brand_conv(r):
    return r.stage("brand_conv", lambda: X.conversions(test_control(r), r.transactions, sets(r), "brand", brands(r)))


def sku_lines(r):
    return r.stage("sku_lines", lambda: X.conversion_lines(exposures(r), controls(r), purchases(r), sets(r)))


def brand_lines(r):
    return r.stage("brand_lines", lambda: X.conversion_lines(exposures(r), controls(r), purchases(r), sets(r), "brand", brands(r)))


_AGG = "sales_online sales_instore"
for _lv in ("sku", "brand"):
    VIEWS[f"{_lv}_lines"] = f"""
SELECT booking_id, exposure_context, exposure_crn, order_context, start_txn_time, basket_key, brand, article, amount,
       converted_crn, count(*) AS n_rows, max(impression_date) AS last_exposure, CAST(0 AS BIGINT) AS n_unmatched,
       CASE WHEN CAST(start_txn_time AS DATE) < max(impression_date) + 3 THEN '3 Days' ELSE '7 Days' END AS exposure_to_purchase_window
FROM {_lv}_conv_raw WHERE missing = 0 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10
UNION ALL
SELECT booking_id, exposure_context, exposure_crn, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), '7 Days'
FROM {_lv}_conv_raw WHERE missing = 1 GROUP BY 1, 2, 3"""
VIEWS["open_hits"] = """
SELECT i.event_id, i.date_time, w.booking_number FROM impressions i LEFT JOIN (
  SELECT DISTINCT booking_number, media_type, campaign_start_date, campaign_end_date, media_start_date, media_end_date
  FROM taxonomy WHERE media_type = 'Catalogue') w
ON i.date_time BETWEEN CAST(w.media_start_date AS TIMESTAMP) AND CAST(w.media_end_date + 1 AS TIMESTAMP)
WHERE i.catalogue_flag = 1 AND i.booking_id = 'Not Found'"""


@query("sku_conversion_lines", "SELECT * FROM sku_lines", money="amount", result="sku_lines")
def _(r):
    return sku_lines(r)


@query("brand_conversion_lines", "SELECT * FROM brand_lines", money="amount", result="brand_lines")
def _(r):
    return brand_lines(r)


def open_catalogues(r):
    return X.open_media(impressions(r), sets_source(r), "catalogue_flag", X.CATALOGUE)


@query("open_bookings_of_hits", "SELECT event_id, count(booking_number) AS n_open FROM open_hits GROUP BY 1")
def _(r):
    return open_catalogues(r)[0].select("event_id", "n_open")


@query("open_booking_sets", """
SELECT bookings, count(*) AS n_hits FROM (
  SELECT event_id, string_agg(booking_number, ',' ORDER BY booking_number) AS bookings FROM open_hits
  WHERE booking_number IS NOT NULL GROUP BY 1) x GROUP BY 1""")
def _(r):
    seen, members = open_catalogues(r)
    names = members.groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_list("booking_id")), ",").alias("bookings"))
    return seen.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("n_hits")).join(names, "set_id").select("bookings", "n_hits")


@query("article_brand_map", """
SELECT CAST(p_partkey AS VARCHAR) AS article, max(p_type) AS subcat, max(p_brand) AS brand FROM part GROUP BY 1""")
def _(r):
    return brands(r)


@query("unified_transactions", """
SELECT order_context, start_txn_date, start_txn_time, '10' || lpad(shopper_id, 8, '0') AS shopper_id, article,
       basket_key, amount, subcat, brand
FROM transactions""", money="amount")
def _(r):
    crn = F.concat(F.lit("10"), F.lpad(F.col("shopper_id"), 8, "0"))
    t = r.transactions.drop("brand", "subcat")
    customers = r.table("customer").select(F.col("c_custkey").cast("string").alias("shopper_id"))
    instore = t.filter("order_context = 'Instore Order'").select(
        F.concat(F.lit("card"), "shopper_id").alias("card"), "start_txn_date", "start_txn_time", "article", "basket_key",
        "amount", F.lit(1005).alias("division"), F.lit("N").alias("void_flag"))
    cards = customers.select(F.concat(F.lit("card"), "shopper_id").alias("card"), crn.alias("crn"))
    online = t.filter("order_context = 'Online Order'").withColumnRenamed("shopper_id", "customer_number")
    shoppers = customers.select(F.col("shopper_id").alias("customer_number"), crn.alias("crn"))
    return X.unified_transactions(instore, cards, online, shoppers, brands(r))


@query("identity_asof", "SELECT event_id, visitor_id, shopper_id, crn FROM hits_id")
def _(r):
    return X.identity_asof(r.hits, r.id_map).select("event_id", "visitor_id", "shopper_id", "crn")


@query("asset_impressions", "SELECT * FROM impressions", result="impressions")
def _(r):
    return impressions(r)


@query("active_visitors", "SELECT * FROM active")
def _(r):
    return X.active_visitors(r.hits, r.id_map)


@query("exposure_to_campaign", "SELECT * FROM exposed_hits")
def _(r):
    return X.attribute_exposures(impressions(r), sets_source(r))


@query("distinct_exposures", "SELECT * FROM exposures", result="exposures")
def _(r):
    return exposures(r)


@query("control_shoppers", "SELECT * FROM controls", result="controls")
def _(r):
    return controls(r)


@query("test_control_union", "SELECT * FROM test_control", result="test_control")
def _(r):
    return test_control(r)


@query("sku_conversions", "SELECT * FROM sku_conv", money="amount", result="sku_conv")
def _(r):
    return sku_conv(r)


@query("brand_conversions", "SELECT * FROM brand_conv", money="amount", result="brand_conv")
def _(r):
    return brand_conv(r)


@query("distinct_sales_sku", "SELECT * FROM sku_sales_7", money="amount")
def _(r):
    return X.distinct_sales(sku_lines(r))


@query("distinct_sales_brand_3_days", "SELECT * FROM brand_sales_3", money="amount")
def _(r):
    return X.distinct_sales(brand_lines(r), "3 Days")


@query("window_aggregate_sku_7", "SELECT * FROM sku_agg_7", money=_AGG)
def _(r):
    return X.window_aggregate(X.distinct_sales(sku_lines(r)))


@query("window_aggregate_brand_3", "SELECT * FROM brand_agg_3", money=_AGG)
def _(r):
    return X.window_aggregate(X.distinct_sales(brand_lines(r), "3 Days"))


_WIDE = ", ".join(
    f"{s}.exposed_shoppers AS {s}_exposed, {s}.converted_shoppers AS {s}_converted, {s}.baskets AS {s}_baskets, "
    f"{s}.converted_shoppers / nullif(sku_{s[-1]}.exposed_shoppers, 0) AS {s}_rate"
    for s in ("sku_3", "sku_7", "brand_3", "brand_7"))


@query("three_vs_seven_day", f"""
SELECT sku_7.booking_id, {_WIDE} FROM sku_agg_7 sku_7 LEFT JOIN sku_agg_3 sku_3 ON sku_3.booking_id = sku_7.booking_id
LEFT JOIN brand_agg_3 brand_3 ON brand_3.booking_id = sku_7.booking_id
LEFT JOIN brand_agg_7 brand_7 ON brand_7.booking_id = sku_7.booking_id""",
       ratio="sku_3_rate sku_7_rate brand_3_rate brand_7_rate")
def _(r):
    return X.compare_windows(sku_lines(r), brand_lines(r))


@query("sku_vs_brand_totals", """
SELECT s.booking_id, s.exposed_shoppers AS n_exposed_sku, s.converted_shoppers AS n_converted_sku,
       b.exposed_shoppers AS n_exposed_brand, b.converted_shoppers AS n_converted_brand,
       b.exposed_shoppers - s.exposed_shoppers AS exposed_diff,
       b.converted_shoppers - s.converted_shoppers AS converted_diff
FROM sku_agg_7 s LEFT JOIN brand_agg_7 b ON b.booking_id = s.booking_id""")
def _(r):
    return X.totals_check(X.distinct_sales(sku_lines(r)), X.distinct_sales(brand_lines(r)))


@query("tagged_totals", """
SELECT 'sku' AS level, sum(amount) AS total, count(DISTINCT basket_key) AS baskets FROM sku_sales_7
UNION ALL SELECT 'brand', sum(amount), count(DISTINCT basket_key) FROM brand_sales_7""", money="total")
def _(r):
    return X.tagged_totals(X.distinct_sales(sku_lines(r)), X.distinct_sales(brand_lines(r)))


@query("cohort_overlap", """
SELECT booking_id, count(CASE WHEN n = 1 THEN 1 END) AS n_one_cohort, count(CASE WHEN n = 2 THEN 1 END) AS n_two_cohorts,
       count(CASE WHEN n > 2 THEN 1 END) AS n_more_cohorts
FROM (SELECT booking_id, crn, count(DISTINCT cohort) AS n FROM test_control GROUP BY 1, 2) x GROUP BY 1""")
def _(r):
    return X.cohort_overlap(everyone(r))


VIEWS["hashed_hits"] = """
SELECT *, CASE WHEN event_id % 3 = 0 THEN sha256(shopper_id) WHEN event_id % 3 = 1 THEN sha256(crn) END AS hashed_crn
FROM impressions"""


def hashed_hits(r):
    e = F.col("event_id") % 3
    h = F.when(e == 0, F.sha2(F.col("shopper_id"), 256)).when(e == 1, F.sha2(F.col("crn"), 256))
    return impressions(r).withColumn("hashed_crn", h)


@query("identity_hash_audit", """
SELECT DISTINCT booking_id, visitor_id, crn, hashed_crn, sha256(crn) AS own_hash FROM hashed_hits
WHERE crn IS NOT NULL AND hashed_crn IS NOT NULL AND sha256(crn) <> hashed_crn""")
def _(r):
    return X.hash_audit(hashed_hits(r))


@query("missing_id_counts", """
SELECT count(DISTINCT CASE WHEN hashed_crn IS NULL THEN visitor_id END) AS n_visitors_no_hash,
       count(DISTINCT CASE WHEN visitor_id IS NULL THEN hashed_crn END) AS n_hash_no_visitor FROM hashed_hits""")
def _(r):
    return X.missing_id_counts(hashed_hits(r))


@query("spend_reconciliation", """
SELECT p.booking_id, p.crn, p.spend_by_path, d.spend_by_transactions FROM (
  SELECT booking_id, exposure_crn AS crn, sum(amount) AS spend_by_path FROM (
    SELECT DISTINCT booking_id, exposure_crn, basket_key, article, amount FROM brand_conv) x GROUP BY 1, 2) p
LEFT JOIN (SELECT c.booking_id, t.shopper_id AS crn, sum(t.amount) AS spend_by_transactions
  FROM transactions t JOIN (SELECT DISTINCT s.booking_id, s.article, e.campaign_start_date, e.campaign_end_date
    FROM sku_set_items s JOIN test_control e ON e.booking_id = s.booking_id) c
  ON c.article = t.article AND t.start_txn_date BETWEEN c.campaign_start_date AND c.campaign_end_date GROUP BY 1, 2) d
ON d.booking_id = p.booking_id AND d.crn = p.crn""", money="spend_by_path spend_by_transactions")
def _(r):
    return X.spend_reconciliation(brand_lines(r), r.transactions, sets(r), everyone(r))


@query("hashed_key_conversions", """
SELECT DISTINCT e.booking_id, e.date, e.hashed_key, t.order_context, t.start_txn_time, t.basket_key, t.article, t.amount,
       CASE WHEN CAST(t.start_txn_time AS DATE) < e.date + 3 THEN '3 Days' ELSE '7 Days' END AS exposure_to_purchase_window
FROM (SELECT DISTINCT booking_id, sku_set, CAST(date_time AS DATE) AS date,
             coalesce(sha256(crn), sha256(shopper_id)) AS hashed_key FROM exposed_hits) e
JOIN sku_set_items s ON s.booking_id = e.booking_id AND s.sku_set = e.sku_set
JOIN transactions t ON t.article = s.article AND sha256(t.shopper_id) = e.hashed_key
 AND CAST(t.start_txn_time AS DATE) BETWEEN e.date AND e.date + 7""", money="amount")
def _(r):
    seen = X.attribute_exposures(impressions(r), sets_source(r)).withColumns(
        {"date": F.col("date_time").cast("date"), "hashed_crn": F.sha2(F.col("shopper_id"), 256)})
    return X.hashed_key_conversions(seen, r.transactions, sets(r))


# ---- history, features, sampling and matching ----------------------------

_FREQ = """
SELECT *, avg(days_since_last_order) OVER (PARTITION BY booking_id, cohort, crn ORDER BY start_txn_date
            RANGE UNBOUNDED PRECEDING) AS rolling_avg_days,
       avg(spend) OVER (PARTITION BY booking_id, cohort, crn ORDER BY start_txn_date RANGE UNBOUNDED PRECEDING)
            AS rolling_avg_spend
FROM (SELECT *, CAST(date_diff('day', previous_txn_date, start_txn_date) AS BIGINT) AS days_since_last_order FROM (
  SELECT *, lag(start_txn_date) OVER (PARTITION BY booking_id, cohort, crn ORDER BY start_txn_date, basket_key)
              AS previous_txn_date FROM (
    SELECT p.booking_id, p.campaign_start_date, p.campaign_end_date, p.cohort, p.crn, t.start_txn_date, t.basket_key,
           t.order_context, count(DISTINCT t.article) AS n_articles, sum(t.amount) AS spend
    FROM (SELECT DISTINCT booking_id, campaign_start_date, campaign_end_date, cohort, crn FROM test_control) p
    JOIN {members} m ON m.booking_id = p.booking_id
    JOIN transactions t ON t.shopper_id = p.crn AND t.{item} = m.{item} AND {cond}
    GROUP BY 1, 2, 3, 4, 5, 6, 7, 8) a) b) c"""
VIEWS["freq_sku"] = _FREQ.format(
    members="(SELECT DISTINCT booking_id, article FROM sku_set_items WHERE article <> '')", item="article",
    cond="t.start_txn_date <= p.campaign_end_date")
VIEWS["freq_brand"] = _FREQ.format(
    members="(SELECT DISTINCT s.booking_id, a.brand FROM sku_set_items s JOIN articles a ON a.article = s.article)",
    item="brand", cond="t.start_txn_date < p.campaign_start_date")
for _lv in ("sku", "brand"):
    VIEWS[f"summary_{_lv}"] = f"""
SELECT booking_id, campaign_start_date, campaign_end_date, cohort, crn, min(start_txn_date) AS earliest_order_{_lv},
       max(start_txn_date) AS latest_order_{_lv}, count(DISTINCT basket_key) AS total_orders_{_lv}, sum(spend) AS spend_{_lv},
       max(CASE WHEN n = 1 THEN rolling_avg_days END) AS avg_days_between_{_lv},
       max(CASE WHEN n = 1 THEN rolling_avg_spend END) AS avg_spend_per_order_{_lv}
FROM (SELECT *, row_number() OVER (PARTITION BY booking_id, cohort, crn ORDER BY start_txn_date DESC, basket_key DESC) AS n
      FROM freq_{_lv} WHERE start_txn_date < campaign_start_date) x GROUP BY 1, 2, 3, 4, 5"""
VIEWS["summaries"] = """
SELECT b.*, s.* EXCLUDE (booking_id, campaign_start_date, campaign_end_date, cohort, crn)
FROM summary_brand b LEFT JOIN summary_sku s ON s.booking_id = b.booking_id AND s.cohort = b.cohort AND s.crn = b.crn"""
VIEWS["never"] = """
SELECT DISTINCT booking_id, campaign_start_date, campaign_end_date, cohort, crn FROM test_control c
WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.booking_id = c.booking_id AND s.crn = c.crn)"""
VIEWS["all_summaries"] = "SELECT * FROM summaries UNION ALL BY NAME SELECT * FROM never"
VIEWS["history"] = """
SELECT o.converted, o.n_converted_baskets, o.total_converted_spend, s.*
FROM (SELECT booking_id, exposure_crn AS crn, CAST(CASE WHEN converted_crn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS converted,
             count(DISTINCT basket_key) AS n_converted_baskets, sum(amount) AS total_converted_spend
      FROM (SELECT DISTINCT booking_id, exposure_crn, converted_crn, basket_key, article, amount FROM brand_conv) x
      GROUP BY 1, 2, 3) o
JOIN all_summaries s ON s.booking_id = o.booking_id AND s.crn = o.crn"""
VIEWS["feats"] = "SELECT DISTINCT booking_id, cohort, crn, " + ", ".join(
    f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in P.FEATURES) + " FROM history"
# clusters by a rule both engines can state; the fitted ones have their own query
VIEWS["clustered"] = "SELECT *, CAST(least(total_orders_brand, 9) AS BIGINT) + 1 AS cluster FROM feats"
VIEWS["c_counts"] = """
SELECT booking_id, cluster, cohort, count(DISTINCT crn) AS customer_count FROM clustered GROUP BY 1, 2, 3"""
_SAMPLE = """
SELECT booking_id, cluster, cohort, crn FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.booking_id, p.cluster, p.cohort
           ORDER BY md5(p.booking_id || '|' || p.crn || '|sample'), p.crn) AS n,
         CASE WHEN k.customer_count > {cap} THEN floor({cap} * k.customer_count / t.total) ELSE k.customer_count END AS size
  FROM (SELECT DISTINCT booking_id, cluster, cohort, crn FROM clustered) p
  JOIN c_counts k ON k.booking_id = p.booking_id AND k.cluster = p.cluster AND k.cohort = p.cohort
  JOIN (SELECT booking_id, count(DISTINCT crn) AS total FROM clustered GROUP BY 1) t ON t.booking_id = p.booking_id) x
WHERE n <= size"""
VIEWS["people"] = "SELECT DISTINCT booking_id, cluster, cohort, crn FROM clustered"
_DIFFS = ", ".join(f"abs(u.{f} - e.{f}) AS {f}_diff" for f in P.FEATURES)
_RANKS = " + ".join(
    f"row_number() OVER (PARTITION BY booking_id, cluster, crn ORDER BY {f}_diff, candidate)" for f in P.FEATURES)
VIEWS["pair_ranks"] = f"""
SELECT *, CAST({_RANKS} AS BIGINT) AS sum_of_diff_ranks FROM (
  SELECT e.booking_id, e.cluster, e.crn, u.crn AS candidate, {_DIFFS}
  FROM (SELECT f.*, s.cluster FROM people s JOIN feats f ON f.booking_id = s.booking_id AND f.crn = s.crn
        AND f.cohort = s.cohort WHERE s.cohort = 'Exposed') e
  JOIN (SELECT f.*, s.cluster FROM people s JOIN feats f ON f.booking_id = s.booking_id AND f.crn = s.crn
        AND f.cohort = s.cohort WHERE s.cohort = 'Not Exposed') u
  ON u.booking_id = e.booking_id AND u.cluster = e.cluster AND u.crn <> e.crn) x"""
VIEWS["shopper_matches"] = """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY booking_id, cluster, crn
  ORDER BY sum_of_diff_ranks, candidate) AS n FROM pair_ranks) x WHERE n = 1"""
_SPEND = "".join(
    f""" LEFT JOIN (SELECT booking_id, converted_crn, sum(amount) AS spend, count(DISTINCT basket_key) AS baskets
 FROM {lv}_sales_7 GROUP BY 1, 2) {side[0]}{lv} ON {side[0]}{lv}.booking_id = m.booking_id AND {side[0]}{lv}.converted_crn = m.{key}"""
    for lv in ("sku", "brand") for side, key in (("exposed", "crn"), ("control", "candidate")))
VIEWS["shopper_up"] = f"""
SELECT m.booking_id, m.crn, m.candidate,
       esku.spend AS exposed_spend_sku, esku.baskets AS exposed_baskets_sku, csku.spend AS control_spend_sku,
       csku.baskets AS control_baskets_sku, ebrand.spend AS exposed_spend_brand, ebrand.baskets AS exposed_baskets_brand,
       cbrand.spend AS control_spend_brand, cbrand.baskets AS control_baskets_brand,
       esku.spend - csku.spend AS uplift_sku, ebrand.spend - cbrand.spend AS uplift_brand
FROM shopper_matches m {_SPEND}"""
VIEWS["camp_up"] = """
SELECT *, exposed_spend_sku - control_spend_sku AS total_uplift_sku,
       exposed_spend_sku / nullif(control_spend_sku, 0) - 1 AS percentage_uplift_sku,
       (exposed_spend_sku - control_spend_sku) / nullif(sampled_exposed_shoppers, 0) * total_exposed_shoppers AS estimated_uplift_sku,
       exposed_spend_brand - control_spend_brand AS total_uplift_brand,
       exposed_spend_brand / nullif(control_spend_brand, 0) - 1 AS percentage_uplift_brand,
       (exposed_spend_brand - control_spend_brand) / nullif(sampled_exposed_shoppers, 0) * total_exposed_shoppers AS estimated_uplift_brand
FROM (SELECT u.*, t.total_exposed_shoppers, h.sampled_exposed_shoppers, h.sampled_converted_shoppers,
             a.converted_exposed_sku, b.converted_exposed_brand
  FROM (SELECT booking_id, count(candidate) AS n_pairs, sum(exposed_spend_sku) AS exposed_spend_sku,
               sum(exposed_spend_brand) AS exposed_spend_brand, CAST(sum(exposed_baskets_sku) AS BIGINT) AS exposed_baskets_sku,
               CAST(sum(exposed_baskets_brand) AS BIGINT) AS exposed_baskets_brand, sum(control_spend_sku) AS control_spend_sku,
               sum(control_spend_brand) AS control_spend_brand, CAST(sum(control_baskets_sku) AS BIGINT) AS control_baskets_sku,
               CAST(sum(control_baskets_brand) AS BIGINT) AS control_baskets_brand FROM shopper_up GROUP BY 1) u
  LEFT JOIN (SELECT booking_id, count(DISTINCT crn) AS total_exposed_shoppers FROM exposures GROUP BY 1) t
    ON t.booking_id = u.booking_id
  LEFT JOIN (SELECT h.booking_id, count(DISTINCT h.crn) AS sampled_exposed_shoppers,
                    count(DISTINCT CASE WHEN converted = 1 THEN h.crn END) AS sampled_converted_shoppers
             FROM history h JOIN (SELECT DISTINCT booking_id, crn FROM people) s
               ON s.booking_id = h.booking_id AND s.crn = h.crn WHERE h.cohort = 'Exposed' GROUP BY 1) h
    ON h.booking_id = u.booking_id
  LEFT JOIN (SELECT booking_id, count(DISTINCT converted_crn) AS converted_exposed_sku FROM sku_conv
             WHERE exposure_context = 'Exposed' GROUP BY 1) a ON a.booking_id = u.booking_id
  LEFT JOIN (SELECT booking_id, count(DISTINCT converted_crn) AS converted_exposed_brand FROM brand_conv
             WHERE exposure_context = 'Exposed' GROUP BY 1) b ON b.booking_id = u.booking_id) x"""
VIEWS["up_profile"] = """
SELECT c.*, n.brands, n.categories, n.n_skus, m.media_types, m.n_campaign_weeks,
       c.exposed_spend_brand / nullif(c.sampled_converted_shoppers, 0) AS brand_spend_per_convert
FROM camp_up c
LEFT JOIN (SELECT s.booking_id, string_agg(DISTINCT a.brand, ', ' ORDER BY a.brand) AS brands,
                  string_agg(DISTINCT a.category, ', ' ORDER BY a.category) AS categories,
                  count(DISTINCT s.article) AS n_skus
           FROM (SELECT DISTINCT i.booking_id, i.article FROM sku_set_items i JOIN exposures e
                 ON e.booking_id = i.booking_id AND e.sku_set = i.sku_set) s
           LEFT JOIN articles a ON a.article = s.article GROUP BY 1) n ON n.booking_id = c.booking_id
LEFT JOIN (SELECT booking_id, string_agg(DISTINCT media_type, ', ' ORDER BY media_type) AS media_types,
                  CAST(date_diff('day', min(campaign_start_date) - CAST(dayofweek(min(campaign_start_date)) AS INTEGER),
                       max(campaign_end_date) - CAST(dayofweek(max(campaign_end_date)) AS INTEGER)) / 7 AS BIGINT)
                    AS n_campaign_weeks FROM exposures GROUP BY 1) m ON m.booking_id = c.booking_id
WHERE c.exposed_baskets_brand > 5 AND c.control_baskets_brand > 5"""


def freq(r, level):
    return P.purchase_frequency(everyone(r), purchases(r), sets(r), level, brands(r))


def summaries(r):
    return r.stage("summaries", lambda: P.shopper_summary(freq(r, "sku"), freq(r, "brand")))


def never(r):
    return P.never_buyers(everyone(r), summaries(r))


def history(r):
    return r.stage("history", lambda: P.exposure_plus_history(brand_lines(r), summaries(r).unionByName(never(r))))


def feats(r):
    return P.features(history(r))


def clustered(r):
    return feats(r).withColumn("cluster", F.least("total_orders_brand", F.lit(9.0)).cast("long") + 1)


def people(r):
    return r.stage("people", lambda: clustered(r).select("booking_id", "cluster", "cohort", "crn").distinct())


def matches(r):
    return r.stage("matches", lambda: P.rank_match(people(r), feats(r)))


def uplift(r):
    return P.shopper_uplift(matches(r), X.distinct_sales(sku_lines(r)), X.distinct_sales(brand_lines(r)))


def camp_up(r):
    return P.campaign_uplift(uplift(r), everyone(r), history(r), people(r), sku_lines(r), brand_lines(r))


def profile(r):
    return P.uplift_profile(camp_up(r), exposures(r), sets(r), r.articles, 5)


_FREQ_MONEY, _FREQ_RATIO = "spend rolling_avg_spend", "rolling_avg_days"
_SUM_MONEY = "spend_brand avg_spend_per_order_brand spend_sku avg_spend_per_order_sku"
_SUM_RATIO = "avg_days_between_brand avg_days_between_sku"
_FEAT_RATIO = _SUM_RATIO
_UP_MONEY = "exposed_spend_sku control_spend_sku exposed_spend_brand control_spend_brand"
_CAMP_MONEY = _UP_MONEY + " total_uplift_sku total_uplift_brand estimated_uplift_sku estimated_uplift_brand"
_CAMP_RATIO = "percentage_uplift_sku percentage_uplift_brand"


@query("purchase_frequency_sku", "SELECT * FROM freq_sku", money=_FREQ_MONEY, ratio=_FREQ_RATIO)
def _(r):
    return freq(r, "sku")


@query("purchase_frequency_brand", "SELECT * FROM freq_brand", money=_FREQ_MONEY, ratio=_FREQ_RATIO)
def _(r):
    return freq(r, "brand")


@query("shopper_summary", "SELECT * FROM summaries", money=_SUM_MONEY, ratio=_SUM_RATIO, result="summaries")
def _(r):
    return summaries(r)


@query("never_buyers", "SELECT * FROM never")
def _(r):
    return never(r).select("booking_id", "campaign_start_date", "campaign_end_date", "cohort", "crn")


@query("exposure_plus_history", "SELECT * FROM history", money=_SUM_MONEY + " total_converted_spend", ratio=_SUM_RATIO, result="history")
def _(r):
    return history(r)


@query("shopper_features", "SELECT * FROM feats", money=_SUM_MONEY, ratio=_FEAT_RATIO)
def _(r):
    return feats(r)


@query("cluster_cohort_counts", "SELECT * FROM c_counts")
def _(r):
    return P.cluster_counts(clustered(r))


@query("stratified_cap_sample", _SAMPLE.format(cap=40))
def _(r):
    return P.cap_sample(clustered(r), cap=40)


@query("within_cluster_pairs", """
SELECT booking_id, cluster, count(CASE WHEN cohort = 'Exposed' THEN 1 END) AS n_exposed,
       count(CASE WHEN cohort = 'Not Exposed' THEN 1 END) AS n_not_exposed,
       count(CASE WHEN cohort = 'Exposed' THEN 1 END) * count(CASE WHEN cohort = 'Not Exposed' THEN 1 END) AS n_pairs
FROM people GROUP BY 1, 2""")
def _(r):
    return P.within_cluster_pair_counts(people(r))


@query("best_shopper_match", "SELECT * FROM shopper_matches",
       money=" ".join(f"{f}_diff" for f in P.FEATURES), result="matches")
def _(r):
    return matches(r)


@query("best_shopper_match_unique", """
SELECT booking_id, crn, candidate, sum_of_diff_ranks FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id, candidate ORDER BY sum_of_diff_ranks, crn) AS k
  FROM shopper_matches) x WHERE k = 1""")
def _(r):
    return P.unique_candidates(matches(r)).select("booking_id", "crn", "candidate", "sum_of_diff_ranks")


@query("shopper_uplift", "SELECT * FROM shopper_up", money=_UP_MONEY + " uplift_sku uplift_brand")
def _(r):
    return uplift(r)


@query("campaign_uplift", "SELECT * FROM camp_up", money=_CAMP_MONEY, ratio=_CAMP_RATIO)
def _(r):
    return camp_up(r)


@query("campaign_uplift_profile", "SELECT * FROM up_profile", money=_CAMP_MONEY + " brand_spend_per_convert", ratio=_CAMP_RATIO)
def _(r):
    return profile(r)


_BY = """
SELECT member, count(DISTINCT booking_id) AS n_campaigns, avg(percentage_uplift_brand) AS avg_uplift
FROM (SELECT *, unnest(string_split({d}, ', ')) AS member FROM up_profile WHERE percentage_uplift_brand IS NOT NULL) x GROUP BY 1"""


@query("media_uplift", _BY.format(d="media_types"), ratio="avg_uplift")
def _(r):
    return P.uplift_by(profile(r), "media_types")


@query("category_uplift", _BY.format(d="categories"), ratio="avg_uplift")
def _(r):
    return P.uplift_by(profile(r), "categories")


@query("total_uplift", """
SELECT count(DISTINCT booking_id) AS n_campaigns, avg(percentage_uplift_brand) AS avg_uplift FROM up_profile
WHERE percentage_uplift_brand IS NOT NULL""", ratio="avg_uplift")
def _(r):
    return P.uplift_by(profile(r), None)


@query("cohort_conversion", """
SELECT booking_id, cohort, CASE WHEN total_orders_brand IS NULL THEN 'Never Buyer' ELSE 'Buyer' END AS relationship,
       count(DISTINCT crn) AS customers, count(DISTINCT CASE WHEN total_converted_spend IS NOT NULL THEN crn END) AS converted,
       count(DISTINCT CASE WHEN total_converted_spend IS NOT NULL THEN crn END) / count(DISTINCT crn) AS rate
FROM history GROUP BY 1, 2, 3""", ratio="rate")
def _(r):
    return P.cohort_conversion(history(r))


@query("cluster_balance", """
SELECT booking_id, cluster, count(DISTINCT CASE WHEN cohort = 'Exposed' THEN crn END) AS n_exposed,
       count(DISTINCT CASE WHEN cohort = 'Not Exposed' THEN crn END) AS n_not_exposed FROM people GROUP BY 1, 2""")
def _(r):
    return P.cluster_balance(people(r)).fillna(0, ["n_exposed", "n_not_exposed"])
