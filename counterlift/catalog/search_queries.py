"""Page- and search-based exposure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog import exposure_queries as e
from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.operators import exposure as X
from counterlift.operators import search as T

VIEWS["termed"] = """
SELECT *, lower(trim(regexp_extract(search_term, '^([^|]*)', 1))) AS first_search_term FROM impressions"""
VIEWS["c_hits"] = """
SELECT i.*, l.media_type, l.campaign_start_date, l.campaign_end_date, l.media_start_date, l.media_end_date
FROM termed i JOIN tax_lines l ON l.booking_number = i.booking_id AND l.line_name = i.ci_id"""
VIEWS["c_pages"] = """
SELECT DISTINCT h.page_name, CAST(h.date_time AS DATE) AS impression_date, h.booking_id, h.ci_id, h.media_type,
       h.campaign_start_date, h.campaign_end_date, n.n_skus
FROM c_hits h LEFT JOIN (SELECT booking_number, line_name, count(DISTINCT article) AS n_skus FROM taxonomy GROUP BY 1, 2) n
  ON n.booking_number = h.booking_id AND n.line_name = h.ci_id WHERE h.action = 'impression'"""
VIEWS["exposed_t"] = """
SELECT DISTINCT booking_id, ci_id, media_type, crn, date_time AS exposure_time FROM c_hits
WHERE crn IS NOT NULL AND (booking_id, ci_id) IN (SELECT (booking_id, ci_id) FROM c_pages)"""
VIEWS["control_t"] = """
SELECT DISTINCT p.booking_id, p.media_type, i.crn, i.date_time AS exposure_time
FROM termed i JOIN c_pages p ON p.page_name = i.page_name AND p.impression_date = CAST(i.date_time AS DATE)
WHERE i.crn IS NOT NULL AND p.impression_date BETWEEN p.campaign_start_date AND p.campaign_end_date
  AND NOT EXISTS (SELECT 1 FROM exposed_t x WHERE x.booking_id = p.booking_id AND x.crn = i.crn)"""
for _n, _src in (("buys_exposed", "exposed_t"), ("buys_control", "control_t")):
    VIEWS[_n] = f"""
SELECT v.booking_id, v.media_type, v.crn AS exposure_crn, v.exposure_time, t.shopper_id AS converted_crn, t.order_context,
       t.start_txn_time, t.basket_key, t.article, t.amount,
       CASE WHEN t.start_txn_time < v.exposure_time + INTERVAL 3 DAY THEN '3 Days' ELSE '7 Days' END AS exposure_to_purchase_window
FROM {_src} v LEFT JOIN (SELECT t.*, s.booking_id FROM transactions t
  JOIN (SELECT DISTINCT booking_number AS booking_id, article FROM taxonomy) s ON s.article = t.article) t
ON t.booking_id = v.booking_id AND t.shopper_id = v.crn
AND t.start_txn_time BETWEEN v.exposure_time AND v.exposure_time + INTERVAL 7 DAY"""
VIEWS["conv_t"] = """
SELECT booking_id, exposure_context, exposure_crn, converted_crn, order_context, basket_key, article, amount,
       string_agg(DISTINCT media_type, ',' ORDER BY media_type) AS media_types
FROM (SELECT *, 'Exposed' AS exposure_context FROM buys_exposed
      UNION ALL SELECT *, 'Not Exposed' FROM buys_control) x GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""
_SUM = """
count(DISTINCT exposure_crn) AS visitors, count(DISTINCT converted_crn) AS buyers,
       count(DISTINCT converted_crn) / nullif(count(DISTINCT exposure_crn), 0) AS conversion_rate,
       count(DISTINCT basket_key) / nullif(count(DISTINCT converted_crn), 0) AS baskets_per_buyer,
       count(DISTINCT basket_key) / nullif(count(DISTINCT exposure_crn), 0) AS baskets_per_visitor,
       sum(amount) / nullif(count(DISTINCT exposure_crn), 0) AS spend_per_visitor,
       sum(amount) / nullif(count(DISTINCT converted_crn), 0) AS spend_per_buyer"""
VIEWS["summary_t"] = f"SELECT booking_id, media_types, exposure_context, {_SUM} FROM conv_t GROUP BY 1, 2, 3"
def _side(alias, prefix):
    return ", ".join(f"{alias}.{c} AS {prefix}_{c}" for c in ["visitors", "buyers", *T.MEASURES])


VIEWS["wide_t"] = f"""
SELECT e.booking_id, e.media_types, {_side('e', 'exposed')}, {_side('c', 'control')},
""" + ", ".join(f"e.{c} / nullif(c.{c}, 0) - 1 AS {c}_perc, e.{c} - c.{c} AS {c}_points" for c in T.MEASURES) + """
FROM summary_t e JOIN summary_t c ON c.booking_id = e.booking_id AND c.media_types = e.media_types
WHERE e.exposure_context = 'Exposed' AND c.exposure_context = 'Not Exposed' AND e.visitors >= 5 AND c.visitors >= 5"""
VIEWS["test_s"] = """
SELECT visitor_id, crn, page_name, booking_id, ci_id,
       coalesce(string_agg(DISTINCT first_search_term, ',' ORDER BY first_search_term), '') AS terms, min(date_time) AS first_seen
FROM termed WHERE ci_id IS NOT NULL AND booking_id NOT IN (SELECT booking_number FROM reach_all)
GROUP BY 1, 2, 3, 4, 5"""
VIEWS["reach_all"] = "SELECT DISTINCT booking_number FROM bookings WHERE media_type = 'Content Card'"
VIEWS["unmatched_s"] = f"""
SELECT booking_id, exposure_context, {_SUM} FROM (
  SELECT * FROM brand_sales_7 WHERE exposure_context = 'Exposed'
  UNION ALL SELECT c.* FROM brand_sales_7 c WHERE c.exposure_context <> 'Exposed' AND NOT EXISTS (
    SELECT 1 FROM brand_sales_7 x WHERE x.exposure_context = 'Exposed' AND x.booking_id = c.booking_id
     AND x.order_context = c.order_context AND x.basket_key = c.basket_key AND x.article = c.article
     AND x.amount = c.amount)) u GROUP BY 1, 2"""


def termed(r):
    return r.stage("termed", lambda: T.impressions_with_terms(e.impressions(r)))


def c_hits(r):
    return r.stage("c_hits", lambda: T.campaign_hits(termed(r), e.sets_source(r)))


def c_pages(r):
    return T.impression_pages(c_hits(r), e.sets_source(r))


def exposed(r):
    return r.stage("exposed_t", lambda: T.exposed_at_time(c_hits(r), c_pages(r)))


def controls(r):
    return T.page_day_controls(termed(r), c_pages(r), exposed(r))


def skus(r):
    return e.sets_source(r).select(F.col("booking_number").alias("booking_id"), "article")


def buys(r, rows):
    return T.purchases_after(rows, r.transactions, skus(r))


def conv(r):
    return T.distinct_conversions(buys(r, exposed(r)), buys(r, controls(r)))


def summary(r):
    return r.stage("summary_t", lambda: T.conversion_summary(conv(r)))


def reach_all(r):
    return r.bookings.filter("media_type = 'Content Card'").select("booking_number")


def test_group(r):
    return r.stage("test_s", lambda: T.search_test_group(termed(r), reach_all(r)))


def unmatched(r):
    return r.stage("unmatched", lambda: T.unmatched_conversion(X.distinct_sales(e.brand_lines(r))))


_S_MONEY = "spend_per_visitor spend_per_buyer"
_S_RATIO = "conversion_rate baskets_per_buyer baskets_per_visitor"
_WIDE_COLS = " ".join(
    [f"{p}_{c}" for p in ("exposed", "control") for c in T.MEASURES]
    + [f"{c}_{k}" for c in T.MEASURES for k in ("perc", "points")])


@query("impressions_with_terms", "SELECT * FROM termed")
def _(r):
    return T.impressions_with_terms(e.impressions(r))


@query("campaign_hits", "SELECT * FROM c_hits", result="c_hits")
def _(r):
    return c_hits(r)


@query("impression_pages", "SELECT * FROM c_pages")
def _(r):
    return c_pages(r)


@query("impression_page_skus", """
SELECT DISTINCT h.booking_id, CAST(h.date_time AS DATE) AS impression_date, h.campaign_start_date, h.campaign_end_date, h.site_platform,
       h.media_type, h.ci_id, h.page_name, t.article, a.description
FROM c_hits h JOIN taxonomy t ON t.booking_number = h.booking_id AND t.line_name = h.ci_id JOIN articles a ON a.article = t.article
WHERE h.action = 'impression'""")
def _(r):
    return T.impression_page_skus(c_hits(r), e.sets_source(r), r.articles)


@query("exposed_shoppers_at_time", "SELECT * FROM exposed_t", result="exposed_t")
def _(r):
    return exposed(r)


@query("page_day_controls", "SELECT * FROM control_t")
def _(r):
    return controls(r)


@query("purchases_after_exposure", "SELECT * FROM buys_exposed", money="amount")
def _(r):
    return buys(r, exposed(r))


@query("purchases_after_visit_control", "SELECT * FROM buys_control", money="amount")
def _(r):
    return buys(r, controls(r))


@query("distinct_conversions", "SELECT * FROM conv_t", money="amount")
def _(r):
    return conv(r)


@query("conversion_summary", "SELECT * FROM summary_t", money=_S_MONEY, ratio=_S_RATIO, result="summary_t")
def _(r):
    return summary(r)


@query("exposed_vs_not_report", "SELECT * FROM wide_t", ratio=_WIDE_COLS)
def _(r):
    return T.exposed_vs_not(summary(r), 5)


@query("averages_by_media", """
SELECT media_type, count(DISTINCT booking_id) AS n_campaigns, avg(conversion_rate_perc) AS avg_conversion_rate_perc,
       avg(spend_per_visitor_perc) AS avg_spend_per_visitor_perc
FROM (SELECT *, unnest(string_split(media_types, ',')) AS media_type FROM wide_t) x GROUP BY 1""",
       ratio="avg_conversion_rate_perc avg_spend_per_visitor_perc")
def _(r):
    return T.averages_by_media(T.exposed_vs_not(summary(r), 5))


@query("visitors_by_page", """
SELECT page_name, term, count(DISTINCT visitor_id) AS visitors,
       count(DISTINCT CASE WHEN listed THEN visitor_id END) AS exposed_visitors,
       count(DISTINCT CASE WHEN NOT listed THEN visitor_id END) AS unexposed_hits_visitors,
       min(d) AS first_visit, max(d) AS last_visit
FROM (SELECT h.*, lower(regexp_replace(search_term, '[^a-zA-Z0-9 &-''@]', '', 'g')) AS term,
             CAST(date_time + INTERVAL 11 HOUR AS DATE) AS d, b.line_name IS NOT NULL AS listed
      FROM hits h LEFT JOIN (SELECT DISTINCT booking_number, line_name FROM bookings) b
        ON b.booking_number = string_split(packed_key, ':')[1] AND b.line_name = string_split(packed_key, ':')[4]) x
GROUP BY 1, 2""")
def _(r):
    # January lies in Sydney's summer time, eleven hours ahead
    return T.visitors_by_page(r.hits, r.bookings)


@query("search_test_group", "SELECT * FROM test_s", result="test_s")
def _(r):
    return test_group(r)


@query("search_control_group", """
SELECT DISTINCT u.booking_id, u.ci_id, o.visitor_id, o.crn, o.page_name, o.term
FROM (SELECT DISTINCT visitor_id, crn, page_name, first_search_term AS term FROM termed
      WHERE booking_id NOT IN (SELECT booking_number FROM reach_all)) o
JOIN (SELECT DISTINCT booking_id, ci_id, page_name, unnest(string_split(terms, ',')) AS term FROM test_s) u
  ON u.page_name = o.page_name AND u.term = o.term
WHERE NOT EXISTS (SELECT 1 FROM test_s t WHERE t.booking_id = u.booking_id AND t.ci_id = u.ci_id AND t.visitor_id = o.visitor_id)
  AND NOT EXISTS (SELECT 1 FROM test_s t WHERE t.booking_id = u.booking_id AND t.ci_id = u.ci_id AND t.crn = o.crn)""")
def _(r):
    return T.search_control_group(termed(r), test_group(r), reach_all(r))


@query("unmatched_conversion", "SELECT * FROM unmatched_s", money=_S_MONEY, ratio=_S_RATIO, result="unmatched")
def _(r):
    return unmatched(r)


_SIDE = """count(DISTINCT CASE WHEN exposure_context = '{c}' THEN exposure_crn END) AS n_{s},
  count(DISTINCT CASE WHEN exposure_context = '{c}' AND converted_crn IS NOT NULL THEN exposure_crn END)
    / nullif(count(DISTINCT CASE WHEN exposure_context = '{c}' THEN exposure_crn END), 0) AS {s}_conversion_rate"""


@query("unmatched_conversion_report", f"""
WITH b AS (SELECT DISTINCT booking_id, exposure_context, exposure_crn, basket_key, article, amount FROM sku_conv WHERE basket_key IS NOT NULL),
u AS (SELECT * FROM b WHERE exposure_context = 'Exposed' UNION ALL SELECT c.* FROM b c WHERE c.exposure_context <> 'Exposed' AND NOT EXISTS (
  SELECT 1 FROM b x WHERE x.exposure_context = 'Exposed' AND x.booking_id = c.booking_id AND x.exposure_crn = c.exposure_crn
   AND x.basket_key = c.basket_key AND x.article = c.article AND x.amount = c.amount)),
s AS (SELECT booking_id, count(DISTINCT CASE WHEN exposure_context = 'Exposed' THEN basket_key END) AS eb,
  count(DISTINCT CASE WHEN exposure_context <> 'Exposed' THEN basket_key END) AS nb,
  sum(CASE WHEN exposure_context = 'Exposed' THEN amount ELSE 0 END) AS es, sum(CASE WHEN exposure_context <> 'Exposed' THEN amount ELSE 0 END) AS ns
  FROM u GROUP BY 1),
p AS (SELECT booking_id, {_SIDE.format(c='Exposed', s='exposed')}, {_SIDE.format(c='Not Exposed', s='not_exposed')} FROM sku_conv GROUP BY 1),
f AS (SELECT booking_number, min(campaign_start_date) AS campaign_start_date, max(campaign_end_date) AS campaign_end_date,
  count(DISTINCT article) AS n_skus, string_agg(DISTINCT media_type, ',' ORDER BY media_type) AS media_types FROM taxonomy GROUP BY 1)
SELECT p.booking_id, f.campaign_start_date, f.campaign_end_date, f.media_types, f.n_skus,
  CAST(date_diff('day', f.campaign_start_date, f.campaign_end_date) AS BIGINT) AS n_days, p.n_exposed, p.exposed_conversion_rate,
  coalesce(s.eb, 0) / nullif(p.n_exposed, 0) AS exposed_baskets_per_shopper, coalesce(s.es, 0) / nullif(p.n_exposed, 0) AS exposed_sales_per_shopper,
  p.n_not_exposed, p.not_exposed_conversion_rate, coalesce(s.nb, 0) / nullif(p.n_not_exposed, 0) AS not_exposed_baskets_per_shopper,
  coalesce(s.ns, 0) / nullif(p.n_not_exposed, 0) AS not_exposed_sales_per_shopper
FROM p LEFT JOIN s ON s.booking_id = p.booking_id LEFT JOIN f ON f.booking_number = p.booking_id""",
       money="exposed_sales_per_shopper not_exposed_sales_per_shopper",
       ratio="exposed_conversion_rate not_exposed_conversion_rate exposed_baskets_per_shopper not_exposed_baskets_per_shopper")
def _(r):
    return T.unmatched_report(e.sku_lines(r), e.sets_source(r))


@query("booking_members", """
SELECT DISTINCT booking_number AS booking_id, 'media' AS kind, media_type AS member FROM taxonomy WHERE media_type IS NOT NULL
UNION ALL SELECT DISTINCT booking_number, 'sku', trim(article) FROM taxonomy
UNION ALL SELECT DISTINCT t.booking_number, 'subcat', a.subcat FROM taxonomy t JOIN articles a ON a.article = trim(t.article)""")
def _(r):
    return T.booking_members(e.sets_source(r), r.articles)


@query("conversion_uplift", """
SELECT e.booking_id, e.conversion_rate / nullif(c.conversion_rate, 0) - 1 AS conversion_rate_perc,
       e.conversion_rate - c.conversion_rate AS conversion_rate_points,
       e.spend_per_visitor / nullif(c.spend_per_visitor, 0) - 1 AS spend_per_visitor_perc,
       e.spend_per_visitor - c.spend_per_visitor AS spend_per_visitor_points
FROM (SELECT * FROM unmatched_s WHERE exposure_context = 'Exposed') e
LEFT JOIN (SELECT * FROM unmatched_s WHERE exposure_context <> 'Exposed') c ON c.booking_id = e.booking_id""",
       ratio="conversion_rate_perc conversion_rate_points spend_per_visitor_perc spend_per_visitor_points")
def _(r):
    return T.conversion_uplift(unmatched(r))


# a run log: one finished step 9 for each second campaign
VIEWS["run_log"] = """
SELECT campaign_id, CAST(n % 9 + 1 AS VARCHAR) AS query_step, 1.5 * n AS minutes FROM (
  SELECT DISTINCT booking_number AS campaign_id, CAST(substr(booking_number, 3, 2) AS BIGINT) AS n FROM bookings) x"""


def run_log(r):
    n = F.substring("booking_number", 3, 2).cast("long")
    return r.bookings.select("booking_number", n.alias("n")).distinct().select(
        F.col("booking_number").alias("campaign_id"), (F.col("n") % 9 + 1).cast("string").alias("query_step"),
        (F.col("n") * 1.5).alias("minutes"))


@query("both_cohorts_results", """
SELECT * FROM summary_t s WHERE EXISTS (SELECT 1 FROM summary_t x WHERE x.booking_id = s.booking_id
  AND x.media_types = s.media_types AND x.exposure_context = 'Exposed' AND x.visitors > 0)
AND EXISTS (SELECT 1 FROM summary_t x WHERE x.booking_id = s.booking_id AND x.media_types = s.media_types
  AND x.exposure_context = 'Not Exposed' AND x.visitors > 0)
AND booking_id IN (SELECT campaign_id FROM run_log WHERE query_step >= '3')""", money=_S_MONEY, ratio=_S_RATIO)
def _(r):
    return T.both_cohorts(summary(r), run_log(r).filter("query_step >= '3'"))


@query("assets_by_media", """
SELECT media_type, count(DISTINCT booking_id || '/' || ci_id) AS n_assets FROM c_hits GROUP BY 1""")
def _(r):
    return T.assets_by_media(c_hits(r))


@query("log_with_media", """
SELECT l.*, m.media_types FROM run_log l LEFT JOIN (SELECT booking_number, string_agg(DISTINCT media_type, ', '
  ORDER BY media_type) AS media_types FROM taxonomy GROUP BY 1) m ON m.booking_number = l.campaign_id""", ratio="minutes")
def _(r):
    return T.log_with_media(run_log(r), e.sets_source(r))
