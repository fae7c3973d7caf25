"""Campaign preparation, similarity by earlier campaigns, stock and design queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog import matching_queries as mq
from counterlift.catalog import store_queries as q
from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.operators import campaigns as C
from counterlift.operators import design as D
from counterlift.operators import matching as M
from counterlift.operators import similarity as Y
from counterlift.operators import stock as K

# ---- bookings to assets --------------------------------------------------

_MAP = " ".join(f"WHEN media_type = '{k}' THEN '{v}'" for k, v in C.REPORTING_TYPE.items())


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


VIEWS["taxonomy"] = f"""
SELECT booking_number, campaign_start_date, campaign_end_date, line_name, media_type, article,
       min(media_start_date) AS media_start_date, max(media_end_date) AS media_end_date,
       CAST(sum(quantity) * sum(media_spend) AS DOUBLE) AS total_media_spend
FROM (SELECT * EXCLUDE (media_type), unnest(string_split(quoteline_sku, ',')) AS article,
        CASE WHEN media_location LIKE '%TV%' THEN 'Mass_Social_Media'
             WHEN media_type IN {_in(C.MASS_MEDIA_TYPES)} THEN 'Mass_Social_Media'
             WHEN media_location IN {_in(C.IN_STORE_LOCATIONS)} THEN 'in-store'
             WHEN media LIKE '%FB Post%' THEN 'Mass_Social_Media' {_MAP}
             WHEN lower(media_type) LIKE '%catalogue%' THEN 'Catalogue'
             WHEN lower(media_type) LIKE '%homepage%' THEN 'Home Page' ELSE media_type END AS media_type
      FROM bookings
      WHERE business_unit = 'Supermarket' AND quote_status NOT IN {_in(C.DROPPED_STATUSES)}
        AND media_location NOT IN {_in(C.IN_STORE_LOCATIONS)} AND media_location NOT LIKE '%TV%'
        AND media_type NOT IN {_in(C.UNBOOKABLE_TYPES)}
        AND (media_location <> 'None' OR media LIKE '%FB Post%' OR media LIKE '%Branded%' OR media LIKE '%Segments%')
        AND media NOT IN {_in(C.UNBOOKABLE_MEDIA)}
        AND media_start_date >= DATE '2023-10-01' AND media_end_date < DATE '2024-06-01') x
WHERE media_type NOT IN {_in(C.REPORTED_EXCLUSIONS)} AND lower(media_type) NOT LIKE '%branded shop%'
GROUP BY 1, 2, 3, 4, 5, 6"""

VIEWS["assets"] = """
SELECT booking_number || '_' || CAST(asset_num AS VARCHAR) AS campaign_id, * FROM (
  SELECT booking_number, campaign_start_date, campaign_end_date, media_start_date, media_end_date, media_type, line_name,
         row_number() OVER (PARTITION BY booking_number ORDER BY media_start_date, line_name) AS asset_num,
         list_sort(list_distinct(list_transform(string_split(quoteline_sku, ','), lambda x: trim(x)))) AS skus,
         list_sort(list_distinct(list_transform(string_split(store_list, ','), lambda x: trim(x)))) AS store_ids
  FROM bookings
  WHERE (lower(media_type) LIKE '%digital screen%' OR lower(media_type) LIKE '%hba screens%')
    AND store_list IS NOT NULL) x"""
VIEWS["asset_skus"] = """
SELECT DISTINCT campaign_id, article FROM (SELECT campaign_id, unnest(skus) AS article FROM assets) x
WHERE article <> '' AND lower(article) <> 'npd'"""
_COMPLIANCE = " ".join(f"WHEN upper(media_type) LIKE '%{t}%' THEN '{t}'" for t in C.COMPLIANCE_TYPES)
VIEWS["comp_schema"] = f"""
SELECT b.booking_number AS campaign_id, b.line_name, b.campaign_start_date, b.campaign_end_date,
       CASE {_COMPLIANCE} ELSE 'OTHERS' END AS media_type, b.media_location, a.site, a.week_number, a.is_compliant,
       b.media_start_date + CAST((a.week_number - 1) * 7 AS INTEGER) AS run_week_start
FROM bookings b JOIN (
  SELECT DISTINCT campaign_id, quote_line, CAST(store_id AS BIGINT) AS site,
         CAST(CASE WHEN week_number = 'Installation' THEN '1' ELSE right(week_number, 1) END AS BIGINT) AS week_number,
         CAST(result AS BIGINT) AS is_compliant
  FROM compliance WHERE missing_record_flag = 0) a
ON a.campaign_id = b.booking_number AND a.quote_line = b.line_name"""
VIEWS["comp_info"] = """
SELECT c.*, l.categories, l.subcats FROM (
  SELECT campaign_id, line_name, media_type, campaign_start_date, week_number, run_week_start,
         count(DISTINCT site) AS n_stores, count(DISTINCT CASE WHEN is_compliant = 1 THEN site END) AS n_compliant_stores,
         count(DISTINCT CASE WHEN is_compliant = 0 THEN site END) AS n_non_compliant_stores
  FROM comp_schema GROUP BY 1, 2, 3, 4, 5, 6) c
LEFT JOIN (SELECT b.campaign_id, b.line_name, list_sort(list(DISTINCT a.category)) AS categories,
                  list_sort(list(DISTINCT a.subcat)) AS subcats
           FROM line_articles b JOIN articles a ON a.article = b.article
           WHERE a.subcat <> '' AND a.article IN (SELECT article FROM sales
                 WHERE txn_date >= DATE '2023-10-01' AND sales_amount > 0) GROUP BY 1, 2) l
ON l.campaign_id = c.campaign_id AND l.line_name = c.line_name"""
VIEWS["line_articles"] = """
SELECT booking_number AS campaign_id, line_name, unnest(string_split(quoteline_sku, ',')) AS article FROM bookings"""
VIEWS["instore_flags"] = """
SELECT booking_number AS campaign_id, min(CASE WHEN upper(media_type) LIKE '%SCREEN%' OR media_location IN
       ('Category', 'Aisle', 'Store') OR lower(media_type) LIKE '%bus stop%' THEN CAST(1 AS BIGINT) ELSE 0 END) AS instore_only
FROM bookings GROUP BY 1"""
VIEWS["depth"] = """
SELECT w.*, d.average_discount_depth FROM (
  SELECT DISTINCT campaign_id, line_name, media_type, week_number, run_week_start FROM comp_schema) w
LEFT JOIN (SELECT w.campaign_id, w.line_name, w.media_type, w.week_number, w.run_week_start,
                  (avg(unit_price) - sum(amount) / sum(quantity)) / avg(unit_price) AS average_discount_depth
  FROM (SELECT DISTINCT campaign_id, line_name, media_type, week_number, run_week_start FROM comp_schema) w
  JOIN line_articles l ON l.campaign_id = w.campaign_id AND l.line_name = w.line_name
  JOIN price_lines p ON p.article = l.article AND p.txn_date BETWEEN w.run_week_start AND w.run_week_start + 6
  WHERE unit_price > 0 GROUP BY 1, 2, 3, 4, 5) d
ON d.campaign_id = w.campaign_id AND d.line_name = w.line_name AND d.media_type = w.media_type
   AND d.week_number = w.week_number AND d.run_week_start = w.run_week_start"""
VIEWS["cohorts"] = """
SELECT s.campaign_id, s.site, s.campaign_start_date, s.line_name, s.media_type, s.is_compliant,
       c.line_names_string, c.media_types_string, n.media_split_cohort
FROM week_one s
JOIN combos c ON c.campaign_id = s.campaign_id AND c.site = s.site
JOIN (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY media_types_string) AS media_split_cohort
      FROM (SELECT DISTINCT campaign_id, media_types_string FROM combos) y) n
ON n.campaign_id = c.campaign_id AND n.media_types_string = c.media_types_string"""
VIEWS["week_one"] = "SELECT * FROM comp_schema WHERE week_number = 1 AND media_type <> 'OTHERS'"
VIEWS["combos"] = """
SELECT campaign_id, site, string_agg(DISTINCT line_name, ',' ORDER BY line_name) AS line_names_string,
       string_agg(DISTINCT media_type, ',' ORDER BY media_type) AS media_types_string FROM week_one GROUP BY 1, 2"""
VIEWS["comp_media"] = """
SELECT campaign_id, site, 'GROUP ' || CAST(media_split_cohort AS VARCHAR) AS test_group,
       coalesce(string_agg(CASE WHEN is_compliant = 1 THEN media_type END, ', ' ORDER BY media_type), '') AS compliant,
       coalesce(string_agg(CASE WHEN is_compliant = 0 THEN media_type END, ', ' ORDER BY media_type), '') AS non_compliant
FROM cohorts GROUP BY 1, 2, 3"""


def taxonomy(r):
    return C.media_taxonomy(r.bookings, "2023-10-01", "2024-06-01")


def assets(r):
    return C.campaign_assets(r.bookings)


def schema(r):
    return r.stage("schema", lambda: C.compliance_schema(r.bookings, r.compliance))


def info(r):
    return C.campaign_info(r.bookings, r.articles, r.sales, schema(r), "2023-10-01")


def cohorts(r):
    return r.stage("cohorts", lambda: C.compliance_cohorts(schema(r)))


@query("media_taxonomy", "SELECT * FROM taxonomy", money="total_media_spend")
def _(r):
    return taxonomy(r)


@query("compliance_media_type", f"""
SELECT booking_number, line_name, CASE {_COMPLIANCE} ELSE 'OTHERS' END AS compliance_type FROM bookings""")
def _(r):
    return r.bookings.select(
        "booking_number", "line_name", C.compliance_media_type(F.col("media_type")).alias("compliance_type"))


@query("campaign_assets", """
SELECT * REPLACE (array_to_string(skus, ',') AS skus, array_to_string(store_ids, ',') AS store_ids) FROM assets""")
def _(r):
    return assets(r).withColumns(
        {"skus": F.array_join("skus", ","), "store_ids": F.array_join("store_ids", ",")})


@query("asset_info_per_line", """
SELECT booking_number, line_name, n AS asset_number, booking_number || '_' || CAST(n AS VARCHAR) AS booking_and_asset
FROM (SELECT *, row_number() OVER (PARTITION BY booking_number ORDER BY line_name) AS n
      FROM (SELECT DISTINCT booking_number, line_name FROM bookings) x) y""")
def _(r):
    return C.asset_info_per_line(r.bookings)


@query("campaign_skus", "SELECT * FROM asset_skus")
def _(r):
    return C.campaign_skus(assets(r))


@query("campaign_stores", """
SELECT DISTINCT campaign_id, CAST(s AS BIGINT) AS site FROM (SELECT campaign_id, unnest(store_ids) AS s FROM assets) x""")
def _(r):
    return C.campaign_stores(assets(r))


@query("exclude_no_sku_campaigns", """
SELECT DISTINCT campaign_id, 'Excluded for having zero promoted skus' AS reason FROM assets
WHERE campaign_id NOT IN (SELECT campaign_id FROM asset_skus)""")
def _(r):
    return C.exclude_empty(assets(r), C.campaign_skus(assets(r)))


@query("exclude_prior_promoted", """
SELECT DISTINCT a.campaign_id, 'Excluded for having promoted skus in the pre period' AS reason
FROM assets a JOIN asset_skus s ON s.campaign_id = a.campaign_id
JOIN (SELECT unnest(skus) AS article, campaign_start_date AS os, campaign_end_date AS oe FROM assets) o
  ON o.article = s.article
 AND o.os >= a.media_start_date - CAST(date_diff('day', a.media_start_date, a.media_end_date) AS INTEGER)
 AND o.oe <= a.media_start_date - 1""")
def _(r):
    # every booking line is an asset here, so that an earlier one can share SKUs
    return C.exclude_prior_promoted(assets(r), C.campaign_skus(assets(r)))


@query("prior_promoted_all_media", """
SELECT DISTINCT a.booking_number || '/' || a.line_name AS campaign_id,
       'Excluded for having promoted skus in the pre period' AS reason
FROM (SELECT *, unnest(string_split(quoteline_sku, ',')) AS article FROM bookings) a
JOIN (SELECT campaign_start_date AS os, campaign_end_date AS oe, unnest(string_split(quoteline_sku, ',')) AS article
      FROM bookings) o
  ON o.article = a.article AND a.article <> '' AND lower(a.article) <> 'npd'
 AND o.os >= a.media_start_date - CAST(date_diff('day', a.media_start_date, a.media_end_date) AS INTEGER)
 AND o.oe <= a.media_start_date - 1""")
def _(r):
    lines = r.bookings.select(
        F.concat_ws("/", "booking_number", "line_name").alias("campaign_id"), "media_start_date", "media_end_date",
        "campaign_start_date", "campaign_end_date", F.split("quoteline_sku", ",").alias("skus"))
    return C.exclude_prior_promoted(lines, C.campaign_skus(lines))


@query("compliance_schema", "SELECT * FROM comp_schema", result="schema")
def _(r):
    return schema(r)


@query("campaign_info", """
SELECT * REPLACE (array_to_string(categories, ',') AS categories, array_to_string(subcats, ',') AS subcats)
FROM comp_info""")
def _(r):
    return info(r).withColumns(
        {"categories": F.array_join("categories", ","), "subcats": F.array_join("subcats", ",")})


@query("instore_only_flag", "SELECT * FROM instore_flags")
def _(r):
    return C.instore_only(r.bookings)


@query("concurrent_campaigns", """
SELECT campaign_id, line_name, run_week_start, CAST(flag AS BIGINT) AS matching_subcat_flag,
       array_to_string(list_sort(list(DISTINCT other)), ',') AS overlapping_ids
FROM (SELECT *, max(hit) OVER (PARTITION BY campaign_id, line_name, run_week_start) AS flag FROM (
        SELECT a.campaign_id, a.line_name, a.run_week_start, b.campaign_id AS other,
               CASE WHEN list_has_any(a.subcats, b.subcats) THEN 1 ELSE 0 END AS hit
        FROM (SELECT DISTINCT campaign_id, line_name, run_week_start, subcats FROM comp_info) a
        LEFT JOIN (SELECT DISTINCT campaign_id, run_week_start, subcats FROM comp_info) b
          ON b.run_week_start = a.run_week_start AND b.campaign_id <> a.campaign_id) x) y
WHERE hit = flag GROUP BY 1, 2, 3, 4""")
def _(r):
    return C.concurrent_campaigns(info(r)).withColumn("overlapping_ids", F.array_join("overlapping_ids", ","))


@query("concurrent_campaign_pairs", """
SELECT campaign_id, line_name, run_week_start, other, CAST(flag AS BIGINT) AS matching_subcat_flag
FROM (SELECT *, max(hit) OVER (PARTITION BY campaign_id, line_name, run_week_start) AS flag FROM (
        SELECT a.campaign_id, a.line_name, a.run_week_start, b.campaign_id AS other,
               CASE WHEN list_has_any(a.subcats, b.subcats) THEN 1 ELSE 0 END AS hit
        FROM (SELECT DISTINCT campaign_id, line_name, run_week_start, subcats FROM comp_info) a
        JOIN (SELECT DISTINCT campaign_id, run_week_start, subcats FROM comp_info) b
          ON b.run_week_start = a.run_week_start AND b.campaign_id <> a.campaign_id) x) y
WHERE hit = flag GROUP BY 1, 2, 3, 4, 5""")
def _(r):
    return C.concurrent_pairs(info(r))


@query("discount_depth", "SELECT * FROM depth", ratio="average_discount_depth")
def _(r):
    return C.discount_depth(schema(r), r.bookings, r.price_lines)


@query("compliance_cohorts", "SELECT * FROM cohorts", result="cohorts")
def _(r):
    return cohorts(r)


@query("compliant_first_campaign", """
SELECT campaign_id, campaign_start_date, media_types, n_compliant_stores FROM (
  SELECT campaign_id, campaign_start_date, string_agg(DISTINCT media_type, ',' ORDER BY media_type) AS media_types,
         count(DISTINCT site) AS n_compliant_stores,
         row_number() OVER (PARTITION BY campaign_id ORDER BY campaign_start_date) AS n
  FROM week_one WHERE is_compliant = 1 GROUP BY 1, 2) x WHERE n = 1""")
def _(r):
    return C.compliant_first_campaign(schema(r))


@query("first_campaign_members", """
SELECT * FROM (WITH f AS (SELECT campaign_id, min(campaign_start_date) AS campaign_start_date FROM week_one WHERE is_compliant = 1 GROUP BY 1),
k AS (SELECT w.* FROM week_one w JOIN f ON f.campaign_id = w.campaign_id AND f.campaign_start_date = w.campaign_start_date WHERE w.is_compliant = 1)
SELECT DISTINCT campaign_id, campaign_start_date, 'store' AS kind, CAST(site AS VARCHAR) AS member FROM k
UNION ALL SELECT DISTINCT k.campaign_id, k.campaign_start_date, 'sku', s.article FROM k
JOIN (SELECT booking_number, line_name, unnest(string_split(quoteline_sku, ',')) AS article FROM bookings) s
  ON s.booking_number = k.campaign_id AND s.line_name = k.line_name) members""")
def _(r):
    return C.first_campaign_members(schema(r), r.bookings)


@query("week1_campaign_skus", """
SELECT DISTINCT b.booking_number AS campaign_id, unnest(string_split(b.quoteline_sku, ',')) AS article
FROM bookings b JOIN (SELECT DISTINCT campaign_id, campaign_start_date FROM comp_schema) c
ON c.campaign_id = b.booking_number AND c.campaign_start_date = b.media_start_date""")
def _(r):
    return C.week1_skus(schema(r), r.bookings)


@query("compliant_media_arrays", "SELECT * FROM comp_media")
def _(r):
    return C.compliant_media(cohorts(r))


@query("single_media_campaigns", """
SELECT booking_number, count(DISTINCT article) AS n_skus FROM taxonomy GROUP BY 1
HAVING count(CASE WHEN media_type <> 'Catalogue' THEN 1 END) = 0 AND count(DISTINCT article) >= 6""")
def _(r):
    return C.single_media(taxonomy(r), "Catalogue")


@query("media_combinations", "SELECT DISTINCT media_types_string FROM cohorts")
def _(r):
    return C.media_combinations(cohorts(r))


@query("campaign_counts_by_month", """
SELECT CAST(date_trunc('month', campaign_start_date) AS DATE) AS start_month, count(DISTINCT campaign_id) AS n_campaigns
FROM campaigns WHERE campaign_id IN (SELECT campaign_id FROM periods WHERE sales_pre IS NOT NULL) GROUP BY 1""")
def _(r):
    return C.campaign_counts_by_month(q.periods(r), r.campaigns)


@query("campaign_counts_by_category", """
SELECT category, count(DISTINCT campaign_id) AS n_campaigns,
       count(DISTINCT CASE WHEN instore_only = 1 THEN campaign_id END) AS n_instore_only,
       count(DISTINCT CASE WHEN average_discount_depth <= 0.05 THEN campaign_id END) AS n_no_discount,
       count(DISTINCT CASE WHEN instore_only = 1 AND average_discount_depth <= 0.05 THEN campaign_id END)
         AS n_instore_only_no_discount
FROM (SELECT i.campaign_id, unnest(i.categories) AS category, f.instore_only, d.average_discount_depth
      FROM comp_info i JOIN instore_flags f ON f.campaign_id = i.campaign_id
      LEFT JOIN depth d ON d.campaign_id = i.campaign_id AND d.line_name = i.line_name
        AND d.week_number = i.week_number) x GROUP BY 1""")
def _(r):
    depth = C.discount_depth(schema(r), r.bookings, r.price_lines)
    return C.campaign_counts_by_category(info(r), C.instore_only(r.bookings), depth)


# ---- similarity by earlier campaigns ------------------------------------

VIEWS["area_panel"] = """
SELECT p.*, c.campaign_start_date, a.area FROM panel p JOIN campaigns c ON c.campaign_id = p.campaign_id
JOIN sites a ON a.site = p.site"""
VIEWS["changes"] = """
SELECT p.campaign_id, p.campaign_start_date, p.area, p.site, p.perc_change_in_sales, p.perc_change_in_share,
       o.site AS other, o.perc_change_in_sales AS other_change_in_sales, o.perc_change_in_share AS other_change_in_share,
       abs(p.perc_change_in_sales - o.perc_change_in_sales) AS abs_diff_sales,
       abs(p.perc_change_in_share - o.perc_change_in_share) AS abs_diff_share
FROM area_panel p JOIN area_panel o ON o.campaign_id = p.campaign_id AND o.area = p.area AND o.site <> p.site"""
VIEWS["prior"] = """
SELECT t.campaign_id, t.campaign_start_date, t.site, c.other, count(DISTINCT c.campaign_id) AS n_prior,
       avg(c.abs_diff_sales) AS avg_diff_sales, avg(c.abs_diff_share) AS avg_diff_share
FROM (SELECT DISTINCT campaign_id, campaign_start_date, site FROM changes) t
JOIN changes c ON c.site = t.site AND c.campaign_start_date < t.campaign_start_date GROUP BY 1, 2, 3, 4"""
VIEWS["sim_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY campaign_id, site ORDER BY avg_diff_sales, other) AS similarity_ranking
FROM (SELECT *, quantile_cont(n_prior, 0.5) OVER (PARTITION BY campaign_id, site) AS median_support
      FROM prior WHERE avg_diff_sales IS NOT NULL) x WHERE n_prior >= median_support"""
VIEWS["sim_media"] = """
SELECT r.*, a.test_group, a.compliant, a.non_compliant, b.test_group AS other_test_group,
       b.compliant AS other_compliant, b.non_compliant AS other_non_compliant
FROM sim_ranked r LEFT JOIN comp_media a ON a.campaign_id = r.campaign_id AND a.site = r.site
LEFT JOIN comp_media b ON b.campaign_id = r.campaign_id AND b.site = r.other"""
VIEWS["discordant"] = """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, site ORDER BY similarity_ranking) AS n FROM sim_media
  WHERE compliant <> other_compliant AND test_group = other_test_group) x WHERE n = 1"""
VIEWS["asset_res"] = """
SELECT d.campaign_id, d.test_group, d.compliant, d.other_non_compliant,
       avg(c.perc_change_in_sales) - avg(c.other_change_in_sales) AS effect_sales,
       avg(c.perc_change_in_share) - avg(c.other_change_in_share) AS effect_share,
       count(DISTINCT d.site) AS n_stores, count(DISTINCT d.other) AS n_comparison_stores
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, other ORDER BY similarity_ranking, site) AS n
      FROM discordant WHERE compliant <> '' AND other_non_compliant <> '') d
LEFT JOIN changes c ON c.campaign_id = d.campaign_id AND c.site = d.site AND c.other = d.other
WHERE d.n = 1 GROUP BY 1, 2, 3, 4"""


def changes(r):
    panel = q.panel(r).join(r.campaigns.select("campaign_id", "campaign_start_date"), "campaign_id").join(r.sites, "site")
    return r.stage("changes", lambda: Y.store_change_pairs(panel, ["area"]))


def ranked(r):
    return Y.rank_with_support(Y.prior_similarity(changes(r)))


def with_media(r):
    return r.stage("with_media", lambda: Y.attach_compliance(ranked(r), C.compliant_media(cohorts(r))))


_CH = "perc_change_in_sales perc_change_in_share other_change_in_sales other_change_in_share abs_diff_sales abs_diff_share"
_SIM = "avg_diff_sales avg_diff_share"


@query("store_change_pairs", "SELECT * FROM changes", ratio=_CH, result="changes")
def _(r):
    return changes(r)


@query("prior_campaign_similarity", "SELECT * FROM prior", ratio=_SIM)
def _(r):
    return Y.prior_similarity(changes(r))


@query("unordered_pair_dedup", """
SELECT campaign_id, site, other, abs_diff_sales,
       CASE WHEN CAST(site AS VARCHAR) < CAST(other AS VARCHAR) THEN CAST(site AS VARCHAR) || ', ' || CAST(other AS VARCHAR)
            ELSE CAST(other AS VARCHAR) || ', ' || CAST(site AS VARCHAR) END AS combination
FROM changes WHERE site < other""", ratio="abs_diff_sales")
def _(r):
    out = Y.dedup_unordered(changes(r), ["site", "other"], within=["campaign_id"])
    return out.select("campaign_id", "site", "other", "abs_diff_sales", "combination")


@query("support_median_ranking", "SELECT * FROM sim_ranked", ratio=_SIM + " median_support")
def _(r):
    return ranked(r)


@query("attach_compliance_to_pairs", "SELECT * FROM sim_media", ratio=_SIM + " median_support", result="with_media")
def _(r):
    return with_media(r)


@query("discordant_pair_selection", "SELECT * FROM discordant", ratio=_SIM + " median_support")
def _(r):
    return Y.discordant_pairs(with_media(r))


@query("asset_level_results", "SELECT * FROM asset_res", ratio="effect_sales effect_share")
def _(r):
    return Y.asset_results(Y.discordant_pairs(with_media(r)), changes(r))


@query("media_level_results", """
SELECT media_type, avg(effect_sales) AS avg_effect_sales, avg(effect_share) AS avg_effect_share,
       count(DISTINCT campaign_id) AS n_campaigns
FROM (SELECT *, unnest(string_split(compliant, ', ')) AS media_type FROM asset_res) x GROUP BY 1""",
       ratio="avg_effect_sales avg_effect_share")
def _(r):
    return Y.media_results(Y.asset_results(Y.discordant_pairs(with_media(r)), changes(r)))


@query("similarity_snapshot_match", """
SELECT campaign_id, test_store, snapshot_date, control_store, similarity_ranking, n_prior FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, test_store
                               ORDER BY similarity_ranking, n_prior DESC, control_store) AS n
  FROM (SELECT p.campaign_id, p.test_store, p.control_store, s.campaign_start_date AS snapshot_date,
               s.similarity_ranking, s.n_prior,
               max(s.campaign_start_date) OVER (PARTITION BY p.campaign_id) AS newest
        FROM area_pairs p JOIN campaigns c ON c.campaign_id = p.campaign_id
        JOIN sim_ranked s ON s.site = p.test_store AND s.other = p.control_store
         AND s.campaign_start_date < c.media_start_date) x WHERE snapshot_date = newest) y WHERE n = 1""")
def _(r):
    return M.snapshot_match(mq.area_pairs(r), r.campaigns, ranked(r))


@query("closest_and_furthest", """
SELECT campaign_id, site, arg_min(other, similarity_ranking) AS closest, arg_max(other, similarity_ranking) AS furthest
FROM sim_ranked GROUP BY 1, 2""")
def _(r):
    return M.closest_furthest(ranked(r))


# ---- stock ---------------------------------------------------------------

VIEWS["stock_panel"] = """
SELECT d.soh_date, h.hour, d.site, d.article,
       last_value(s.soh IGNORE NULLS) OVER (PARTITION BY d.site, d.article ORDER BY d.soh_date, h.hour
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stock_level
FROM (SELECT DISTINCT soh_date, site, article FROM stock
      WHERE article IN (SELECT article FROM campaign_skus)) d
CROSS JOIN (SELECT unnest(range(24)) AS hour) h
LEFT JOIN stock s ON s.soh_date = d.soh_date AND s.site = d.site AND s.article = d.article AND s.soh_hour = h.hour"""
_DAYS = K.DAYS
_blank = " AND ".join(f"{d}_open <> '' AND {d}_close <> ''" for d in _DAYS)
VIEWS["open_hours"] = " UNION ALL ".join(
    f"SELECT site, '{d}' AS weekday, CAST(substr({d}_open, 1, 2) AS BIGINT) AS opening_hour, "
    f"CASE WHEN {d}_close = '240000' THEN 0 ELSE CAST(substr({d}_close, 1, 2) AS BIGINT) + "
    f"CASE WHEN CAST(substr({d}_close, 3, 2) AS BIGINT) > 0 THEN 1 ELSE 0 END END AS closing_hour "
    f"FROM site_hours WHERE {_blank}" for d in _DAYS)
VIEWS["oos"] = """
SELECT p.site, p.soh_date, p.article, count(DISTINCT hour) AS total_trading_hours,
       count(DISTINCT CASE WHEN stock_level = 0 THEN hour END) AS n_trading_hours_oos
FROM stock_panel p JOIN open_hours o ON o.site = p.site AND o.weekday = dayname(p.soh_date)
 AND p.hour BETWEEN o.opening_hour AND o.closing_hour GROUP BY 1, 2, 3"""
VIEWS["oos_rates"] = """
SELECT c.campaign_id, c.campaign_start_date, c.site, c.line_name, c.is_compliant,
       count(DISTINCT l.article) AS total_skus, count(DISTINCT o.article) AS stocktake_skus,
       CAST(sum(o.total_trading_hours) AS BIGINT) AS total_trading_hours,
       CAST(sum(o.n_trading_hours_oos) AS BIGINT) AS total_oos_trading_hours,
       sum(o.n_trading_hours_oos) / nullif(sum(o.total_trading_hours), 0) AS perc_of_trading_hours_oos
FROM (SELECT DISTINCT campaign_id, campaign_start_date, site, line_name, is_compliant FROM cohorts) c
JOIN line_articles l ON l.campaign_id = c.campaign_id AND l.line_name = c.line_name
LEFT JOIN oos o ON o.article = l.article AND o.site = c.site
 AND o.soh_date BETWEEN c.campaign_start_date AND c.campaign_start_date + 27
GROUP BY 1, 2, 3, 4, 5"""


def panel24(r):
    return K.hourly_stock(r.stock, r.campaign_skus)


def oos(r):
    return K.oos_hours(panel24(r), K.trading_hours(r.site_hours))


def rates(r):
    # the readings are sparse: four weeks instead of one
    return r.stage("rates", lambda: K.stockout_rate(cohorts(r), r.bookings, oos(r), days=28))


@query("hourly_stock_panel", "SELECT * FROM stock_panel")
def _(r):
    return panel24(r)


@query("trading_hours", "SELECT * FROM open_hours")
def _(r):
    return K.trading_hours(r.site_hours)


@query("oos_hours", "SELECT * FROM oos")
def _(r):
    return oos(r)


@query("campaign_stockout_rate", "SELECT * FROM oos_rates", ratio="perc_of_trading_hours_oos", result="rates")
def _(r):
    return rates(r)


# every line also lists the SKUs of its booking's first line, so that lines overlap
VIEWS["shared_articles"] = """
SELECT DISTINCT l.campaign_id, l.line_name, m.article FROM line_articles l JOIN line_articles m ON m.campaign_id = l.campaign_id
 AND (m.line_name = l.line_name OR m.line_name = (SELECT min(line_name) FROM line_articles f WHERE f.campaign_id = l.campaign_id))"""


def shared_lines(r):
    first = r.bookings.groupBy("booking_number").agg(F.min_by("quoteline_sku", "line_name").alias("_first"))
    return r.bookings.join(first, "booking_number").withColumn("quoteline_sku", F.concat_ws(",", "quoteline_sku", "_first")).drop("_first")


@query("stock_coverage_gate", """
SELECT campaign_id, site, total_store_skus, unchecked_skus, unchecked_skus / total_store_skus AS unchecked_share FROM (
  SELECT c.campaign_id, c.site, count(DISTINCT l.article) AS total_store_skus,
         count(DISTINCT l.article) - count(DISTINCT o.article) AS unchecked_skus
  FROM cohorts c JOIN shared_articles l ON l.campaign_id = c.campaign_id AND l.line_name = c.line_name
  LEFT JOIN oos o ON o.article = l.article AND o.site = c.site
   AND o.soh_date BETWEEN c.campaign_start_date AND c.campaign_start_date + 27 GROUP BY 1, 2) x
WHERE unchecked_skus / total_store_skus <= 0.98""", ratio="unchecked_share")
def _(r):
    return K.coverage_gate(K.store_coverage(cohorts(r), shared_lines(r), oos(r), days=28), 0.98)


@query("missing_stock_audit", """
SELECT x.campaign_id, x.campaign_start_date, x.site, x.article, a.description FROM (
  SELECT DISTINCT c.campaign_id, c.campaign_start_date, c.site, l.article
  FROM cohorts c JOIN line_articles l ON l.campaign_id = c.campaign_id AND l.line_name = c.line_name) x
LEFT JOIN articles a ON a.article = x.article
WHERE NOT EXISTS (SELECT 1 FROM stock s WHERE s.article = x.article AND s.site = x.site
                  AND s.soh_date BETWEEN x.campaign_start_date AND x.campaign_start_date + 6)""")
def _(r):
    return K.missing_stock(cohorts(r), r.bookings, r.stock, r.articles)


@query("stock_check_counts", """
SELECT count(CASE WHEN total_trading_hours IS NULL THEN 1 END) AS unchecked,
       count(CASE WHEN total_trading_hours IS NOT NULL THEN 1 END) AS checked FROM oos_rates""")
def _(r):
    t = F.col("total_trading_hours")
    return rates(r).agg(F.count_if(t.isNull()).alias("unchecked"), F.count_if(t.isNotNull()).alias("checked"))


# ---- experiment design ---------------------------------------------------

VIEWS["site_weeks"] = """
SELECT site, CAST(date_trunc('week', txn_date) AS DATE) AS sales_week, count(DISTINCT basket_key) AS n_transactions,
       sum(sales_amount) AS sales_amount FROM store_sales GROUP BY 1, 2"""
VIEWS["dense_weeks"] = """
SELECT s.site, k.sales_week, coalesce(w.n_transactions, 0) AS n_transactions, coalesce(w.sales_amount, 0) AS sales_amount
FROM (SELECT DISTINCT site FROM site_weeks) s
CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(sales_week) FROM site_weeks), (SELECT max(sales_week) FROM site_weeks),
                                              INTERVAL 7 DAY)) AS DATE) AS sales_week) k
LEFT JOIN site_weeks w ON w.site = s.site AND w.sales_week = k.sales_week"""
VIEWS["allocated"] = """
SELECT site, n AS random_allocation, CASE WHEN n <= 20 THEN 'Test 1' WHEN n <= 45 THEN 'Test 2' ELSE 'Control' END AS cohort
FROM (SELECT s_suppkey AS site, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR) || '|alloc')) AS n
      FROM supplier) x"""
VIEWS["weekly_avg"] = "SELECT campaign_id, site, avg(n_transactions) AS weekly_average_baskets FROM weekly GROUP BY 1, 2"
VIEWS["strata"] = """
SELECT *, CASE WHEN weekly_average_baskets <= 1.2 THEN 'Low' WHEN weekly_average_baskets >= 2.2 AND
       weekly_average_baskets <= 3 THEN 'Medium' ELSE 'High' END AS transaction_group FROM weekly_avg"""
VIEWS["strata_sample"] = """
SELECT campaign_id, site, weekly_average_baskets, transaction_group, stratified_sample_size FROM (
  SELECT s.*, z.stratified_sample_size, row_number() OVER (PARTITION BY s.campaign_id, s.transaction_group
         ORDER BY md5(s.campaign_id || '|' || CAST(s.site AS VARCHAR) || '|stores')) AS n
  FROM strata s JOIN (SELECT campaign_id, transaction_group,
         round(count(*) * 50.0 / sum(count(*)) OVER (PARTITION BY campaign_id)) AS stratified_sample_size
         FROM strata GROUP BY 1, 2) z ON z.campaign_id = s.campaign_id AND z.transaction_group = s.transaction_group) x
WHERE n <= stratified_sample_size"""


def site_weeks(r):
    from counterlift.functions import week_start
    from counterlift.operators.store_sales import in_store
    return (in_store(r.sales)
            .groupBy("site", week_start("txn_date", "MON").alias("sales_week"))
            .agg(F.count_distinct("basket_key").alias("n_transactions"), F.sum("sales_amount").alias("sales_amount")))


def dense(r):
    return D.densify(site_weeks(r), ["site"], "sales_week", ["n_transactions", "sales_amount"])


def allocated(r):
    return D.allocate(r.sites, [(20, "Test 1"), (45, "Test 2")], "Control", "alloc")


def stratified(r):
    return D.stratified_stores(D.weekly_averages(q.weekly(r)), 1.2, 3, 50, "stores")


@query("dense_weekly_panel", "SELECT * FROM dense_weeks", money="sales_amount")
def _(r):
    return dense(r)


@query("dense_campaign_panel", """
SELECT x.campaign_id, x.site, x.sales_week, coalesce(w.n_transactions, 0) AS n_transactions
FROM (SELECT DISTINCT w.campaign_id, w.site, k.sales_week FROM weekly w CROSS JOIN (SELECT CAST(unnest(generate_series(
      (SELECT min(sales_week) FROM weekly), (SELECT max(sales_week) FROM weekly), INTERVAL 7 DAY)) AS DATE) AS sales_week) k) x
LEFT JOIN weekly w ON w.campaign_id = x.campaign_id AND w.site = x.site AND w.sales_week = x.sales_week""")
def _(r):
    return D.densify(q.weekly(r), ["campaign_id", "site"], "sales_week", ["n_transactions"])


@query("activity_gate", """
SELECT site, count(CASE WHEN n_transactions = 0 THEN 1 END) AS n_weeks_no_baskets,
       count(CASE WHEN n_transactions > 0 THEN 1 END) AS n_weeks_with_baskets
FROM dense_weeks GROUP BY 1 HAVING count(CASE WHEN n_transactions = 0 THEN 1 END) = 0""")
def _(r):
    return D.activity_gate(dense(r))


@query("random_allocation", "SELECT * FROM allocated")
def _(r):
    return allocated(r)


@query("allocation_assignment", """
SELECT site, random_allocation, cohort, assignment, n_store FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort, assignment ORDER BY random_allocation) AS n_store FROM (
    SELECT a.*, CASE WHEN a.site IN (SELECT test_store FROM area_nearest WHERE abs_perc_diff <= 0.1 UNION
                SELECT control_store FROM area_nearest WHERE abs_perc_diff <= 0.1)
           THEN 'Assigned' ELSE 'Unassigned' END AS assignment FROM allocated a) x) y
WHERE n_store <= 10 OR cohort = 'Control'""")
def _(r):
    close = mq.area_nearest(r).filter(F.col("abs_perc_diff") <= 0.1)
    return D.assignment(allocated(r), close, 10)


@query("stratified_stores", "SELECT * FROM strata_sample", ratio="weekly_average_baskets stratified_sample_size")
def _(r):
    return stratified(r)


@query("required_sample_size", """
SELECT campaign_id, transaction_group, m AS mean_transactions, s AS stddev_transactions,
       power((1.96 + 0.84) * s / (0.1 * m), 2) AS sample_size_per_group,
       CAST(ceil(power((1.96 + 0.84) * s / (0.1 * m), 2)) AS BIGINT) AS recommended_control_stores
FROM (SELECT campaign_id, transaction_group, avg(weekly_average_baskets) AS m, stddev_samp(weekly_average_baskets) AS s
      FROM strata_sample GROUP BY 1, 2) x""", ratio="mean_transactions stddev_transactions sample_size_per_group")
def _(r):
    return D.required_stores(stratified(r), ["campaign_id", "transaction_group"])


@query("required_sample_size_campaign", """
SELECT campaign_id, m AS mean_transactions, s AS stddev_transactions,
       power((1.96 + 0.84) * s / (0.1 * m), 2) AS sample_size_per_group,
       CAST(ceil(power((1.96 + 0.84) * s / (0.1 * m), 2)) AS BIGINT) AS recommended_control_stores
FROM (SELECT campaign_id, avg(weekly_average_baskets) AS m, stddev_samp(weekly_average_baskets) AS s
      FROM weekly_avg GROUP BY 1) x""", ratio="mean_transactions stddev_transactions sample_size_per_group")
def _(r):
    return D.required_stores(D.weekly_averages(q.weekly(r)))


@query("mde_sample_sizes", """
SELECT campaign_id, site, mean_transactions, stddev_transactions,
       power(2.8, 2) * 2 * power(stddev_transactions, 2) / power(0.1 * mean_transactions, 2) AS required_10,
       power(2.8, 2) * 2 * power(stddev_transactions, 2) / power(0.2 * mean_transactions, 2) AS required_20,
       power(2.8, 2) * 2 * power(stddev_transactions, 2) / power(0.3 * mean_transactions, 2) AS required_30
FROM baseline""", ratio="mean_transactions stddev_transactions required_10 required_20 required_30")
def _(r):
    return D.mde_sizes(q.baseline(r))


@query("duration_margin_grid", """
SELECT campaign_id, daily_units, control_stores, effect_size, need / (daily_units * control_stores) AS duration_days,
       1.645 * 0.5 / sqrt(daily_units * control_stores * (need / (daily_units * control_stores))) AS margin_of_error
FROM (SELECT v.*, CAST(c.control_stores AS BIGINT) AS control_stores, CAST(e.effect_size AS DOUBLE) AS effect_size,
             power((1.645 + 0.84) / e.effect_size, 2) * 2 * 0.25 AS need
      FROM (SELECT campaign_id, avg(mean_transactions) / 7 AS daily_units FROM baseline GROUP BY 1) v
      CROSS JOIN (VALUES (20), (40), (100)) c(control_stores) CROSS JOIN (VALUES (0.01), (0.02), (0.03)) e(effect_size)) x""",
       ratio="daily_units effect_size duration_days margin_of_error")
def _(r):
    volumes = q.baseline(r).groupBy("campaign_id").agg((F.avg("mean_transactions") / 7).alias("daily_units"))
    return D.duration_margin(volumes, [20, 40, 100], [0.01, 0.02, 0.03])


@query("histogram_zero_edge", """
SELECT campaign_id, floor(perc_change_in_sales / 0.5) * 0.5 AS bin_start, count(*) AS n,
       count(CASE WHEN perc_change_in_sales > 0 THEN 1 END) AS n_positive,
       count(CASE WHEN perc_change_in_sales < 0 THEN 1 END) AS n_negative
FROM panel WHERE perc_change_in_sales IS NOT NULL GROUP BY 1, 2""", ratio="bin_start")
def _(r):
    return D.histogram(q.panel(r), ["campaign_id"], "perc_change_in_sales")
