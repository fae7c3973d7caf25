"""Matching, similarity and effect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog import store_queries as q
from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.functions import pair_diff, random_key
from counterlift.operators import campaign_matching as CM
from counterlift.operators import effects as E
from counterlift.operators import matching as M
from counterlift.operators import store_sales as S
from counterlift.plans.store_uplift import StoreUpliftOptions, store_uplift

VIEWS["features"] = """
SELECT b.campaign_id, b.site, b.sales_amount / 12 AS mean, b.stddev_sales_amount AS std, b.weeks_count,
       CASE WHEN t.site IS NOT NULL THEN 'Test' ELSE 'Control' END AS test_or_control
FROM baseline b LEFT JOIN campaign_stores t ON t.campaign_id = b.campaign_id AND t.site = b.site"""
VIEWS["all_pairs"] = """
SELECT *, abs(test_mean / nullif(control_mean, 0) - 1) + abs(test_std / nullif(control_std, 0) - 1) AS abs_perc_diff
FROM (SELECT t.campaign_id, t.site AS test_store, c.site AS control_store, t.mean AS test_mean, t.std AS test_std,
             c.mean AS control_mean, c.std AS control_std, ta.area AS test_area, ca.area AS control_area,
             t.weeks_count AS test_weeks, c.weeks_count AS control_weeks
      FROM features t JOIN features c ON c.campaign_id = t.campaign_id AND c.site <> t.site
      JOIN sites ta ON ta.site = t.site JOIN sites ca ON ca.site = c.site
      WHERE t.test_or_control = 'Test' AND c.test_or_control = 'Control') x"""
VIEWS["area_pairs"] = """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM all_pairs
WHERE test_area = control_area AND abs_perc_diff IS NOT NULL"""
VIEWS["nearest"] = """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, test_store ORDER BY abs_perc_diff, control_store) AS n
  FROM all_pairs WHERE abs_perc_diff IS NOT NULL) x WHERE n = 1"""
VIEWS["matched"] = """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, control_store ORDER BY abs_perc_diff, test_store) AS n
  FROM nearest) x WHERE n = 1"""
VIEWS["z_scores"] = """
SELECT *, test_z * test_mean AS test_d, control_z * control_mean AS control_d, test_z - control_z AS z_diff
FROM (SELECT m.*, f.mean AS test_mean, f.std AS test_std, g.mean AS control_mean, g.std AS control_std,
             d.total_sales_campaign_period AS test_sales, e.total_sales_campaign_period AS control_sales,
             (d.total_sales_campaign_period - f.mean) / nullif(f.std, 0) AS test_z,
             (e.total_sales_campaign_period - g.mean) / nullif(g.std, 0) AS control_z
      FROM matched m
      LEFT JOIN features f ON f.campaign_id = m.campaign_id AND f.site = m.test_store
      LEFT JOIN features g ON g.campaign_id = m.campaign_id AND g.site = m.control_store
      LEFT JOIN during d ON d.campaign_id = m.campaign_id AND d.site = m.test_store
      LEFT JOIN during e ON e.campaign_id = m.campaign_id AND e.site = m.control_store) x"""
VIEWS["effects"] = """
SELECT *, (CASE WHEN test_dollars_vs_expectation < 0 OR control_dollars_vs_expectation < 0 THEN -1 ELSE 1 END)
            * (test_dollars_vs_expectation / nullif(control_dollars_vs_expectation, 0) - 1) AS percentage_diff_in_dollars,
       (CASE WHEN avg_test_z_score < 0 OR avg_control_z_score < 0 THEN -1 ELSE 1 END)
            * (avg_test_z_score / nullif(avg_control_z_score, 0) - 1) AS percentage_diff_in_z_score
FROM (SELECT z.campaign_id, count(*) AS n_pairs, sum(test_d) AS test_dollars_vs_expectation,
             sum(control_d) AS control_dollars_vs_expectation, sum(test_d) - sum(control_d) AS dollars_difference,
             avg(test_z) AS avg_test_z_score, avg(control_z) AS avg_control_z_score, avg(z_diff) AS avg_z_score_diff,
             avg(test_std) AS avg_test_std_sales, avg(control_std) AS avg_control_std_sales,
             c.media_start_date, c.media_end_date, c.campaign_start_date, c.campaign_end_date
      FROM z_scores z LEFT JOIN campaigns c ON c.campaign_id = z.campaign_id
      GROUP BY z.campaign_id, c.media_start_date, c.media_end_date, c.campaign_start_date, c.campaign_end_date) x"""
VIEWS["did"] = """
SELECT m.*, u.perc_sales_uplift AS test_perc_uplift, u.raw_sales_uplift AS test_raw_uplift,
       v.perc_sales_uplift AS control_perc_uplift, v.raw_sales_uplift AS control_raw_uplift,
       b.stddev_sales_amount AS test_stddev_sales_amount, c.stddev_sales_amount AS control_stddev_sales_amount,
       u.perc_sales_uplift - v.perc_sales_uplift AS perc_uplift_effect,
       u.raw_sales_uplift - v.raw_sales_uplift AS raw_uplift_effect,
       CASE WHEN abs(u.raw_sales_uplift - v.raw_sales_uplift) > b.stddev_sales_amount
              OR abs(u.raw_sales_uplift - v.raw_sales_uplift) > c.stddev_sales_amount
            THEN 'Significant' ELSE 'Not Significant' END AS significance
FROM area_nearest m
JOIN uplifted u ON u.campaign_id = m.campaign_id AND u.site = m.test_store
JOIN uplifted v ON v.campaign_id = m.campaign_id AND v.site = m.control_store
LEFT JOIN baseline b ON b.campaign_id = m.campaign_id AND b.site = m.test_store
LEFT JOIN baseline c ON c.campaign_id = m.campaign_id AND c.site = m.control_store"""
VIEWS["area_nearest"] = """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, test_store ORDER BY abs_perc_diff, control_store) AS n
  FROM area_pairs) x WHERE n = 1"""
VIEWS["global_pairs"] = """
SELECT p.campaign_id, p.test_store, p.control_store, p.abs_perc_diff
FROM area_pairs p JOIN (SELECT campaign_id, unnest(ut) AS test_store, unnest(uc) AS control_store FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY len(ut) DESC) AS r FROM scan) s WHERE r = 1) m
ON m.campaign_id = p.campaign_id AND m.test_store = p.test_store AND m.control_store = p.control_store"""


def _sequential(order: str, body: str, pairs: str = "area_pairs") -> str:
    """Pairs taken one after another in ``order``, while both stores are free."""
    return f"""
SELECT * FROM (
WITH RECURSIVE ranked AS (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY {order}) AS n FROM {pairs}),
scan AS (
  SELECT campaign_id, CAST([] AS BIGINT[]) AS ut, CAST([] AS BIGINT[]) AS uc, CAST(0 AS BIGINT) AS n
  FROM (SELECT DISTINCT campaign_id FROM {pairs}) k
  UNION ALL
  SELECT campaign_id, list_append(any_value(ut), t), list_append(any_value(uc), c), n FROM (
    SELECT s.campaign_id, s.ut, s.uc, p.n, p.test_store AS t, p.control_store AS c,
           row_number() OVER (PARTITION BY s.campaign_id ORDER BY p.n) AS r
    FROM scan s JOIN ranked p ON p.campaign_id = s.campaign_id AND p.n > s.n
     AND NOT list_contains(s.ut, p.test_store) AND NOT list_contains(s.uc, p.control_store)) x
  WHERE r = 1 GROUP BY campaign_id, t, c, n),
final AS (
  SELECT campaign_id, unnest(ut) AS test_store, unnest(uc) AS control_store FROM (
    SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY len(ut) DESC) AS r FROM scan) y WHERE r = 1)
{body}) final_rows"""


_PAIRS_BODY = """SELECT p.campaign_id, p.test_store, p.control_store, p.abs_perc_diff
FROM final f JOIN ranked p ON p.campaign_id = f.campaign_id AND p.test_store = f.test_store
 AND p.control_store = f.control_store"""
_GLOBAL = _sequential("abs_perc_diff, test_store, control_store", _PAIRS_BODY)
_INPUT_ORDER = "md5(concat_ws('|', campaign_id, CAST(test_store AS VARCHAR), CAST(control_store AS VARCHAR), 'file')), test_store"
_CAMPAIGN = _sequential("abs_perc_diff, test_store, control_store", _PAIRS_BODY,
                        "(SELECT * FROM all_pairs WHERE abs_perc_diff IS NOT NULL)")
_GREEDY = _sequential(_INPUT_ORDER, _PAIRS_BODY)
del VIEWS["global_pairs"]


def features(r):
    return M.match_features(q.baseline(r), r.campaign_stores)


def area_pairs(r):
    f = features(r).join(r.sites, "site")
    pairs = M.pair_distance(M.candidate_pairs(f, block=["area"]))
    return pairs.select(*M.PAIR, "abs_perc_diff")


def weekly_baseline(r):
    return r.stage("weekly_baseline", lambda: S.baseline_sales(q.weekly(r)))


def nearest(r):
    return CM.nearest_control_of_all(features(r))


def matched(r):
    return r.stage("matched", lambda: M.two_pass_unique(nearest(r)))


def area_nearest(r):
    return r.stage("area_nearest", lambda: M.nearest_control(area_pairs(r)))


def did(r):
    return E.did_effect(area_nearest(r), q.uplifted(r), q.baseline(r))


@query("candidate_pairs", """
SELECT campaign_id, test_store, control_store, test_mean, test_std, control_mean, control_std
FROM all_pairs WHERE test_area = control_area AND test_weeks = control_weeks""",
       money="test_mean test_std control_mean control_std")
def _(r):
    pairs = M.candidate_pairs(features(r).join(r.sites, "site"), ["area"], equal_weeks=True)
    return pairs.drop("area", "weeks_count")


@query("pair_distance", "SELECT * FROM area_pairs", ratio="abs_perc_diff")
def _(r):
    return area_pairs(r)


@query("pair_distance_ratio_sum", """
SELECT campaign_id, test_store, control_store,
       abs(test_mean / nullif(control_mean, 0)) + abs(test_std / nullif(control_std, 0)) AS abs_perc_diff
FROM all_pairs WHERE test_area = control_area AND abs_perc_diff IS NOT NULL""", ratio="abs_perc_diff")
def _(r):
    f = features(r).join(r.sites, "site")
    pairs = M.pair_distance(M.candidate_pairs(f, block=["area"]), method="ratio_sum")
    return pairs.select(*M.PAIR, "abs_perc_diff")


@query("nearest_control", "SELECT * FROM nearest", ratio="abs_perc_diff")
def _(r):
    return nearest(r)


@query("nearest_control_in_area", "SELECT * FROM area_nearest", ratio="abs_perc_diff", result="area_nearest")
def _(r):
    return area_nearest(r)


@query("two_pass_unique", "SELECT * FROM matched", ratio="abs_perc_diff", result="matched")
def _(r):
    return matched(r)


@query("min_matched_gate", """
SELECT m.*, f.test_stores_available, f.control_stores_available
FROM (SELECT campaign_id, count(DISTINCT test_store) AS test_stores_matched,
             count(DISTINCT control_store) AS control_stores_matched FROM matched GROUP BY 1
      HAVING count(DISTINCT test_store) >= 15) m
JOIN (SELECT campaign_id, count(CASE WHEN test_or_control = 'Test' THEN 1 END) AS test_stores_available,
             count(CASE WHEN test_or_control = 'Control' THEN 1 END) AS control_stores_available
      FROM features GROUP BY 1) f ON f.campaign_id = m.campaign_id""")
def _(r):
    return M.min_matched(matched(r), features(r), 15)


@query("global_matching", _GLOBAL, ratio="abs_perc_diff")
def _(r):
    return M.global_match(area_pairs(r))


@query("greedy_matching", _GREEDY, ratio="abs_perc_diff")
def _(r):
    pairs = area_pairs(r).withColumn("ordinal", random_key("file", *M.PAIR))
    return M.greedy_match(pairs, "ordinal")


@query("total_difference", f"""
SELECT campaign_id, count(*) AS n_pairs, sum(abs_perc_diff) AS total_difference FROM ({_GLOBAL}) g GROUP BY 1""",
       ratio="total_difference")
def _(r):
    return M.total_difference(M.global_match(area_pairs(r)))


@query("campaign_matching", _CAMPAIGN, ratio="abs_perc_diff")
def _(r):
    return CM.match_campaigns(features(r))


@query("campaign_total_difference", f"""
SELECT campaign_id, count(*) AS n_pairs, sum(abs_perc_diff) AS total_difference FROM ({_CAMPAIGN}) g GROUP BY 1""",
       ratio="total_difference")
def _(r):
    return M.total_difference(CM.match_campaigns(features(r)))


# the stores that turned out to carry the media: planned ones and every 7th control
VIEWS["ran_stores"] = """
SELECT campaign_id, site FROM features WHERE (test_or_control = 'Test') <> (site % 7 = 0)"""


def ran_stores(r):
    return features(r).filter((F.col("test_or_control") == "Test") != (F.col("site") % 7 == 0))


@query("drop_invalid_pairs", """
SELECT p.* FROM area_nearest p
WHERE NOT EXISTS (SELECT 1 FROM ran_stores s WHERE s.campaign_id = p.campaign_id AND s.site = p.control_store)
  AND EXISTS (SELECT 1 FROM ran_stores s WHERE s.campaign_id = p.campaign_id AND s.site = p.test_store)""",
       ratio="abs_perc_diff")
def _(r):
    return M.drop_invalid(area_nearest(r), ran_stores(r))


@query("first_occurrence_pairs", """
SELECT campaign_id, test_store, control_store, abs_perc_diff FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id, control_store ORDER BY abs_perc_diff, test_store) AS a,
         row_number() OVER (PARTITION BY campaign_id, test_store ORDER BY control_store) AS b FROM area_pairs) x
WHERE a = 1 AND b = 1""", ratio="abs_perc_diff")
def _(r):
    return M.first_occurrence(area_pairs(r))


@query("executed_pairs", """
SELECT p.* FROM area_pairs p
WHERE EXISTS (SELECT 1 FROM ran_stores s WHERE s.campaign_id = p.campaign_id AND s.site = p.test_store)
  AND abs_perc_diff <= 0.5""", ratio="abs_perc_diff")
def _(r):
    return M.executed_pairs(area_pairs(r), ran_stores(r), 0.5)


VIEWS["correlated"] = """
SELECT p.campaign_id, p.test_store, p.control_store,
       sum((a.v - a.mu) * (b.v - b.mu)) / nullif(sqrt(sum((a.v - a.mu) * (a.v - a.mu))) *
                                                 sqrt(sum((b.v - b.mu) * (b.v - b.mu))), 0) AS corr
FROM (SELECT campaign_id, test_store, control_store FROM all_pairs WHERE test_area = control_area) p
JOIN dense_series a ON a.campaign_id = p.campaign_id AND a.site = p.test_store
JOIN dense_series b ON b.campaign_id = p.campaign_id AND b.site = p.control_store AND b.sales_week = a.sales_week
GROUP BY 1, 2, 3"""
VIEWS["dense_series"] = """
SELECT *, avg(v) OVER (PARTITION BY campaign_id, site) AS mu FROM (
  SELECT s.campaign_id, s.site, k.sales_week, coalesce(w.sales_amount, 0) AS v
  FROM (SELECT DISTINCT campaign_id, site FROM weekly) s
  JOIN (SELECT DISTINCT campaign_id, sales_week FROM weekly) k ON k.campaign_id = s.campaign_id
  LEFT JOIN weekly w ON w.campaign_id = s.campaign_id AND w.site = s.site AND w.sales_week = k.sales_week) x"""


@query("correlation_pairs", "SELECT * FROM correlated", ratio="corr")
def _(r):
    return M.correlation_pairs(q.weekly(r), r.campaign_stores, r.sites)


VIEWS["unlike_pairs"] = """
SELECT t.campaign_id, t.site AS test_store, c.site AS control_store,
       round(1 - list_dot_product(t.u, c.u), 9) AS abs_perc_diff
FROM unit_series t JOIN unit_series c ON c.campaign_id = t.campaign_id
JOIN campaign_stores a ON a.campaign_id = t.campaign_id AND a.site = t.site
LEFT JOIN campaign_stores b ON b.campaign_id = c.campaign_id AND b.site = c.site WHERE b.site IS NULL"""
VIEWS["unit_series"] = """
SELECT campaign_id, site, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS u FROM (
  SELECT campaign_id, site, list(CAST(v - mu AS DOUBLE) ORDER BY sales_week) AS d FROM dense_series GROUP BY 1, 2) s
WHERE list_dot_product(d, d) > 0"""
_CORRELATION = _sequential("abs_perc_diff, test_store, control_store", """
SELECT p.campaign_id, p.test_store, p.control_store, 1 - p.abs_perc_diff AS corr
FROM final f JOIN ranked p ON p.campaign_id = f.campaign_id AND p.test_store = f.test_store
 AND p.control_store = f.control_store""", "unlike_pairs")


@query("correlation_matching", _CORRELATION, ratio="corr")
def _(r):
    return CM.match_on_correlation(q.weekly(r), r.campaign_stores)


@query("did_effect", "SELECT * FROM did", money="test_raw_uplift control_raw_uplift raw_uplift_effect "
       "test_stddev_sales_amount control_stddev_sales_amount",
       ratio="abs_perc_diff test_perc_uplift control_perc_uplift perc_uplift_effect")
def _(r):
    return did(r)


@query("sales_z_scores", """
SELECT campaign_id, test_store, control_store, abs_perc_diff, test_mean AS test_mean_sales, test_std AS test_std_sales,
       control_mean AS control_mean_sales, control_std AS control_std_sales, test_sales AS test_campaign_sales,
       control_sales AS control_campaign_sales, test_z AS test_sales_z_score, control_z AS control_sales_z_score,
       test_d AS test_dollars_vs_expectation, control_d AS control_dollars_vs_expectation, z_diff AS z_score_diff
FROM z_scores""", money="test_mean_sales test_std_sales control_mean_sales control_std_sales test_campaign_sales "
       "control_campaign_sales test_dollars_vs_expectation control_dollars_vs_expectation",
       ratio="abs_perc_diff test_sales_z_score control_sales_z_score z_score_diff")
def _(r):
    return E.sales_z(matched(r), q.during(r), q.baseline(r))


_EFFECT_MONEY = ("test_dollars_vs_expectation control_dollars_vs_expectation dollars_difference "
                 "avg_test_std_sales avg_control_std_sales")
_EFFECT_RATIO = ("avg_test_z_score avg_control_z_score avg_z_score_diff percentage_diff_in_dollars "
                 "percentage_diff_in_z_score")


def _effects(r):
    return store_uplift(r.sales, r.campaigns, r.campaign_skus, r.campaign_stores,
                        StoreUpliftOptions(min_matched_stores=1, max_abs_effect=None))


@query("store_uplift_report", "SELECT * FROM effects", money=_EFFECT_MONEY, ratio=_EFFECT_RATIO)
def _(r):
    return _effects(r)


@query("trim_outlier_campaigns", "SELECT * FROM effects WHERE abs(percentage_diff_in_dollars) <= 0.5",
       money=_EFFECT_MONEY, ratio=_EFFECT_RATIO)
def _(r):
    return E.trim_outliers(_effects(r), max_abs=0.5)


@query("trim_by_deviation", """
SELECT e.* FROM effects e CROSS JOIN (SELECT avg(avg_z_score_diff) + 1 * stddev_samp(avg_z_score_diff) AS lim
FROM effects) s WHERE e.avg_z_score_diff <= s.lim""", money=_EFFECT_MONEY, ratio=_EFFECT_RATIO)
def _(r):
    return E.trim_outliers(_effects(r), "avg_z_score_diff", n_sd=1)


VIEWS["campaign_totals"] = "SELECT campaign_id, site, total_sales_campaign_period AS campaign_sales FROM during"
VIEWS["empirical"] = """
SELECT p.*, t.z AS test_z, t.mean AS test_mean, c.z AS control_z, c.mean AS control_mean,
       (t.z - c.z) / nullif(abs(c.z), 0) AS z_score_perc_diff, t.z * t.mean AS test_z_times_mean,
       c.z * c.mean AS control_z_times_mean
FROM area_nearest p JOIN weekly_z t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
JOIN weekly_z c ON c.campaign_id = p.campaign_id AND c.site = p.control_store"""
VIEWS["weekly_z"] = """
SELECT b.campaign_id, b.site, (s.campaign_sales - b.weekly_avg_sales_amount) / nullif(b.stddev_sales_amount, 0) AS z,
       b.weekly_avg_sales_amount AS mean,
       (s.campaign_sales - b.weekly_avg_sales_amount) / nullif(b.weekly_avg_sales_amount, 0) AS uplift, b.cv
FROM baseline_sales b JOIN campaign_totals s ON s.campaign_id = b.campaign_id AND s.site = b.site"""


def campaign_totals(r):
    return q.during(r).select("campaign_id", "site", F.col("total_sales_campaign_period").alias("campaign_sales"))


def empirical(r):
    return E.empirical_pair_diff(area_nearest(r), campaign_totals(r), weekly_baseline(r))


@query("empirical_pair_z_diff", "SELECT * FROM empirical",
       money="test_mean control_mean test_z_times_mean control_z_times_mean",
       ratio="abs_perc_diff test_z control_z z_score_perc_diff")
def _(r):
    return empirical(r)


@query("symmetric_pair_diff", """
SELECT campaign_id, test_store, control_store,
       (test_z - control_z) / nullif(abs(control_z), 0) AS control_abs,
       (test_z - control_z) / nullif(abs(test_z) + abs(control_z), 0) AS sum_abs,
       2 * (test_z - control_z) / nullif(abs(test_z) + abs(control_z), 0) AS half_sum_abs,
       CASE WHEN test_z = 0 AND control_z = 0 THEN 0 WHEN test_z IS NULL OR control_z IS NULL THEN NULL
            ELSE (test_z - control_z) / greatest(abs(test_z), abs(control_z)) * 100 END AS greatest_abs,
       (CASE WHEN test_z < 0 OR control_z < 0 THEN -1 ELSE 1 END) * (test_z / nullif(control_z, 0) - 1) AS sign_flip
FROM empirical""", ratio="control_abs sum_abs half_sum_abs greatest_abs sign_flip")
def _(r):
    names = {"control_abs": "control_abs", "sum_abs": "sum_abs", "half_sum_abs": "half_sum_abs",
             "greatest_abs": "greatest", "sign_flip": "sign_flip"}
    return empirical(r).select(
        *M.PAIR, *[pair_diff("test_z", "control_z", m).alias(n) for n, m in names.items()])


@query("percentage_change", """
SELECT campaign_id, site, z * stddev / nullif(mean, 0) AS percentage_change
FROM (SELECT w.*, b.stddev_sales_amount AS stddev FROM weekly_z w JOIN baseline_sales b
      ON b.campaign_id = w.campaign_id AND b.site = w.site) x""", ratio="percentage_change")
def _(r):
    b = weekly_baseline(r).join(campaign_totals(r), ["campaign_id", "site"])
    from counterlift.functions import safe_divide
    z = safe_divide(F.col("campaign_sales") - F.col("weekly_avg_sales_amount"), "stddev_sales_amount")
    return b.select("campaign_id", "site", E.percentage_change(
        z, F.col("stddev_sales_amount"), F.col("weekly_avg_sales_amount")).alias("percentage_change"))


@query("standardised_uplift", """
SELECT p.*, t.uplift AS test_uplift, t.cv AS test_cv, c.uplift AS control_uplift, c.cv AS control_cv,
       t.uplift / nullif(t.cv, 0) AS test_standardised, c.uplift / nullif(c.cv, 0) AS control_standardised,
       t.uplift / nullif(t.cv, 0) - c.uplift / nullif(c.cv, 0) AS standardised_incremental,
       (t.uplift / nullif(t.cv, 0) - c.uplift / nullif(c.cv, 0)) * t.cv AS adjusted_effect
FROM area_nearest p JOIN weekly_z t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
JOIN weekly_z c ON c.campaign_id = p.campaign_id AND c.site = p.control_store""",
       ratio="abs_perc_diff test_uplift test_cv control_uplift control_cv test_standardised control_standardised "
             "standardised_incremental adjusted_effect")
def _(r):
    return E.standardised_uplift(area_nearest(r), weekly_baseline(r), campaign_totals(r))


@query("pairwise_ate", """
SELECT campaign_id, avg(z_score_perc_diff) AS ate, count(z_score_perc_diff) AS n_pairs FROM empirical GROUP BY 1""",
       ratio="ate")
def _(r):
    return E.pairwise_ate(empirical(r), "z_score_perc_diff", ["campaign_id"])


@query("ate_summary", """
SELECT min(ate) AS min_ate, max(ate) AS max_ate, avg(ate) AS avg_ate, quantile_cont(ate, 0.5) AS median_ate
FROM (SELECT campaign_id, avg(z_score_perc_diff) AS ate FROM empirical GROUP BY 1) x""",
       ratio="min_ate max_ate avg_ate median_ate")
def _(r):
    return E.ate_summary(E.pairwise_ate(empirical(r), "z_score_perc_diff", ["campaign_id"]))


@query("z_score_distribution", """
SELECT test_or_control, avg(z) AS mean, stddev_samp(z) AS std, count(z) AS n, quantile_cont(z, 0.05) AS p05,
       quantile_cont(z, 0.25) AS p25, quantile_cont(z, 0.5) AS p50, quantile_cont(z, 0.75) AS p75,
       quantile_cont(z, 0.95) AS p95
FROM (SELECT w.z, f.test_or_control FROM weekly_z w JOIN features f
      ON f.campaign_id = w.campaign_id AND f.site = w.site) x GROUP BY 1""", ratio="mean std p05 p25 p50 p75 p95")
def _(r):
    from counterlift.functions import safe_divide
    z = (weekly_baseline(r).join(campaign_totals(r), ["campaign_id", "site"])
         .withColumn("z", safe_divide(F.col("campaign_sales") - F.col("weekly_avg_sales_amount"),
                                      "stddev_sales_amount")))
    return E.quantile_summary(S.with_cohort(z, r.campaign_stores), ["test_or_control"], "z")


VIEWS["daily"] = """
SELECT p.campaign_id, p.test_store, p.control_store, t.pre AS test_daily_baskets_pre, t.during AS test_daily_baskets_during,
       c.pre AS control_daily_baskets_pre, c.during AS control_daily_baskets_during
FROM area_nearest p
JOIN basket_rates t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
JOIN basket_rates c ON c.campaign_id = p.campaign_id AND c.site = p.control_store"""
VIEWS["basket_rates"] = """
SELECT campaign_id, site, total_baskets_pre_period / n_days_pre_period AS pre,
       total_baskets_campaign_period / n_days_campaign_period AS during FROM pre_during"""


@query("daily_baskets", "SELECT * FROM daily", ratio="test_daily_baskets_pre test_daily_baskets_during "
       "control_daily_baskets_pre control_daily_baskets_during")
def _(r):
    return S.daily_baskets(area_nearest(r), q.pre_during(r))


@query("attributable_flag", """
SELECT campaign_id, count(DISTINCT test_store) AS n_test_stores, count(DISTINCT control_store) AS n_control_stores,
       avg(perc_uplift_effect) AS avg_uplift_effect,
       CASE WHEN count(DISTINCT control_store) >= 2 AND avg(perc_uplift_effect) >= 0.01 THEN '1' ELSE '0' END
         AS attributable_to_campaign
FROM did d WHERE EXISTS (SELECT 1 FROM daily x WHERE x.campaign_id = d.campaign_id AND x.test_store = d.test_store
  AND x.control_store = d.control_store AND x.test_daily_baskets_pre >= 1 AND x.test_daily_baskets_during >= 1
  AND x.control_daily_baskets_pre >= 1 AND x.control_daily_baskets_during >= 1) GROUP BY 1""",
       ratio="avg_uplift_effect")
def _(r):
    return E.attributable(did(r), S.daily_baskets(area_nearest(r), q.pre_during(r)), 1, 2, 0.01)


@query("average_uplift_effect", """
SELECT campaign_id, avg(perc_uplift_effect) AS average_uplift_effect FROM did GROUP BY 1""",
       ratio="average_uplift_effect")
def _(r):
    return E.average_effect(did(r))
