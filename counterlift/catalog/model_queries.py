"""Model queries: posteriors, pooling, regression, clusters, forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterlift.catalog import campaign_queries as cq
from counterlift.catalog import exposure_queries as e
from counterlift.catalog import matching_queries as mq
from counterlift.catalog.registry import query
from counterlift.catalog.sql_views import VIEWS
from counterlift.operators import effects as E
from counterlift.operators import media_effects as ME
from counterlift.operators import models as L
from counterlift.operators import shoppers as P
from counterlift.operators import similarity as Y
from counterlift.operators import store_sales as S

VIEWS["c_baskets"] = """
SELECT campaign_id, site, basket_key, sum(sales_amount) AS amount FROM store_tagged
WHERE txn_date BETWEEN media_start_date AND media_end_date GROUP BY 1, 2, 3"""
VIEWS["posterior"] = """
SELECT campaign_id, site, count(amount) AS n, count(amount) * avg(amount) AS total_mean,
       sqrt(count(amount)) * stddev_samp(amount) AS total_sd, count(amount) * min(amount) AS lower,
       count(amount) * max(amount) AS upper FROM c_baskets GROUP BY 1, 2"""
VIEWS["post_draws"] = """
SELECT campaign_id, site, draw, greatest(lower, least(upper, total_mean + total_sd *
         sqrt(-2 * ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5) / 4294967296.0)) *
         cos(2 * pi() * ((CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5) / 4294967296.0)))) AS value
FROM (SELECT p.*, d.draw, md5(p.campaign_id || '|' || CAST(p.site AS VARCHAR) || '|' || CAST(d.draw AS VARCHAR) || '|posterior') AS h
      FROM posterior p CROSS JOIN (SELECT unnest(range(1, 21)) AS draw) d WHERE total_sd IS NOT NULL) x"""
VIEWS["post_z"] = """
SELECT d.campaign_id, d.site, d.draw, (d.value - b.weekly_avg_sales_amount) / nullif(b.stddev_sales_amount, 0) AS z,
       (d.value - b.weekly_avg_sales_amount) / nullif(b.stddev_sales_amount, 0) * b.stddev_sales_amount
         / nullif(b.weekly_avg_sales_amount, 0) AS percentage_change
FROM post_draws d JOIN baseline_sales b ON b.campaign_id = d.campaign_id AND b.site = d.site"""
VIEWS["many_draws"] = """
SELECT campaign_id, site, draw, (greatest(lower, least(upper, total_mean + total_sd *
         sqrt(-2 * ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5) / 4294967296.0)) *
         cos(2 * pi() * ((CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5) / 4294967296.0)))) - avg_sales) / nullif(avg_sales, 0) AS change
FROM (SELECT p.*, b.weekly_avg_sales_amount AS avg_sales, d.draw,
             md5(p.campaign_id || '|' || CAST(p.site AS VARCHAR) || '|' || CAST(d.draw AS VARCHAR) || '|posterior') AS h
      FROM posterior p JOIN baseline_sales b ON b.campaign_id = p.campaign_id AND b.site = p.site
      CROSS JOIN (SELECT unnest(range(1, 2001)) AS draw) d
      WHERE total_sd IS NOT NULL AND EXISTS (SELECT 1 FROM area_nearest a WHERE a.campaign_id = p.campaign_id
        AND (a.test_store = p.site OR a.control_store = p.site))) x"""
VIEWS["sim_pairs"] = """
SELECT campaign_id, test_store, control_store FROM area_nearest p
WHERE EXISTS (SELECT 1 FROM post_z z WHERE z.campaign_id = p.campaign_id AND z.site = p.control_store)"""
VIEWS["pair_draws"] = """
SELECT p.campaign_id, p.test_store, p.control_store, t.draw, t.percentage_change - c.percentage_change AS effect
FROM sim_pairs p JOIN post_z t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
LEFT JOIN post_z c ON c.campaign_id = p.campaign_id AND c.site = p.control_store AND c.draw = t.draw"""
VIEWS["pooled"] = """
SELECT *, pooled_effect - 1.96 * se * sqrt(weight) AS lo, pooled_effect + 1.96 * se * sqrt(weight) AS hi FROM (
  SELECT *, weight * mean + (1 - weight) * mu_pop AS pooled_effect FROM (
    SELECT p.campaign_id, p.test_store, p.control_store, p.mean, p.se, p.tau2, m.mu_pop, p.tau2 / (p.tau2 + p.se * p.se) AS weight
    FROM pool_in p JOIN (SELECT campaign_id, sum(mean / (se * se + tau2)) / (sum(1 / (se * se + tau2)) + 1 / (0.0035 * 0.0035)) AS mu_pop
                         FROM pool_in GROUP BY 1) m ON m.campaign_id = p.campaign_id) a) b"""
VIEWS["pool_in"] = """
SELECT p.*, s.tau2 FROM p_exact p JOIN (
  SELECT campaign_id, greatest(0, coalesce(CASE WHEN k > 1 THEN (wyy - wy * wy / w1 - (k - 1)) / nullif(w1 - w2 / w1, 0) END, 0)) AS tau2 FROM (
    SELECT campaign_id, sum(1 / (se * se)) AS w1, sum(1 / (se * se * se * se)) AS w2, sum(mean / (se * se)) AS wy,
           sum(mean * mean / (se * se)) AS wyy, count(*) AS k FROM p_exact WHERE se > 0 GROUP BY 1) a) s
ON s.campaign_id = p.campaign_id WHERE p.se > 0"""
VIEWS["post_change"] = """
SELECT p.campaign_id, p.site, (p.total_mean - b.weekly_avg_sales_amount) / nullif(b.weekly_avg_sales_amount, 0) AS m,
       p.total_sd / nullif(abs(b.weekly_avg_sales_amount), 0) AS s
FROM posterior p JOIN baseline_sales b ON b.campaign_id = p.campaign_id AND b.site = p.site WHERE p.total_sd IS NOT NULL"""
VIEWS["p_exact"] = """
SELECT p.campaign_id, p.test_store, p.control_store, t.m - c.m AS mean, sqrt(t.s * t.s + c.s * c.s) AS sd,
       CAST(2000 AS BIGINT) AS n, sqrt(t.s * t.s + c.s * c.s) / sqrt(2000.0) AS se
FROM area_nearest p JOIN post_change t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
JOIN post_change c ON c.campaign_id = p.campaign_id AND c.site = p.control_store
WHERE t.m IS NOT NULL AND t.s IS NOT NULL AND c.m IS NOT NULL AND c.s IS NOT NULL"""
GRID = [0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
_grid = ", ".join(f"({i}, CAST({g} AS DOUBLE))" for i, g in enumerate(GRID))
VIEWS["sweep"] = f"""
SELECT campaign_id, step, scale, avg(CASE WHEN abs(pooled - mu) <= 0.3 THEN 1.0 ELSE 0.0 END) AS share_within,
       avg(CASE WHEN abs(pooled - mu) < 1e-6 THEN 1.0 ELSE 0.0 END) AS share_exact
FROM (SELECT r.*, m.mu, scale * scale / (scale * scale + se * se) * mean
             + (1 - scale * scale / (scale * scale + se * se)) * m.mu AS pooled
      FROM sweep_in r JOIN (SELECT campaign_id, step, sum(mean / (se * se + scale * scale))
             / (sum(1 / (se * se + scale * scale)) + 1 / (0.0035 * 0.0035)) AS mu FROM sweep_in GROUP BY 1, 2) m
        ON m.campaign_id = r.campaign_id AND m.step = r.step) x GROUP BY 1, 2, 3"""
VIEWS["sweep_in"] = f"SELECT p.*, g.step, g.scale FROM p_exact p CROSS JOIN (VALUES {_grid}) g(step, scale) WHERE se > 0"


def baskets(r):
    t = S.tag_sales(S.in_store(r.sales), r.campaigns, r.campaign_skus, F.col("media_start_date"), F.col("media_end_date"))
    return t.groupBy("campaign_id", "site", "basket_key").agg(F.sum("sales_amount").alias("amount"))


def post_z(r):
    return r.stage("post_z", lambda: L.posterior_z(L.store_posterior(baskets(r), 20), mq.weekly_baseline(r)))


def pair_draws(r):
    sites = post_z(r).select("campaign_id", F.col("site").alias("control_store")).distinct()
    pairs = mq.area_nearest(r).join(sites, ["campaign_id", "control_store"], "left_semi")
    return L.pair_samples(post_z(r), pairs, "percentage_change", "difference")


def exact(r):
    return r.stage("p_exact", lambda: L.pair_posterior(L.store_posterior(baskets(r)), mq.weekly_baseline(r), mq.area_nearest(r)))


def pooled(r):
    return L.partial_pool(exact(r))


@query("store_total_posterior", "SELECT * FROM posterior", money="total_mean total_sd lower upper")
def _(r):
    return L.store_posterior(baskets(r))


@query("store_total_draws", "SELECT * FROM post_draws", money="value")
def _(r):
    return L.store_posterior(baskets(r), 20)


@query("posterior_z", "SELECT * FROM post_z", ratio="z percentage_change", result="post_z")
def _(r):
    return post_z(r)


@query("pair_effect_samples", "SELECT * FROM pair_draws", ratio="effect")
def _(r):
    return pair_draws(r)


@query("pair_mean_standard_error", """
SELECT *, sd / sqrt(n) AS se FROM (
  SELECT p.campaign_id, p.test_store, p.control_store, avg(t.change - c.change) AS mean, stddev_samp(t.change - c.change) AS sd, count(t.change - c.change) AS n
  FROM area_nearest p JOIN many_draws t ON t.campaign_id = p.campaign_id AND t.site = p.test_store
  JOIN many_draws c ON c.campaign_id = p.campaign_id AND c.site = p.control_store AND c.draw = t.draw GROUP BY 1, 2, 3) x""",
       ratio="mean sd se")
def _(r):
    pairs = mq.area_nearest(r)
    sites = pairs.select("campaign_id", F.col("test_store").alias("site")).union(pairs.select("campaign_id", "control_store")).distinct()
    mine = baskets(r).join(sites, ["campaign_id", "site"], "left_semi")
    z = L.posterior_z(L.store_posterior(mine, 2000, packed=True), mq.weekly_baseline(r))
    drawn = z.select("campaign_id", "site").distinct()
    both = pairs.join(drawn.withColumnRenamed("site", "control_store"), ["campaign_id", "control_store"], "left_semi")
    return L.pair_stats(L.pair_samples(z, both, "percentage_change", "difference"))


@query("pair_posterior", "SELECT * FROM p_exact", ratio="mean sd se", result="p_exact")
def _(r):
    return exact(r)


@query("partial_pooling", "SELECT * FROM pooled", ratio="mean se tau2 mu_pop weight pooled_effect lo hi")
def _(r):
    return pooled(r)


@query("pooling_scale_sweep", """
SELECT s.campaign_id, s.scale, s.share_within, s.share_exact,
       CAST(CASE WHEN s.step = f.first THEN 1 ELSE 0 END AS BIGINT) AS accepted
FROM sweep s LEFT JOIN (SELECT campaign_id, min(step) AS first FROM sweep
  WHERE share_within >= 0.46 AND share_exact < 0.05 GROUP BY 1) f ON f.campaign_id = s.campaign_id""",
       ratio="scale share_within share_exact")
def _(r):
    return L.scale_sweep(exact(r), GRID)


def _search_sql(points: int = 15, rounds: int = 3) -> str:
    """The bracketing rounds written out: every round tries ``points`` scales inside each campaign's bracket."""
    steps = ["s0 AS (SELECT DISTINCT campaign_id, ln(CAST(1e-5 AS DOUBLE)) AS lo, ln(CAST(10 AS DOUBLE)) AS hi FROM p_exact WHERE se > 0)"]
    for n in range(rounds):
        steps.append(f"""t{n} AS MATERIALIZED (SELECT *, exp(spot) AS scale FROM (SELECT s.campaign_id, k.step, s.lo + (s.hi - s.lo) * k.step / {points + 1} AS spot
  FROM s{n} s CROSS JOIN (SELECT unnest(range({points + 2})) AS step) k) x),
r{n} AS MATERIALIZED (SELECT t.*, p.mean, p.se FROM t{n} t JOIN p_exact p ON p.campaign_id = t.campaign_id WHERE p.se > 0),
m{n} AS (SELECT campaign_id, step, sum(mean / (se * se + scale * scale)) / (sum(1 / (se * se + scale * scale)) + 1 / (0.0035 * 0.0035)) AS mu
  FROM r{n} GROUP BY 1, 2),
h{n} AS MATERIALIZED (SELECT r.campaign_id, r.step, r.spot, r.scale,
  avg(CASE WHEN abs(r.scale * r.scale / (r.scale * r.scale + r.se * r.se) * (r.mean - m.mu)) <= 0.3 THEN 1.0 ELSE 0.0 END) AS share_within,
  avg(CASE WHEN abs(r.scale * r.scale / (r.scale * r.scale + r.se * r.se) * (r.mean - m.mu)) < 1e-6 THEN 1.0 ELSE 0.0 END) AS share_exact
  FROM r{n} r JOIN m{n} m ON m.campaign_id = r.campaign_id AND m.step = r.step GROUP BY 1, 2, 3, 4),
f{n} AS MATERIALIZED (SELECT h.*, g.first FROM h{n} h JOIN (SELECT campaign_id, coalesce(min(CASE WHEN share_exact < 0.05 THEN step END), {points + 1}) AS first
  FROM h{n} GROUP BY 1) g ON g.campaign_id = h.campaign_id),
s{n + 1} AS (SELECT campaign_id, max(CASE WHEN step <= greatest(first - 1, 0) THEN spot END) AS lo, min(CASE WHEN step >= first THEN spot END) AS hi
  FROM f{n} GROUP BY 1)""")
    return f"""SELECT * FROM (WITH {", ".join(steps)} SELECT campaign_id, scale, share_within, share_exact,
  CAST(CASE WHEN share_within >= 0.46 AND share_exact < 0.05 THEN 1 ELSE 0 END AS BIGINT) AS accepted FROM f{rounds - 1} WHERE step = first) searched"""


@query("pooling_scale_search", _search_sql(), ratio="scale share_within share_exact")
def _(r):
    return L.scale_search(exact(r))


@query("regularised_vs_empirical", """
SELECT * FROM (
  SELECT p.campaign_id, p.test_store, p.control_store, p.pooled_effect AS pooled, e.z_score_perc_diff AS empirical
  FROM pooled p LEFT JOIN empirical e ON e.campaign_id = p.campaign_id AND e.test_store = p.test_store
   AND e.control_store = p.control_store
  UNION ALL
  SELECT p.campaign_id, NULL, NULL, max(p.mu_pop), avg(e.z_score_perc_diff)
  FROM pooled p LEFT JOIN empirical e ON e.campaign_id = p.campaign_id AND e.test_store = p.test_store
   AND e.control_store = p.control_store GROUP BY 1) x""", ratio="pooled empirical")
def _(r):
    return E.pooled_report(pooled(r), mq.empirical(r))


def asset_results(r):
    return r.stage("asset_res", lambda: Y.asset_results(Y.discordant_pairs(cq.with_media(r)), cq.changes(r)))


VIEWS["media_terms"] = """
SELECT row, grp, y, term, sum(value) AS value FROM (
  SELECT row, grp, y, '(intercept)' AS term, 1.0 AS value FROM media_in
  UNION ALL SELECT row, grp, y, 'media:' || trim(m), 1.0 FROM (SELECT *, unnest(list_distinct(string_split(on_media, ', '))) AS m FROM media_in) a WHERE m <> ''
  UNION ALL SELECT row, grp, y, 'media:' || trim(m), -1.0 FROM (SELECT *, unnest(list_distinct(string_split(off_media, ', '))) AS m FROM media_in) b WHERE m <> ''
  UNION ALL SELECT row, grp, y, 'y', y FROM media_in) x GROUP BY 1, 2, 3, 4"""
VIEWS["media_in"] = """
SELECT row_number() OVER () AS row, coalesce(test_group, '') AS grp, CAST(coalesce(effect_sales, 0) AS DOUBLE) AS y,
       coalesce(compliant, '') AS on_media, coalesce(other_non_compliant, '') AS off_media FROM asset_res"""


@query("media_moments", """
SELECT a.grp, a.term AS i, b.term AS j, sum(a.value * b.value) AS value FROM media_terms a JOIN media_terms b ON b.row = a.row
WHERE b.term = 'y' OR (a.term <> 'y' AND a.term <= b.term) GROUP BY 1, 2, 3""", money="value")
def _(r):
    return ME.group_moments(ME.media_rows(asset_results(r)))


@query("media_effects_regression")
def _(r):
    return ME.media_effects(asset_results(r))


def feats(r):
    return r.stage("feats", lambda: e.feats(r))


@query("kmeans_shopper_clusters")
def _(r):
    return L.shopper_clusters(feats(r), k=10)


_Z = ", ".join(f"coalesce(({f} - avg({f}) OVER b) / nullif(stddev_samp({f}) OVER b, 0), 0)" for f in P.FEATURES)
VIEWS["z_feats"] = f"SELECT *, [{_Z}] AS x FROM feats WINDOW b AS (PARTITION BY booking_id)"
VIEWS["k_first"] = f"""
SELECT booking_id, x, row_number() OVER (PARTITION BY booking_id ORDER BY md5(booking_id || '|' || crn || '|clusters')) AS cluster FROM (
  SELECT booking_id, any_value(x) AS x, min(crn) AS crn FROM z_feats GROUP BY booking_id, {", ".join(P.FEATURES)}) d"""


@query("kmeans_first_round", """
SELECT booking_id, cluster, count(*) AS n, sum(d) AS distance FROM (
  SELECT p.booking_id, p.cohort, p.crn, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d FROM (
    SELECT z.*, c.cluster, list_sum(list_transform(list_zip(z.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
    FROM z_feats z JOIN k_first c ON c.booking_id = z.booking_id AND c.cluster <= 10) p
  JOIN (SELECT booking_id, cluster FROM k_first) c ON c.booking_id = p.booking_id AND c.cluster = p.cluster GROUP BY 1, 2, 3) y GROUP BY 1, 2""",
       ratio="distance")
def _(r):
    points = L.standardised(feats(r))
    placed = L.assign_clusters(points, L.first_centres(points, 10, "clusters"))
    return placed.groupBy("booking_id", "cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"))


def daily_history(r):
    return r.stage("daily_history", lambda: L.daily_campaign_sales(r.sales, r.campaigns, r.campaign_skus))


@query("sales_forecast_residual")
def _(r):
    return L.forecast_residual(daily_history(r))


VIEWS["daily_all"] = """
SELECT s.campaign_id, s.txn_date AS ds, sum(s.sales_amount) AS y FROM (
  SELECT k.campaign_id, c.media_start_date, t.txn_date, t.sales_amount FROM sales t JOIN campaign_skus k ON k.article = t.article
  JOIN campaigns c ON c.campaign_id = k.campaign_id
  WHERE t.txn_date BETWEEN c.media_start_date - 758 AND c.media_start_date - 1) s GROUP BY 1, 2"""


@query("forecast_from_coefficients", """
SELECT d.campaign_id, d.ds, k.scale * (0.4 + 0.3 * t - 0.2 * greatest(0, t - 0.5) + 0.1 * sin(2 * pi() / 7 * 2 * n) + 0.05 * cos(2 * pi() / 365.25 * 3 * n)) AS yhat
FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE) AS n FROM daily_all) d
JOIN (SELECT campaign_id, max(y) AS scale, min(CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE)) AS origin FROM daily_all GROUP BY 1) k ON k.campaign_id = d.campaign_id
CROSS JOIN LATERAL (SELECT (d.n - k.origin) / 100 AS t) x""", money="yhat")
def _(r):
    daily = daily_history(r)
    head = daily.groupBy("campaign_id").agg(F.max("y").cast("double").alias("scale"), F.min(F.unix_date("ds")).cast("double").alias("origin"))
    given = [("level", 0.0, 0.4), ("slope", 0.0, 0.3), ("change", 0.5, -0.2), ("week_sin", 2.0, 0.1), ("year_cos", 3.0, 0.05), ("week_cos", 1.0, 0.0)]
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(p).alias("place"), F.lit(b).alias("estimate")) for t, p, b in given])
    model = head.withColumn("span", F.lit(100.0)).select("campaign_id", "scale", "origin", "span", F.explode(terms).alias("e")).select("campaign_id", "scale", "origin", "span", "e.*")
    return L.forecast_from(model, daily.select("campaign_id", "ds"))
