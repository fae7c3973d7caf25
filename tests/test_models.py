"""Closed forms, least squares and clusters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterlift.operators import models as L
from counterlift.operators.media_effects import media_effects
from counterlift.operators.shoppers import FEATURES


def test_shrinkage_lies_between_pair_and_population(spark):
    rows = [("A", i, 100 + i, 0.1 * i - 0.3, 0.05 + 0.02 * i) for i in range(8)]
    stats = spark.createDataFrame(rows, "campaign_id string, test_store long, control_store long, mean double, se double")
    got = L.partial_pool(stats, s0=10.0).collect()
    assert len(got) == 8
    for r in got:
        lo, hi = sorted([r.mean, r.mu_pop])
        assert lo - 1e-9 <= r.pooled_effect <= hi + 1e-9
        assert 0 <= r.weight <= 1
    exact = L.partial_pool(stats.withColumn("se", F.lit(1e-9)), s0=10.0, s1=1.0).collect()
    assert all(abs(r.weight - 1) < 1e-9 for r in exact)


def test_scale_sweep_marks_one_scale(spark):
    rows = [("A", i, 100 + i, 0.4 * i, 0.1) for i in range(6)]
    stats = spark.createDataFrame(rows, "campaign_id string, test_store long, control_store long, mean double, se double")
    got = L.scale_sweep(stats, [0.001, 0.05, 0.2, 1.0], s0=1.0, tol=0.5).collect()
    assert sum(r.accepted for r in got) <= 1
    wide = sorted(got, key=lambda r: r.scale)
    assert wide[0].share_within >= wide[-1].share_within


def test_draws_are_repeatable_and_bounded(spark):
    baskets = spark.createDataFrame([("A", 1, float(v)) for v in range(1, 30)], "campaign_id string, site long, amount double")
    one = L.store_posterior(baskets, 200).orderBy("draw").collect()
    two = L.store_posterior(baskets.repartition(5), 200).orderBy("draw").collect()
    assert [round(r.value, 6) for r in one] == [round(r.value, 6) for r in two]
    values = np.array([r.value for r in one])
    assert values.min() >= 29 * 1 and values.max() <= 29 * 29
    assert abs(values.mean() - 435) < 25


def test_unequal_draws_fail(spark):
    z = spark.createDataFrame([("A", 1, 1, 0.5), ("A", 1, 2, 0.6), ("A", 2, 1, 0.4)], "campaign_id string, site long, draw int, z double")
    pairs = spark.createDataFrame([("A", 1, 2)], "campaign_id string, test_store long, control_store long")
    with pytest.raises(Exception, match="unequal numbers of draws"):
        L.pair_samples(z, pairs).collect()


def test_packed_draws_equal_drawn_rows(spark):
    """No draw is shuffled: only the pairs with both stores' moments are."""
    rng = np.random.default_rng(9)
    baskets = spark.createDataFrame([(k, s, float(v)) for k in "AB" for s in (1, 2, 3) for v in rng.normal(20 + s, 4, 30)] + [("A", 4, 7.0)], "campaign_id string, site long, amount double")
    base = spark.createDataFrame([(k, s, 400.0 + s, 9.0) for k in "AB" for s in (1, 2, 3, 4)], "campaign_id string, site long, weekly_avg_sales_amount double, stddev_sales_amount double")
    pairs = spark.createDataFrame([("A", 1, 2), ("A", 3, 2), ("B", 1, 2), ("A", 4, 2)], "campaign_id string, test_store long, control_store long")
    for value, method in (("z", "control_abs"), ("percentage_change", "difference")):
        got = [{(r.campaign_id, r.test_store, r.control_store, r.draw): r.effect for r in L.pair_samples(L.posterior_z(L.store_posterior(baskets, 50, packed=p), base), pairs, value, method).collect()} for p in (False, True)]
        assert len(got[0]) == 150 and got[0] == pytest.approx(got[1])
    packed = L.posterior_z(L.store_posterior(baskets, 50, packed=True), base)
    plan = L.pair_stats(L.pair_samples(packed, pairs, "z"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")].replace("REPARTITION_BY_COL", "")
    with pytest.raises(Exception, match="unequal numbers of draws"):
        L.pair_samples(packed, spark.createDataFrame([("A", 1, 4)], pairs.schema), "z").collect()


def test_closed_form_pairs_equal_many_draws(spark):
    rng = np.random.default_rng(4)
    rows = [("A", s, float(v)) for s in (1, 2, 3) for v in rng.normal(20 + s, 4, 200)] + [("A", 4, 7.0)]
    post = L.store_posterior(spark.createDataFrame(rows, "campaign_id string, site long, amount double"))
    base = spark.createDataFrame([("A", s, 4000.0 + s) for s in (1, 2, 3, 4)], "campaign_id string, site long, weekly_avg_sales_amount double")
    pairs = spark.createDataFrame([("A", 1, 2), ("A", 1, 3), ("A", 1, 4)], "campaign_id string, test_store long, control_store long")
    got = {r.control_store: r for r in L.pair_posterior(post, base, pairs, 2000).collect()}
    assert set(got) == {2, 3}  # a single basket has no deviation
    facts = {r.site: r for r in post.collect()}
    for c, r in got.items():
        t, q = facts[1], facts[c]
        draws = rng.normal(t.total_mean, t.total_sd, 200_000) / 4001 - rng.normal(q.total_mean, q.total_sd, 200_000) / (4000 + c)
        assert r.mean == pytest.approx(draws.mean(), abs=1e-3) and r.sd == pytest.approx(draws.std(), rel=0.02)
        assert r.se == pytest.approx(r.sd / 2000**0.5)


def test_scale_search_finds_the_step(spark):
    """The share of effects equal to the mean crosses the limit at the scale that is found, and not one percent below it."""
    rng = np.random.default_rng(2)
    rows = [(k, i, 100 + i, float(rng.normal(0, spread)), float(rng.uniform(0.01, 0.3))) for k, spread in (("A", 0.2), ("B", 1.0), ("C", 1e-9)) for i in range(60)]
    stats = spark.createDataFrame(rows, "campaign_id string, test_store long, control_store long, mean double, se double")
    got = {r.campaign_id: r for r in L.scale_search(stats, s0=1.0).collect()}

    def shares(k, scale):
        m, se = np.array([(r[3], r[4]) for r in rows if r[0] == k]).T
        w = 1 / (se**2 + scale**2)
        mu = (w * m).sum() / (w.sum() + 1)
        gap = abs(scale**2 / (scale**2 + se**2) * (m - mu))
        return (gap <= 0.3).mean(), (gap < 1e-6).mean()

    for k in "AB":
        assert shares(k, got[k].scale)[1] < 0.05 <= shares(k, got[k].scale / 1.011)[1]
        assert (got[k].share_within, got[k].share_exact) == pytest.approx(shares(k, got[k].scale))
        assert got[k].accepted == int(got[k].share_within >= 0.46)
    assert got["C"].accepted == 0 and got["C"].scale == pytest.approx(10.0)


def test_media_effects_equal_a_dense_solve(spark):
    rng = np.random.default_rng(6)
    names = ["Screens", "Radio", "Shelf"]
    rows, x, y, g = [], [], [], []
    for k in range(14):
        own = rng.normal(0, 0.8)
        for _ in range(rng.integers(1, 9)):
            on, off = [[n for n in names if rng.random() < 0.5] for _ in range(2)]
            v = [1.0, *[float(n in on) - float(n in off) for n in sorted(names)]]
            effect = v @ np.array([0.3, 1.0, -0.5, 0.2]) + own + rng.normal(0, 0.5)
            rows.append((f"g{k}", float(effect), ", ".join(on), ", ".join(off) or None))
            x.append(v)
            y.append(effect)
            g.append(k)
    results = spark.createDataFrame(rows, "test_group string, effect_sales double, compliant string, other_non_compliant string")
    x, y, same = np.array(x), np.array(y), (np.array(g)[:, None] == np.array(g)[None]).astype(float)
    penalty = np.diag([1e-9, 1.0, 1.0, 1.0])

    def likelihood(ratio):
        v = np.eye(len(y)) + ratio * same
        inverse = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ inverse @ x + penalty, x.T @ inverse @ y)
        rest = y - x @ beta
        s2 = (rest @ inverse @ rest + beta @ penalty @ beta) / len(y)
        return -len(y) * np.log(s2) - np.linalg.slogdet(v)[1], beta

    grid = np.exp(np.linspace(-6, 6, 4001))
    ratio = grid[np.argmax([likelihood(r)[0] for r in grid])]
    got = {r.term: r for r in media_effects(results, replicates=300).collect()}
    want = dict(zip(["(intercept)", *[f"media:{n}" for n in sorted(names)]], likelihood(ratio)[1], strict=True))
    assert {t: r.estimate for t, r in got.items()} == pytest.approx(want, abs=2e-3)
    assert all(r.lo < r.estimate < r.hi for r in got.values())
    assert media_effects(results.limit(0)).collect() == []


def test_trend_bends_where_the_series_does(spark):
    daily = spark.sql("""SELECT 'A' AS campaign_id, date'2024-01-07' AS media_start_date, d AS ds,
        1000D + 2 * datediff(d, date'2022-01-01') - IF(d > date'2023-01-01', 3 * datediff(d, date'2023-01-01'), 0) + 30 * (dayofweek(d) % 3) AS y
        FROM (SELECT explode(sequence(date'2022-01-01', date'2024-01-06')) AS d)""")
    got = L.forecast_residual(daily, yearly=0).collect()
    assert len(got) == 27 and max(abs(r.percentage_error) for r in got) < 3
    model = L.trend_model(daily, yearly=0).collect()
    bends = [r for r in model if r.term == "change"]
    assert len(bends) == 25 and sum(abs(r.estimate) > 1e-6 for r in bends) < 12
    straight = L.trend_model(daily, yearly=0, l1=1e9).collect()
    assert all(r.estimate == 0 for r in straight if r.term == "change")


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(80, 12)), rng.normal(size=80)
    l1, l2 = np.where(np.arange(12) % 3 == 0, 0.0, 6.0), np.full(12, 0.2)
    beta = L.lasso_from_moments(x.T @ x, x.T @ y, l1, l2)
    slope = x.T @ (x @ beta - y) + l2 * beta
    assert np.allclose(slope[beta != 0] + (l1 * np.sign(beta))[beta != 0], 0, atol=1e-6)
    assert (np.abs(slope[beta == 0]) <= l1[beta == 0] + 1e-6).all() and (beta == 0).any()


def test_series_of_few_days(spark):
    rows = [("A", "2024-01-01", 5.0), ("B", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)]
    daily = spark.createDataFrame(rows, "campaign_id string, d string, y double").selectExpr("campaign_id", "date'2024-02-01' AS media_start_date", "date(d) AS ds", "y")
    assert {r.campaign_id for r in L.trend_model(daily).collect()} == {"A", "B"}
    assert L.forecast_residual(daily.limit(0)).collect() == []


def test_forecast_finds_a_weekly_pattern(spark):
    daily = spark.sql("""SELECT 'A' AS campaign_id, date'2024-01-07' AS media_start_date, d AS ds,
        100D + 10 * dayofweek(d) AS y FROM (SELECT explode(sequence(date'2023-09-03', date'2024-01-06')) AS d)""")
    got = L.forecast_residual(daily, yearly=0).collect()
    assert len(got) == 27
    assert max(abs(r.percentage_error) for r in got) < 2


def test_clusters_are_nearest_centres(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in ("A", "B"):
        for i in range(40):
            v = rng.normal(size=8) + (i % 4) * 8
            rows.append((b, "Exposed", str(i), *[float(q) for q in v]))
    feats = spark.createDataFrame(rows, "booking_id string, cohort string, crn string, " + ", ".join(f"{f} double" for f in FEATURES))
    got = L.shopper_clusters(feats, k=4).toPandas()
    assert len(got) == 80 and got.groupby("booking_id")["cluster"].nunique().max() <= 4
    for b, part in got.groupby("booking_id"):
        x = part[FEATURES].to_numpy()
        x = (x - x.mean(0)) / x.std(0, ddof=1)
        labels = part["cluster"].to_numpy()
        names = sorted(set(labels))
        centres = np.array([x[labels == n].mean(0) for n in names])
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        best = np.array(names)[d.argmin(1)]
        assert (best == labels).all()


def test_a_round_of_clusters_returns_sums_of_batches(spark):
    """A round went through every centre of every point in nested lambdas, wrote its centres and read them back."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 8))
    points = spark.createDataFrame([("A" if i < 60 else "B", x[i].tolist()) for i in range(90)], "booking_id string, x array<double>").repartition(3)
    far = [50.0] * 8
    got = L.moved_centres(points, {("A", 1): x[0].tolist(), ("A", 2): x[1].tolist(), ("A", 3): x[1].tolist(), ("A", 4): far})
    own = ((x[:60, None] - x[None, :2]) ** 2).sum(2).argmin(1)
    assert set(got) == {("A", 1), ("A", 2)}  # the lower number wins a tie, a centre without points stays, other campaigns are passed over
    for c in (0, 1):
        assert np.allclose(got["A", c + 1], x[:60][own == c].mean(0), rtol=0, atol=1e-12)
