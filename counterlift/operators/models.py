"""Statistical models as aggregations: posteriors, pooling, regression, clusters, forecast.

Posterior quantities are computed in closed form from grouped moments; repeatable
draws come from hashed keys instead of a sampler's random state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import pair_diff, random_key, safe_divide
from counterlift.operators.shoppers import FEATURES
from counterlift.operators.store_sales import K, tag_sales
from counterlift.session import cut_lineage

PAIR = [K, "test_store", "control_store"]
STILL = 1e-12  # a centre that moves no further stands still: what is left is the rounding of its sum


# ---- store totals --------------------------------------------------------


def hashed_normal(seed: str | Column, *ids: str) -> Column:
    """Standard normal value that depends on nothing but the ids and the seed."""
    digest = random_key(seed, *ids)

    def uniform(at: int) -> Column:
        return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(9))


def _drawn(seed: str, side: str = "") -> Column:
    """Value of one draw of a store, from its moments; ``side`` is the prefix of its columns."""
    total_mean, total_sd, lower, upper = (F.col(side + c) for c in ("total_mean", "total_sd", "lower", "upper"))
    return F.greatest(lower, F.least(upper, total_mean + total_sd * hashed_normal(seed, K, f"{side}site", "draw")))


def _changes(value: Column, side: str = "") -> dict[str, Column]:
    z = safe_divide(value - F.col(f"{side}weekly_avg_sales_amount"), f"{side}stddev_sales_amount")
    return {"z": z, "percentage_change": safe_divide(z * F.col(f"{side}stddev_sales_amount"), f"{side}weekly_avg_sales_amount")}


def store_posterior(baskets: DataFrame, draws: int | None = None, seed: str = "posterior", packed: bool = False) -> DataFrame:
    """Posterior of each store's campaign total, from the moments of its baskets.

    Mean ``n * mean`` and deviation ``sqrt(n) * std``; draws stay inside
    ``[n * min, n * max]``, the range of the flat prior. ``packed`` keeps one row per store with its
    moments, ``draws`` and ``seed``, from which ``pair_samples`` makes the same draws where they are used.
    """
    moments = baskets.groupBy(K, "site").agg(
        F.count("amount").alias("n"), F.avg("amount").alias("m"), F.stddev_samp("amount").alias("s"),
        F.min("amount").alias("lo"), F.max("amount").alias("hi"),
    )
    n = F.col("n")
    post = moments.select(
        K, "site", n, (n * F.col("m")).alias("total_mean"), (F.sqrt(n) * F.col("s")).alias("total_sd"),
        (n * F.col("lo")).alias("lower"), (n * F.col("hi")).alias("upper"),
    )
    if draws is None:
        return post
    known = post.filter(F.col("total_sd").isNotNull())
    if packed:
        return known.withColumns({"draws": F.lit(draws), "seed": F.lit(seed)})
    return (
        known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("value", _drawn(seed))
        .select(K, "site", "draw", "value")
    )


def posterior_z(draws: DataFrame, baseline: DataFrame) -> DataFrame:
    """Draws as z-scores and relative changes against the weekly baseline; packed draws stay packed."""
    facts = baseline.select(K, "site", "weekly_avg_sales_amount", "stddev_sales_amount")
    met = draws.join(facts, [K, "site"])
    if "draws" in draws.columns:
        return met
    return met.select(K, "site", "draw", *[c.alias(n) for n, c in _changes(F.col("value")).items()])


def _packed_samples(z: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """PAIR, draw, t and c of packed stores: their moments meet, and each pair is unrolled to draws by itself."""
    def named(side: str, store: str) -> DataFrame:
        cols = [F.col(c).alias(side + c) for c in z.columns if c not in (K, "site")]
        return z.select(K, F.col("site").alias(store), *cols)

    met = pairs.select(*PAIR).join(named("t_", "test_store"), [K, "test_store"]).join(named("c_", "control_store"), [K, "control_store"], "left")
    unequal = F.col("c_draws").isNull() | (F.col("c_draws") != F.col("t_draws"))
    checked = F.when(unequal, F.raise_error(F.lit("unequal numbers of draws")).cast("int")).otherwise(F.col("t_draws"))
    rows = met.repartition(*PAIR).withColumns({"t_site": F.col("test_store"), "c_site": F.col("control_store"), "_draws": checked})
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
    side = lambda s: _changes(_drawn(F.col(f"{s}seed"), s), s)[value]
    return drawn.select(*PAIR, "draw", side("t_").alias("t"), side("c_").alias("c"))


def pair_samples(z: DataFrame, pairs: DataFrame, value: str = "z", method: str = "control_abs") -> DataFrame:
    """Draw-aligned difference of both stores of each pair; fails on unequal draws.

    Packed stores (``store_posterior``) are drawn after their moments have met, so that no draw is shuffled.
    """
    diff = pair_diff("t", "c", method) if method != "difference" else F.col("t") - F.col("c")
    if "draws" in z.columns:
        return _packed_samples(z, pairs, value).select(*PAIR, "draw", diff.alias("effect"))
    test = z.select(K, F.col("site").alias("test_store"), "draw", F.col(value).alias("t"))
    control = z.select(K, F.col("site").alias("control_store"), F.col("draw").alias("control_draw"), F.col(value).alias("c"))
    t, c = pairs.select(*PAIR).join(test, [K, "test_store"]).alias("t"), control.alias("c")
    joined = t.join(
        c,
        (F.col(f"t.{K}") == F.col(f"c.{K}"))
        & (F.col("t.control_store") == F.col("c.control_store"))
        & (F.col("t.draw") == F.col("c.control_draw")),
        "left",
    )
    aligned = F.when(F.col("c.control_draw").isNull(), F.raise_error(F.lit("unequal numbers of draws")).cast("double"))
    return joined.select(*[F.col(f"t.{p}").alias(p) for p in PAIR], "t.draw", F.coalesce(aligned, diff).alias("effect"))


def pair_stats(samples: DataFrame) -> DataFrame:
    """Mean, deviation, count and standard error of each pair's samples."""
    return samples.groupBy(*PAIR).agg(
        F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("sd"), F.count("effect").alias("n")
    ).withColumn("se", safe_divide("sd", F.sqrt("n")))


def pair_posterior(post: DataFrame, baseline: DataFrame, pairs: DataFrame, draws: int = 2000) -> DataFrame:
    """Mean, deviation and standard error of the difference of relative changes of each pair, in closed form.

    What ``posterior_z``, ``pair_samples`` and ``pair_stats`` approach with many draws: a store's total is normal, its
    relative change against the weekly baseline too, and so is the difference of two stores. ``draws`` is
    the sample size that the standard error stands for. Stores with a single basket or no baseline have no pair.
    """
    facts = baseline.select(K, "site", "weekly_avg_sales_amount")
    change = post.join(facts, [K, "site"]).select(
        K, "site", safe_divide(F.col("total_mean") - F.col("weekly_avg_sales_amount"), "weekly_avg_sales_amount").alias("m"),
        safe_divide("total_sd", F.abs("weekly_avg_sales_amount")).alias("s"),
    ).filter("m IS NOT NULL AND s IS NOT NULL")
    test = change.select(K, F.col("site").alias("test_store"), F.col("m").alias("tm"), F.col("s").alias("ts"))
    control = change.select(K, F.col("site").alias("control_store"), F.col("m").alias("cm"), F.col("s").alias("cs"))
    sd = F.sqrt(F.col("ts") * F.col("ts") + F.col("cs") * F.col("cs"))
    met = pairs.select(*PAIR).join(test, [K, "test_store"]).join(control, [K, "control_store"])
    return met.select(*PAIR, (F.col("tm") - F.col("cm")).alias("mean"), sd.alias("sd"), F.lit(draws).cast("long").alias("n"), (sd / F.sqrt(F.lit(float(draws)))).alias("se"))


# ---- pooling -------------------------------------------------------------


def _population_mean(df: DataFrame, by: Sequence[str], s0: float) -> DataFrame:
    w = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
    return df.groupBy(*by).agg(
        safe_divide(F.sum(w * F.col("mean")), F.sum(w) + 1 / (s0 * s0)).alias("mu_pop")
    )


def _shrunk(df: DataFrame) -> DataFrame:
    se2 = F.col("se") * F.col("se")
    weight = safe_divide("tau2", F.col("tau2") + se2)
    return df.withColumn("weight", weight).withColumn(
        "pooled_effect", F.col("weight") * F.col("mean") + (1 - F.col("weight")) * F.col("mu_pop")
    )


def partial_pool(stats: DataFrame, s0: float = 0.0035, s1: float | None = None) -> DataFrame:
    """Pair effects shrunk towards their campaign mean.

    The spread between pairs is ``s1`` or, without it, the moment estimate; the
    campaign mean has the prior ``N(0, s0)``.
    """
    known = stats.filter(F.col("se") > 0)
    if s1 is None:
        w = 1 / (F.col("se") * F.col("se"))
        sums = known.groupBy(K).agg(
            F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.sum(w * F.col("mean")).alias("wy"),
            F.sum(w * F.col("mean") * F.col("mean")).alias("wyy"), F.count(F.lit(1)).alias("k"),
        )
        q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w1")
        tau2 = safe_divide(q - (F.col("k") - 1), F.col("w1") - F.col("w2") / F.col("w1"))
        # a single pair has no spread; its denominator is rounding noise
        several = F.when(F.col("k") > 1, tau2)
        spread = sums.select(K, F.greatest(F.lit(0.0), F.coalesce(several, F.lit(0.0))).alias("tau2"))
        known = known.join(spread, K)
    else:
        known = known.withColumn("tau2", F.lit(s1 * s1))
    out = _shrunk(known.join(_population_mean(known, [K], s0), K))
    sd = F.col("se") * F.sqrt("weight")
    return out.select(
        *PAIR, "mean", "se", "tau2", "mu_pop", "weight", "pooled_effect",
        (F.col("pooled_effect") - 1.96 * sd).alias("lo"), (F.col("pooled_effect") + 1.96 * sd).alias("hi"),
    )


def scale_sweep(
    stats: DataFrame, grid: Sequence[float], s0: float = 0.0035, tol: float = 0.3,
    min_share: float = 0.46, max_exact: float = 0.05,
) -> DataFrame:
    """Both acceptance shares for every scale of the grid; the first accepted is marked."""
    scales = F.posexplode(F.array(*[F.lit(float(g)) for g in grid])).alias("step", "scale")
    rows = stats.filter(F.col("se") > 0).select("*", scales).withColumn("tau2", F.col("scale") * F.col("scale"))
    by = [K, "step", "scale"]
    pooled = _shrunk(rows.join(_population_mean(rows, by, s0), by))
    gap = F.abs(F.col("pooled_effect") - F.col("mu_pop"))
    shares = pooled.groupBy(*by).agg(
        F.avg(F.when(gap <= tol, 1.0).otherwise(0.0)).alias("share_within"),
        F.avg(F.when(gap < 1e-6, 1.0).otherwise(0.0)).alias("share_exact"),
    )
    ok = (F.col("share_within") >= min_share) & (F.col("share_exact") < max_exact)
    first = shares.filter(ok).groupBy(K).agg(F.min("step").alias("first"))
    return shares.join(first, K, "left").select(
        K, "scale", "share_within", "share_exact",
        F.coalesce(F.col("step") == F.col("first"), F.lit(False)).cast("int").alias("accepted"),
    )


def _shares(rows: DataFrame, by: Sequence[str], s0: float, tol: float) -> DataFrame:
    """Shares of pooled effects near their campaign's mean and equal to it, per group with its scale."""
    tagged = rows.withColumn("tau2", F.col("scale") * F.col("scale"))
    pooled = _shrunk(tagged.join(_population_mean(tagged, by, s0), list(by)))
    gap = F.abs(F.col("pooled_effect") - F.col("mu_pop"))
    return pooled.groupBy(*by).agg(
        F.avg(F.when(gap <= tol, 1.0).otherwise(0.0)).alias("share_within"), F.avg(F.when(gap < 1e-6, 1.0).otherwise(0.0)).alias("share_exact"))


def scale_search(
    stats: DataFrame, s0: float = 0.0035, tol: float = 0.3, min_share: float = 0.46, max_exact: float = 0.05,
    least: float = 1e-5, most: float = 10.0, points: int = 15, closeness: float = 0.01,
) -> DataFrame:
    """The smallest scale, to a relative ``closeness``, at which few enough effects equal the campaign's mean.

    All campaigns are bracketed at once: a state table holds each one's bracket, every round tries
    ``points`` scales inside all of them in one aggregation and keeps the step at which the
    share falls below ``max_exact``. ``accepted`` says whether enough effects lie within ``tol`` there. A
    campaign that no scale up to ``most`` helps is reported at ``most`` and not accepted.
    """
    known = cut_lineage(stats.filter(F.col("se") > 0).select(K, "mean", "se"))
    state = known.select(K).distinct().withColumns({"lo": F.lit(math.log(least)), "hi": F.lit(math.log(most))})
    width = math.log(most / least)
    while True:
        steps = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda i: F.struct(i.alias("step"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points + 1)).alias("at")))
        tried = state.select(K, F.explode(steps).alias("t")).select(K, "t.step", "t.at", F.exp("t.at").alias("scale"))
        rows = known.join(tried, K)
        shares = cut_lineage(tried.join(_shares(rows, [K, "step", "scale"], s0, tol), [K, "step", "scale"]))
        good = F.col("share_exact") < max_exact
        first = shares.groupBy(K).agg(F.coalesce(F.min(F.when(good, F.col("step"))), F.lit(points + 1)).alias("first"))
        width /= points + 1
        at = shares.join(first, K)
        if width <= closeness:
            ends = at.filter(F.col("step") == F.col("first"))
            return ends.select(K, "scale", "share_within", "share_exact", ((F.col("share_within") >= min_share) & good).cast("int").alias("accepted"))
        lo, hi = F.max(F.when(F.col("step") <= F.greatest(F.col("first") - 1, F.lit(0)), F.col("at"))), F.min(F.when(F.col("step") >= F.col("first"), F.col("at")))
        state = cut_lineage(at.groupBy(K).agg(lo.alias("lo"), hi.alias("hi")))


# ---- forecast ------------------------------------------------------------


def daily_campaign_sales(sales: DataFrame, campaigns: DataFrame, skus: DataFrame, days_before: int = 2 * 365 + 28) -> DataFrame:
    """campaign_id, media_start_date, ds, y: sales of the campaign SKUs per day before the start, two years of them."""
    lo, hi = F.date_sub("media_start_date", days_before), F.date_sub("media_start_date", 1)
    return (
        tag_sales(sales, campaigns.select(K, "media_start_date"), skus, lo, hi)
        .groupBy(K, "media_start_date", F.col("txn_date").alias("ds"))
        .agg(F.sum("sales_amount").alias("y"))
    )


def _calendar(days: np.ndarray, origin: float, span: float, changes: np.ndarray, weekly: int, yearly: int) -> np.ndarray:
    """Columns of the model: level, slope, a bend at every change point, weekly and yearly waves."""
    t = (days - origin) / span
    columns = [np.ones_like(t), t, *[np.maximum(0.0, t - c) for c in changes]]
    for period, order in ((7.0, weekly), (365.25, yearly)):
        for n in range(1, order + 1):
            angle = days * (2 * math.pi * n / period)
            columns += [np.sin(angle), np.cos(angle)]
    return np.stack(columns, 1)


def lasso_from_moments(gram: np.ndarray, moment: np.ndarray, l1: np.ndarray, l2: np.ndarray, tol: float = 1e-10, most: int = 20_000) -> np.ndarray:
    """Minimiser of b'Gb/2 - m'b + sum(l1 |b|) + sum(l2 b^2)/2 by coordinate descent.

    Starts at the solution without the L1 part; ends when a sweep moves no coefficient by more than ``tol`` of the
    largest, or after ``most`` sweeps.
    """
    free = l1 == 0
    beta = np.zeros(len(moment))
    beta[free] = np.linalg.lstsq(gram[np.ix_(free, free)] + np.diag(l2[free] + 1e-9), moment[free], rcond=None)[0]
    left = moment - gram @ beta  # what is not yet explained, kept up to date
    usable = np.flatnonzero(np.diag(gram) + l2 > 0).tolist()
    scales, penalties = (np.diag(gram) + l2).tolist(), l1.tolist()
    for _ in range(most):
        moved = 0.0
        for j in usable:
            old = float(beta[j])
            rest = float(left[j]) + gram[j, j] * old
            new = math.copysign(max(0.0, abs(rest) - penalties[j]), rest) / scales[j]
            if new != old:
                left -= gram[j] * (new - old)
                beta[j] = new
                moved = max(moved, abs(new - old))
        if moved <= tol * max(1e-12, float(np.abs(beta).max(initial=0.0))):
            break
    return beta


_TERMS = "term string, place double, estimate double"


def trend_model(daily: DataFrame, horizon: int = 28, changes: int = 25, share: float = 0.8, weekly: int = 3, yearly: int = 10, l1: float = 0.5, ridge: float = 0.1) -> DataFrame:
    """campaign_id, origin, span, scale, term, place and estimate of a trend that bends, fitted per campaign.

    The training days are all days of ``daily`` up to ``horizon`` days before the media start, so a series has as many
    rows as its history has days. The slope may change at ``changes`` places spread over the first ``share`` of them; an
    L1 penalty keeps most of the changes at zero, a ridge holds the waves. One moment matrix per series
    is built, and coordinate descent works on that alone. Sales are divided by their largest value.
    """
    cut = F.date_sub("media_start_date", horizon)
    train = daily.filter((F.col("ds") <= cut) & F.col("y").isNotNull()).select(K, F.unix_date("ds").cast("double").alias("d"), F.col("y").cast("double").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, y = pdf["d"].to_numpy(), pdf["y"].to_numpy()
        origin, span = float(d[0]), max(1.0, float(d[-1] - d[0]))
        scale = float(np.abs(y).max()) or 1.0
        n = min(changes, max(0, int(share * len(d)) - 1))
        at = (d[np.linspace(0, int(share * len(d)) - 1, n + 1).round().astype(int)[1:]] - origin) / span if n else np.zeros(0)
        x = _calendar(d, origin, span, at, weekly, yearly)
        waves = 2 * (weekly + yearly)
        penalty = np.concatenate(([0.0, 0.0], np.full(len(at), l1), np.zeros(waves)))
        small = np.concatenate((np.full(2 + len(at), 1e-9), np.full(waves, ridge)))
        beta = lasso_from_moments(x.T @ x, x.T @ (y / scale), penalty, small, tol=1e-7, most=2000)
        names = ["level", "slope", *["change"] * len(at)]
        places = [0.0, 0.0, *at.tolist()]
        for period, order in (("week", weekly), ("year", yearly)):
            for k in range(1, order + 1):
                names += [f"{period}_sin", f"{period}_cos"]
                places += [float(k), float(k)]
        head = pd.DataFrame({K: [pdf[K].iloc[0]] * len(names), "origin": origin, "span": span, "scale": scale})
        return head.assign(term=names, place=places, estimate=beta)

    return train.groupBy(K).applyInPandas(fit, f"{K} string, origin double, span double, scale double, {_TERMS}")


def forecast_from(model: DataFrame, days: DataFrame) -> DataFrame:
    """campaign_id, ds and yhat for the days asked for, from the coefficients of ``trend_model``."""
    d = F.unix_date("ds").cast("double")
    t = (d - F.col("origin")) / F.col("span")
    term, place = F.col("term"), F.col("place")

    def wave(period: str, length: float) -> Column:
        angle = d * (2 * math.pi / length) * place
        return F.when(term == f"{period}_sin", F.sin(angle)).when(term == f"{period}_cos", F.cos(angle))

    value = F.coalesce(
        F.when(term == "level", F.lit(1.0)).when(term == "slope", t).when(term == "change", F.greatest(F.lit(0.0), t - place)),
        wave("week", 7.0), wave("year", 365.25))
    return days.join(model, K).groupBy(K, "ds").agg(F.sum(F.col("estimate") * value * F.col("scale")).alias("yhat"))


def forecast_residual(daily: DataFrame, horizon: int = 28, **options) -> DataFrame:
    """Forecast of the last ``horizon`` days before the start from all days before them, with what came true."""
    model = cut_lineage(trend_model(daily, horizon, **options))
    late = daily.filter(F.col("ds") > F.date_sub("media_start_date", horizon)).select(K, "ds", F.col("y").cast("double").alias("y"))
    return (
        late.join(forecast_from(model, late.select(K, "ds")), [K, "ds"])
        .withColumn("residual", F.col("yhat") - F.col("y"))
        .withColumn("percentage_error", safe_divide("residual", F.abs("y")) * 100)
    )


# ---- clusters ------------------------------------------------------------


def standardised(feats: DataFrame) -> DataFrame:
    """``feats`` with x, the features less their campaign's mean, over its deviation; 0 where they do not vary."""
    stats = feats.groupBy("booking_id").agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_samp(f).alias(f"s_{f}") for f in FEATURES]
    )
    scaled = F.array(*[F.coalesce(safe_divide(F.col(f) - F.col(f"m_{f}"), f"s_{f}"), F.lit(0.0)) for f in FEATURES])
    return feats.join(stats, "booking_id").select(*feats.columns, scaled.alias("x"))


def first_centres(points: DataFrame, k: int, seed: str) -> DataFrame:
    """booking_id, cluster and x of ``k`` shoppers with distinct features per campaign, by a hashed key."""
    distinct = points.groupBy("booking_id", "x").agg(F.min("crn").alias("crn")).withColumn("key", random_key(seed, "booking_id", "crn"))
    # each slice of the key's range keeps its first k, so that no task sorts a whole campaign
    sliced = W.partitionBy("booking_id", F.substring("key", 1, 2)).orderBy("key")
    few = distinct.withColumn("n", F.row_number().over(sliced)).filter(F.col("n") <= k)
    first = F.row_number().over(W.partitionBy("booking_id").orderBy("key"))
    return few.withColumn("cluster", first).filter(F.col("cluster") <= k).select("booking_id", F.col("cluster").cast("long").alias("cluster"), "x")


def assign_clusters(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` with cluster and squared distance of the nearest centre; the lower number wins a tie."""
    known = centres.groupBy("booking_id").agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("x").alias("c")))).alias("centres"))  # k of them
    gap = lambda c: F.aggregate(F.zip_with("x", c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    nearest = F.array_min(F.transform("centres", lambda c: F.struct(gap(c["c"]).alias("d"), c["cluster"].alias("cluster"))))
    return points.join(known, "booking_id").withColumn("n", nearest).select(
        *points.columns, F.col("n.cluster").alias("cluster"), F.col("n.d").alias("distance"))


def moved_centres(points: DataFrame, centres: dict[tuple[str, int], list[float]]) -> dict[tuple[str, int], list[float]]:
    """Centres moved to the mean of their points; one without points is not named. Points of other campaigns are passed over.

    The centres are sent to the tasks, which return the sums of a batch per centre; only those are shuffled.
    """
    numbers: dict[str, list[int]] = {}
    for booking, cluster in sorted((key for key in centres if key[0] is not None), key=lambda key: key[1]):
        numbers.setdefault(booking, []).append(cluster)
    known = {b: (np.array(n), np.array([centres[b, c] for c in n], float)) for b, n in numbers.items()}

    def sums(batches):
        for pdf in batches:
            for booking, some in pdf.groupby("booking_id", sort=False):
                if booking not in known:
                    continue
                number, at = known[booking]
                x = np.stack(some["x"].to_list())
                gaps = np.zeros((len(x), len(at)))
                for p, q in zip(x.T, at.T, strict=True):
                    gaps += (p[:, None] - q) * (p[:, None] - q)
                own = np.where(np.isnan(gaps), np.inf, gaps).argmin(1)  # the lower number wins a tie
                total = np.stack([np.bincount(own, p, len(at)) for p in x.T], 1)
                yield pd.DataFrame({"booking_id": booking, "cluster": number, "n": np.bincount(own, minlength=len(at)), "total": total.tolist()})

    part = points.select("booking_id", "x").mapInPandas(sums, "booking_id string, cluster long, n long, total array<double>")
    total = part.groupBy("booking_id", "cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(len(FEATURES))]).alias("total"))
    return {(r.booking_id, r.cluster): [t / r.n for t in r.total] for r in total.filter("n > 0").collect()}


def shopper_clusters(feats: DataFrame, k: int = 10, seed: str = "clusters", tol: float = 1e-6) -> DataFrame:
    """k-means of standardised features for all campaigns at once, until no centre moves by more than ``tol``.

    Each round is one job. The ``k`` centres of a campaign go through the driver; a campaign whose centres stand still
    takes no part in later rounds. Campaigns with fewer distinct shoppers get fewer clusters.
    """
    points = cut_lineage(standardised(feats))
    first = first_centres(points, k, seed)
    centres = {(r.booking_id, r.cluster): r.x for r in first.collect()}
    moving = {booking for booking, _ in centres}
    while True:
        moved = moved_centres(points, {key: x for key, x in centres.items() if key[0] in moving})
        shifts = {key: max(abs(a - b) for a, b in zip(x, centres[key], strict=True)) for key, x in moved.items()}
        centres |= moved
        if max(shifts.values(), default=0.0) <= tol:
            return assign_clusters(points, feats.sparkSession.createDataFrame([(*key, x) for key, x in centres.items()], first.schema)).drop("x")
        moving = {booking for (booking, _), shift in shifts.items() if shift > STILL}
