"""Normalised effects of matched pairs, their significance and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlift.functions import pair_diff, safe_divide
from counterlift.operators.quantiles import quantile_list
from counterlift.operators.store_sales import K

SIDES = ("test", "control")


def both_sides(pairs: DataFrame, facts: DataFrame, how: str = "left", rename: dict[str, str] | None = None) -> DataFrame:
    """Joins site facts once as the test and once as the control store of a pair."""
    names = rename or {c: c for c in facts.columns if c not in (K, "site")}
    out = pairs
    for side in SIDES:
        named = facts.select(
            K, F.col("site").alias(f"{side}_store"), *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()]
        )
        out = out.join(named, [K, f"{side}_store"], how)
    return out


def did_effect(pairs: DataFrame, uplifts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Test minus control uplift; significant beyond one deviation of either store."""
    up = uplifts.select(K, "site", "perc_sales_uplift", "raw_sales_uplift")
    out = both_sides(pairs, up, "inner", {"perc_sales_uplift": "perc_uplift", "raw_sales_uplift": "raw_uplift"})
    out = both_sides(out, baseline.select(K, "site", "stddev_sales_amount"))
    raw = F.col("test_raw_uplift") - F.col("control_raw_uplift")
    beyond = (F.abs(raw) > F.col("test_stddev_sales_amount")) | (F.abs(raw) > F.col("control_stddev_sales_amount"))
    return out.withColumns(
        {
            "perc_uplift_effect": F.col("test_perc_uplift") - F.col("control_perc_uplift"),
            "raw_uplift_effect": raw,
            "significance": F.when(beyond, "Significant").otherwise("Not Significant"),
        }
    )


def sales_z(pairs: DataFrame, during: DataFrame, baseline: DataFrame, divisor: float | None = 12) -> DataFrame:
    """z-scores of campaign sales against the weekly history, per side, and their difference."""
    weeks = F.lit(divisor) if divisor else F.col("weeks_count")
    history = baseline.select(
        K, "site", safe_divide("sales_amount", weeks).alias("mean_sales"), F.col("stddev_sales_amount").alias("std_sales")
    )
    campaign = during.select(K, "site", F.col("total_sales_campaign_period").alias("campaign_sales"))
    out = both_sides(both_sides(pairs, history), campaign)
    cols = {}
    for s in SIDES:
        z = safe_divide(F.col(f"{s}_campaign_sales") - F.col(f"{s}_mean_sales"), F.col(f"{s}_std_sales"))
        cols[f"{s}_sales_z_score"] = z
        cols[f"{s}_dollars_vs_expectation"] = z * F.col(f"{s}_mean_sales")
    return out.withColumns(cols).withColumn(
        "z_score_diff", F.col("test_sales_z_score") - F.col("control_sales_z_score")
    )


def campaign_effect(z: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Sums and averages per campaign with the sign-corrected relative difference."""
    dims = [c for c in campaigns.columns if c != K]
    t, c = F.sum("test_dollars_vs_expectation"), F.sum("control_dollars_vs_expectation")
    zt, zc = F.avg("test_sales_z_score"), F.avg("control_sales_z_score")
    agg = z.groupBy(K).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        t.alias("test_dollars_vs_expectation"),
        c.alias("control_dollars_vs_expectation"),
        (t - c).alias("dollars_difference"),
        zt.alias("avg_test_z_score"),
        zc.alias("avg_control_z_score"),
        F.avg("z_score_diff").alias("avg_z_score_diff"),
        F.avg("test_std_sales").alias("avg_test_std_sales"),
        F.avg("control_std_sales").alias("avg_control_std_sales"),
    )
    return (
        agg.withColumns(
            {
                "percentage_diff_in_dollars": pair_diff(
                    "test_dollars_vs_expectation", "control_dollars_vs_expectation", "sign_flip"
                ),
                "percentage_diff_in_z_score": pair_diff("avg_test_z_score", "avg_control_z_score", "sign_flip"),
            }
        )
        .join(campaigns.select(K, *dims), K, "left")
    )


def trim_outliers(
    effects: DataFrame, column: str = "percentage_diff_in_dollars", max_abs: float | None = 0.2, n_sd: float | None = None
) -> DataFrame:
    """Keeps effects of at most ``max_abs``, or within ``mean + n_sd`` deviations."""
    if n_sd is None:
        return effects.filter(F.abs(F.col(column)) <= max_abs)
    limit = effects.select((F.avg(column) + n_sd * F.stddev_samp(column)).alias("_limit"))
    return effects.crossJoin(F.broadcast(limit)).filter(F.col(column) <= F.col("_limit")).drop("_limit")


def empirical_pair_diff(pairs: DataFrame, sales: DataFrame, baseline: DataFrame, method: str = "control_abs") -> DataFrame:
    """Relative difference of the pair's z-scores against the weekly average."""
    facts = (
        baseline.join(sales, [K, "site"])
        .select(
            K,
            "site",
            safe_divide(F.col("campaign_sales") - F.col("weekly_avg_sales_amount"), "stddev_sales_amount").alias("z"),
            F.col("weekly_avg_sales_amount").alias("mean"),
        )
    )
    out = both_sides(pairs, facts, "inner")
    return out.withColumns(
        {
            "z_score_perc_diff": pair_diff("test_z", "control_z", method),
            "test_z_times_mean": F.col("test_z") * F.col("test_mean"),
            "control_z_times_mean": F.col("control_z") * F.col("control_mean"),
        }
    )


def percentage_change(z: Column, std: Column, mean: Column) -> Column:
    """A z-score turned back into a relative change of the mean."""
    return safe_divide(z * std, mean)


def standardised_uplift(pairs: DataFrame, baseline: DataFrame, sales: DataFrame) -> DataFrame:
    """Uplift divided by the coefficient of variation, differenced and scaled back."""
    facts = baseline.join(sales, [K, "site"]).select(
        K,
        "site",
        safe_divide(F.col("campaign_sales") - F.col("weekly_avg_sales_amount"), "weekly_avg_sales_amount").alias("uplift"),
        safe_divide("stddev_sales_amount", "weekly_avg_sales_amount").alias("cv"),
    )
    out = both_sides(pairs, facts, "inner")
    out = out.withColumns({f"{s}_standardised": safe_divide(f"{s}_uplift", f"{s}_cv") for s in SIDES})
    out = out.withColumn("standardised_incremental", F.col("test_standardised") - F.col("control_standardised"))
    return out.withColumn("adjusted_effect", F.col("standardised_incremental") * F.col("test_cv"))


def pairwise_ate(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Average pair difference per group, e.g. per campaign and week."""
    return df.groupBy(*by).agg(F.avg(value).alias("ate"), F.count(value).alias("n_pairs"))


def ate_summary(ates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ates.groupBy(*by).agg(
        F.min("ate").alias("min_ate"),
        F.max("ate").alias("max_ate"),
        F.avg("ate").alias("avg_ate"),
        F.percentile("ate", F.lit(0.5)).alias("median_ate"),
    )


def pooled_report(pooled: DataFrame, empirical: DataFrame) -> DataFrame:
    """Pooled and empirical effect side by side, under a population row per campaign.

    The population row has NULL stores; its empirical value is the mean over pairs.
    """
    rows = pooled.select(K, "test_store", "control_store", F.col("pooled_effect").alias("pooled")).join(
        empirical.select(K, "test_store", "control_store", F.col("z_score_perc_diff").alias("empirical")),
        [K, "test_store", "control_store"],
        "left",
    )
    head = (
        rows.groupBy(K).agg(F.avg("empirical").alias("empirical"))
        .join(pooled.groupBy(K).agg(F.max("mu_pop").alias("pooled")), K)
        .select(
            K,
            F.lit(None).cast("long").alias("test_store"),
            F.lit(None).cast("long").alias("control_store"),
            "pooled",
            "empirical",
        )
    )
    return head.unionByName(rows)


def quantile_summary(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Quantiles, mean and deviation of a column per group; groups without a value are left out."""
    by = list(by)
    q = quantile_list(df, by, col, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    moments = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))
    return moments.join(q, by).select(*by, "mean", "std", "n", "p05", "p25", "p50", "p75", "p95")


def attributable(
    pairs: DataFrame, daily: DataFrame, min_daily: float = 10, min_controls: int = 100, min_effect: float = 0.01
) -> DataFrame:
    """Average effect over pairs with enough daily baskets, and the attribution flag."""
    busy = daily.filter(
        " AND ".join(f"{s}_daily_baskets_{p} >= {min_daily}" for s in SIDES for p in ("pre", "during"))
    )
    keys = [K, "test_store", "control_store"]
    out = (
        pairs.join(busy.select(*keys), keys, "left_semi")
        .groupBy(K)
        .agg(
            F.count_distinct("test_store").alias("n_test_stores"),
            F.count_distinct("control_store").alias("n_control_stores"),
            F.avg("perc_uplift_effect").alias("avg_uplift_effect"),
        )
    )
    flag = (F.col("n_control_stores") >= min_controls) & (F.col("avg_uplift_effect") >= min_effect)
    return out.withColumn("attributable_to_campaign", F.when(flag, "1").otherwise("0"))


def average_effect(pairs: DataFrame, column: str = "perc_uplift_effect") -> DataFrame:
    return pairs.groupBy(K).agg(F.avg(column).alias("average_uplift_effect"))
