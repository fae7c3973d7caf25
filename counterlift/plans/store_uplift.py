"""Store-level measurement from sales to campaign effects, all campaigns in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from counterlift.operators import campaign_matching, effects, matching, store_sales
from counterlift.session import cut_lineage


@dataclass(frozen=True)
class StoreUpliftOptions:
    lookback_weeks: int = 13
    gap_weeks: int = 1
    history_divisor: float = 12
    min_matched_stores: int = 50
    max_abs_effect: float | None = 0.2


def store_uplift(
    sales: DataFrame,
    campaigns: DataFrame,
    skus: DataFrame,
    stores: DataFrame,
    options: StoreUpliftOptions = StoreUpliftOptions(),
) -> DataFrame:
    """Normalised sales effect of test stores against one-to-one matched controls."""
    weekly = store_sales.weekly_store_sales(
        sales, campaigns, skus, options.lookback_weeks, options.gap_weeks
    )
    # both are read for the test and for the control side of every pair
    baseline = cut_lineage(store_sales.baseline_stats(weekly))
    during = cut_lineage(store_sales.campaign_sales(sales, campaigns, skus, stores))
    features = matching.match_features(baseline, stores, options.history_divisor)
    matched = cut_lineage(matching.two_pass_unique(campaign_matching.nearest_control_of_all(features)))
    enough = matching.min_matched(matched, features, options.min_matched_stores)
    kept = matched.join(enough.select("campaign_id"), "campaign_id", "left_semi")
    z = effects.sales_z(kept, during, baseline, options.history_divisor)
    report = effects.campaign_effect(z, campaigns)
    if options.max_abs_effect is None:
        return report
    return effects.trim_outliers(report, max_abs=options.max_abs_effect)
