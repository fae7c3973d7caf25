"""Similarity of stores by how they moved in earlier campaigns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.operators.store_sales import K

SALES_CHANGE, SHARE_CHANGE = "perc_change_in_sales", "perc_change_in_share"


def store_change_pairs(panel: DataFrame, block: Sequence[str] = ()) -> DataFrame:
    """Differences in relative change between each store and the others of its block."""
    keys = [K, "campaign_start_date", *block]
    one = panel.select(*keys, "site", SALES_CHANGE, SHARE_CHANGE)
    two = panel.select(
        *keys,
        F.col("site").alias("other"),
        F.col(SALES_CHANGE).alias("other_change_in_sales"),
        F.col(SHARE_CHANGE).alias("other_change_in_share"),
    )
    return (
        one.join(two, keys)
        .filter(F.col("site") != F.col("other"))
        .withColumns(
            {
                "abs_diff_sales": F.abs(F.col(SALES_CHANGE) - F.col("other_change_in_sales")),
                "abs_diff_share": F.abs(F.col(SHARE_CHANGE) - F.col("other_change_in_share")),
            }
        )
    )


def prior_similarity(changes: DataFrame) -> DataFrame:
    """Average difference of each pair over the campaigns that began earlier.

    Pairs are first summed per start date, so the "earlier than" join runs on the
    few start dates instead of on campaigns.
    """
    targets = changes.select(K, "campaign_start_date", "site").distinct()
    daily = changes.groupBy(
        "site", "other", F.col("campaign_start_date").alias("prior_date")
    ).agg(
        F.count_distinct(K).alias("n"),
        F.sum("abs_diff_sales").alias("s"), F.count("abs_diff_sales").alias("ns"),
        F.sum("abs_diff_share").alias("h"), F.count("abs_diff_share").alias("nh"),
    )
    return (
        targets.join(daily, "site")
        .filter(F.col("prior_date") < F.col("campaign_start_date"))
        .groupBy(K, "campaign_start_date", "site", "other")
        .agg(
            F.sum("n").alias("n_prior"),
            F.try_divide(F.sum("s"), F.sum("ns")).alias("avg_diff_sales"),
            F.try_divide(F.sum("h"), F.sum("nh")).alias("avg_diff_share"),
        )
    )


def dedup_unordered(df: DataFrame, cols: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One row per unordered combination of ``cols``: the one in sorted order first."""
    combo = F.array_join(F.array_sort(F.array(*[F.col(c).cast("string") for c in cols])), ", ")
    order = W.partitionBy(*within, "combination").orderBy(*cols)
    return (
        df.withColumn("combination", combo)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def rank_with_support(similarity: DataFrame) -> DataFrame:
    """Partners backed by at least the median number of campaigns, ranked by difference."""
    known = similarity.filter(F.col("avg_diff_sales").isNotNull())
    middle = F.percentile("n_prior", F.lit(0.5)).over(W.partitionBy(K, "site"))
    order = W.partitionBy(K, "site").orderBy("avg_diff_sales", "other")
    return (
        known.withColumn("median_support", middle)
        .filter(F.col("n_prior") >= F.col("median_support"))
        .withColumn("similarity_ranking", F.row_number().over(order))
    )


def attach_compliance(ranked: DataFrame, media: DataFrame) -> DataFrame:
    """Adds the compliant and non-compliant media of both stores of a pair."""
    cols = ["test_group", "compliant", "non_compliant"]
    own = media.select(K, "site", *cols)
    other = media.select(K, F.col("site").alias("other"), *[F.col(c).alias(f"other_{c}") for c in cols])
    return ranked.join(own, [K, "site"], "left").join(other, [K, "other"], "left")


def discordant_pairs(df: DataFrame) -> DataFrame:
    """Best ranked partner with the same media group but another compliance."""
    picked = df.filter(
        (F.col("compliant") != F.col("other_compliant")) & (F.col("test_group") == F.col("other_test_group"))
    )
    fields = [c for c in df.columns if c not in (K, "site", "similarity_ranking")]
    best = F.min(F.struct("similarity_ranking", *fields)).alias("b")
    return picked.groupBy(K, "site").agg(best).select(K, "site", "b.*")


def asset_results(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Average change of compliant stores against their non-compliant partners.

    A partner store is used once per campaign, by the store that ranks it best.
    """
    usable = pairs.filter((F.col("compliant") != "") & (F.col("other_non_compliant") != ""))
    best = F.min(F.struct("similarity_ranking", "site")).alias("b")
    kept = usable.groupBy(K, "other").agg(best).select(K, "other", F.col("b.site").alias("site"))
    perf = changes.select(
        K, "site", "other", SALES_CHANGE, SHARE_CHANGE, "other_change_in_sales", "other_change_in_share"
    )
    return (
        usable.join(kept, [K, "site", "other"], "left_semi")
        .join(perf, [K, "site", "other"], "left")
        .groupBy(K, "test_group", "compliant", "other_non_compliant")
        .agg(
            (F.avg(SALES_CHANGE) - F.avg("other_change_in_sales")).alias("effect_sales"),
            (F.avg(SHARE_CHANGE) - F.avg("other_change_in_share")).alias("effect_share"),
            F.count_distinct("site").alias("n_stores"),
            F.count_distinct("other").alias("n_comparison_stores"),
        )
    )


def media_results(results: DataFrame) -> DataFrame:
    """Averages of the asset results for each medium named in the compliant list."""
    return (
        results.withColumn("media_type", F.explode(F.split("compliant", ", ")))
        .groupBy("media_type")
        .agg(
            F.avg("effect_sales").alias("avg_effect_sales"),
            F.avg("effect_share").alias("avg_effect_share"),
            F.count_distinct(K).alias("n_campaigns"),
        )
    )
