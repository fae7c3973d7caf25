"""Test--control matching: candidates, distances, nearest and one-to-one pairs.

A *feature* frame has ``campaign_id, site, test_or_control, mean, std``; a *pair*
frame has ``campaign_id, test_store, control_store, abs_perc_diff``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import safe_divide
from counterlift.operators.store_sales import K, with_cohort
from counterlift.session import cut_lineage

PAIR = (K, "test_store", "control_store")


def match_features(baseline: DataFrame, stores: DataFrame, divisor: float | None = 12) -> DataFrame:
    """Mean and deviation of weekly sales with the cohort of each site.

    ``divisor`` is the fixed number of weeks of the history; None divides by the
    weeks that had sales.
    """
    weeks = F.lit(divisor) if divisor else F.col("weeks_count")
    return with_cohort(
        baseline.select(
            K,
            "site",
            safe_divide("sales_amount", weeks).alias("mean"),
            F.col("stddev_sales_amount").alias("std"),
            "weeks_count",
        ),
        stores,
    )


def distance(tm, ts, cm, cs, method: str = "abs_perc_diff") -> Column:
    """Distance of mean and deviation of a test and a control store."""
    mean_ratio, std_ratio = safe_divide(tm, cm), safe_divide(ts, cs)
    if method == "abs_perc_diff":
        return F.abs(mean_ratio - 1) + F.abs(std_ratio - 1)
    if method == "ratio_sum":
        return F.abs(mean_ratio) + F.abs(std_ratio)
    raise ValueError(f"unknown distance: {method}")


def candidate_pairs(features: DataFrame, block: Sequence[str] = (), equal_weeks: bool = False) -> DataFrame:
    """Every test x control pair that shares the campaign and the block columns.

    The listing is quadratic in the block, so ``block`` should name something of
    bounded size (a trading area).  Use ``campaign_matching`` where only the best
    partner of each store, or one-to-one pairs, are wanted.
    """
    keys = [K, *block] + (["weeks_count"] if equal_weeks else [])
    test = features.filter(F.col("test_or_control") == "Test").select(
        *keys, F.col("site").alias("test_store"), F.col("mean").alias("test_mean"), F.col("std").alias("test_std")
    )
    control = features.filter(F.col("test_or_control") == "Control").select(
        *keys,
        F.col("site").alias("control_store"),
        F.col("mean").alias("control_mean"),
        F.col("std").alias("control_std"),
    )
    return test.join(control, keys).filter(F.col("test_store") != F.col("control_store"))


def pair_distance(pairs: DataFrame, method: str = "abs_perc_diff") -> DataFrame:
    """Adds ``abs_perc_diff``; pairs without a defined distance are dropped."""
    d = distance("test_mean", "test_std", "control_mean", "control_std", method)
    return pairs.withColumn("abs_perc_diff", d).filter(F.col("abs_perc_diff").isNotNull())


def nearest_control(pairs: DataFrame) -> DataFrame:
    """Best control of every test store; a control may serve several tests."""
    best = F.min(F.struct("abs_perc_diff", "control_store")).alias("b")
    return pairs.groupBy(K, "test_store").agg(best).select(
        K, "test_store", "b.control_store", "b.abs_perc_diff"
    )


def two_pass_unique(nearest: DataFrame) -> DataFrame:
    """Of the tests that chose the same control the closest one keeps it."""
    best = F.min(F.struct("abs_perc_diff", "test_store")).alias("b")
    return nearest.groupBy(K, "control_store").agg(best).select(
        K, "b.test_store", "control_store", "b.abs_perc_diff"
    )


def min_matched(matched: DataFrame, features: DataFrame, threshold: int = 50) -> DataFrame:
    """Campaigns with enough matched test stores, with matched and available counts."""
    got = matched.groupBy(K).agg(
        F.count_distinct("test_store").alias("test_stores_matched"),
        F.count_distinct("control_store").alias("control_stores_matched"),
    )
    available = features.groupBy(K).agg(
        F.count_if(F.col("test_or_control") == "Test").alias("test_stores_available"),
        F.count_if(F.col("test_or_control") == "Control").alias("control_stores_available"),
    )
    return got.filter(F.col("test_stores_matched") >= threshold).join(available, K)


def _one_to_one(edges: DataFrame) -> DataFrame:
    """Sequential free-to-free matching in weight order, computed in parallel rounds.

    An edge that is the lightest at both of its ends is what the sequential scan
    would take, whatever happens elsewhere; taking all such edges at once and
    removing their stores leaves the same problem again, until none is left.  Ties
    are ordered by test, then control, so the result is unique.
    """
    remaining = cut_lineage(edges)
    taken: DataFrame | None = None
    lightest = F.min(F.struct("w", "test_store", "control_store", "abs_perc_diff")).alias("e")
    while taken is None or not remaining.isEmpty():
        by_test = remaining.groupBy(K, "test_store").agg(lightest).select(K, "e")
        by_control = remaining.groupBy(K, "control_store").agg(lightest).select(K, "e")
        chosen = cut_lineage(by_test.join(by_control, [K, "e"]).select(K, "e.test_store", "e.control_store", "e.abs_perc_diff"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        remaining = cut_lineage(
            remaining.join(chosen.select(K, "test_store"), [K, "test_store"], "left_anti").join(
                chosen.select(K, "control_store"), [K, "control_store"], "left_anti"
            )
        )
    return taken


def global_match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs taken by increasing distance from a given pair list."""
    return _one_to_one(pairs.select(*PAIR, "abs_perc_diff", F.col("abs_perc_diff").alias("w")))


def greedy_match(pairs: DataFrame, order_col: str) -> DataFrame:
    """One-to-one pairs taken in input order.

    The number of rounds follows the longest chain of dependent choices: short
    for shuffled input, up to the number of test stores for input sorted by store.
    """
    return _one_to_one(pairs.select(*PAIR, "abs_perc_diff", F.col(order_col).alias("w")))


def total_difference(matched: DataFrame) -> DataFrame:
    return matched.groupBy(K).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("abs_perc_diff").alias("total_difference")
    )


def drop_invalid(pairs: DataFrame, ran: DataFrame) -> DataFrame:
    """Drops pairs whose control turned out to carry the media, or whose test did not.

    ``ran`` holds the campaign and site of every store that carried the media.
    """
    carried = ran.select(K, "site").distinct()
    return pairs.join(
        carried.withColumnRenamed("site", "control_store"), [K, "control_store"], "left_anti"
    ).join(carried.withColumnRenamed("site", "test_store"), [K, "test_store"], "left_semi")


def first_occurrence(pairs: DataFrame) -> DataFrame:
    """Rows that are the first of their control and the first of their test store."""
    per_control = W.partitionBy(K, "control_store").orderBy("abs_perc_diff", "test_store")
    per_test = W.partitionBy(K, "test_store").orderBy("control_store")
    return (
        pairs.withColumns(
            {
                "n_control_store_occurrence": F.row_number().over(per_control),
                "n_test_store_occurrence": F.row_number().over(per_test),
            }
        )
        .filter((F.col("n_control_store_occurrence") == 1) & (F.col("n_test_store_occurrence") == 1))
        .drop("n_control_store_occurrence", "n_test_store_occurrence")
    )


def asof_snapshot(left: DataFrame, snapshots: DataFrame, on: Sequence[str], left_date: str, snap_date: str) -> DataFrame:
    """Rows of ``left`` with the latest snapshot dated strictly before ``left_date``."""
    joined = left.join(snapshots, list(on)).filter(F.col(snap_date) < F.col(left_date))
    newest = joined.groupBy(K).agg(F.max(snap_date).alias("_newest"))
    return joined.join(newest, K).filter(F.col(snap_date) == F.col("_newest")).drop("_newest")


def snapshot_match(pairs: DataFrame, campaigns: DataFrame, similarity: DataFrame) -> DataFrame:
    """Control with the best rank in the latest earlier similarity snapshot, then most support."""
    left = pairs.select(*PAIR).join(campaigns.select(K, "media_start_date"), K)
    snaps = similarity.select(
        F.col("site").alias("test_store"),
        F.col("other").alias("control_store"),
        F.col("campaign_start_date").alias("snapshot_date"),
        "similarity_ranking",
        "n_prior",
    )
    best = F.min(F.struct("similarity_ranking", (-F.col("n_prior")).alias("neg"), "control_store")).alias("b")
    return (
        asof_snapshot(left, snaps, ["test_store", "control_store"], "media_start_date", "snapshot_date")
        .groupBy(K, "test_store", "snapshot_date")
        .agg(best)
        .select(K, "test_store", "snapshot_date", "b.control_store", "b.similarity_ranking", (-F.col("b.neg")).alias("n_prior"))
    )


def correlation_pairs(weekly: DataFrame, stores: DataFrame, areas: DataFrame) -> DataFrame:
    """Correlation of the weekly sales of each test and control store of an area.

    Weeks without sales count as zero.  Each store is one row holding its series
    relative to the mean, so a pair costs one dot product.
    """
    weeks = weekly.select(K, "sales_week").distinct().groupBy(K).agg(
        F.array_sort(F.collect_set("sales_week")).alias("weeks")
    )
    point = F.struct(F.col("sales_week").alias("d"), F.col("sales_amount").alias("v"))
    per_store = weekly.groupBy(K, "site").agg(F.map_from_entries(F.collect_list(point)).alias("m")).join(weeks, K)
    value = F.transform("weeks", lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    series = per_store.withColumn("v", value)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    series = series.withColumn("mu", total / F.size("v"))
    series = series.withColumn("c", F.transform("v", lambda x: x - F.col("mu")))
    series = series.withColumn("norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)))
    feats = with_cohort(series.select(K, "site", "c", "norm"), stores).join(areas, "site")
    test = feats.filter("test_or_control = 'Test'").select(
        K, "area", F.col("site").alias("test_store"), F.col("c").alias("ct"), F.col("norm").alias("nt"))
    control = feats.filter("test_or_control = 'Control'").select(
        K, "area", F.col("site").alias("control_store"), F.col("c").alias("cc"), F.col("norm").alias("nc"))
    dot = F.aggregate(F.zip_with("ct", "cc", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return test.join(control, [K, "area"]).select(
        *PAIR, safe_divide(dot, F.col("nt") * F.col("nc")).alias("corr")
    )


def closest_furthest(ranked: DataFrame) -> DataFrame:
    """Best and worst ranked control of each campaign and store."""
    return ranked.groupBy(K, "site").agg(
        F.min_by("other", "similarity_ranking").alias("closest"),
        F.max_by("other", "similarity_ranking").alias("furthest"),
    )


def executed_pairs(pairs: DataFrame, ran: DataFrame, max_diff: float | None = None) -> DataFrame:
    """Planned pairs whose test store really ran the asset, optionally close ones only."""
    out = pairs.join(
        ran.select(K, F.col("site").alias("test_store")).distinct(), [K, "test_store"], "left_semi"
    )
    return out if max_diff is None else out.filter(F.col("abs_perc_diff") <= max_diff)
