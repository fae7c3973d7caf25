"""Experiment design: panels, allocation, sampling and sample sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import random_key, safe_divide
from counterlift.operators.store_sales import K


def densify(facts: DataFrame, keys: Sequence[str], at: str, fill: Sequence[str], first: str | None = None, last: str | None = None, step_days: int = 7) -> DataFrame:
    """Every entity x every date from ``first`` to ``last``; missing facts become zero.

    Without them the calendar runs from the first to the last date of the facts. It is a sequence
    generated per entity, not a cross join.
    """
    begin = facts.select(F.min(at)).scalar() if first is None else F.lit(first).cast("date")
    end = facts.select(F.max(at)).scalar() if last is None else F.lit(last).cast("date")
    calendar = F.sequence(begin, end, F.make_dt_interval(days=F.lit(step_days)))
    frame = facts.select(*keys).distinct().withColumn(at, F.explode(calendar))
    out = frame.join(facts.select(*keys, at, *fill), [*keys, at], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in fill})


def activity_gate(panel: DataFrame, key: str = "site") -> DataFrame:
    """Entities without an empty week."""
    return (
        panel.groupBy(key)
        .agg(
            F.count_if(F.col("n_transactions") == 0).alias("n_weeks_no_baskets"),
            F.count_if(F.col("n_transactions") > 0).alias("n_weeks_with_baskets"),
        )
        .filter(F.col("n_weeks_no_baskets") == 0)
    )


def bucketed_row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """``row_number`` per group for groups too large for one task.

    ``bucket`` must grow with the order and take a bounded number of values.  Rows
    are numbered inside (group, bucket) and shifted by the size of the group's
    earlier buckets.
    """
    by = list(by)
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        keyed.withColumn("_in", inside)
        .join(shifts, [*by, "_bucket"])
        .withColumn(name, F.col("_in") + F.col("_shift"))
        .drop("_bucket", "_in", "_shift")
    )


def global_row_number(df: DataFrame, hex_key: str, name: str, prefix: int = 3) -> DataFrame:
    """Row number over the whole frame in the order of a hexadecimal key.

    The key's first ``prefix`` digits are the buckets, so no task sorts the frame.
    """
    return bucketed_row_number(df, [], [hex_key], F.substring(hex_key, 1, prefix), name)


def allocate(stores: DataFrame, cutoffs: Sequence[tuple[int, str]], otherwise: str, seed: str) -> DataFrame:
    """Cohorts by random rank: the first cut-off the rank does not exceed names it."""
    ranked = global_row_number(
        stores.select("site").withColumn("random_key", random_key(seed, "site")), "random_key", "random_allocation"
    )
    chain = None
    for limit, cohort in cutoffs:
        hit = F.col("random_allocation") <= limit
        chain = F.when(hit, cohort) if chain is None else chain.when(hit, cohort)
    return ranked.withColumn("cohort", chain.otherwise(otherwise)).drop("random_key")


def assignment(allocated: DataFrame, pairs: DataFrame, top_n: int, control: str = "Control") -> DataFrame:
    """Marks stores used by a pair and keeps the first ``top_n`` of each test cohort."""
    used = (
        pairs.select(F.col("test_store").alias("site"))
        .union(pairs.select(F.col("control_store").alias("site")))
        .distinct()
        .withColumn("_u", F.lit(1))
    )
    marked = (
        allocated.join(used, "site", "left")
        .withColumn("assignment", F.when(F.col("_u") == 1, "Assigned").otherwise("Unassigned"))
        .drop("_u")
    )
    numbered = bucketed_row_number(
        marked, ["cohort", "assignment"], ["random_allocation"],
        F.floor(F.col("random_allocation") / 10000), "n_store",
    )
    return numbered.filter((F.col("n_store") <= top_n) | (F.col("cohort") == control))


def weekly_averages(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy(K, "site").agg(F.avg("n_transactions").alias("weekly_average_baskets"))


def stratified_stores(averages: DataFrame, low: float = 20, high: float = 60, total: int = 100, seed: str = "stores") -> DataFrame:
    """A random ``total`` of stores per campaign, spread over volume groups by their share."""
    x = F.col("weekly_average_baskets")
    grouped = averages.withColumn(
        "transaction_group",
        F.when(x <= low, "Low").when((x >= low + 1) & (x <= high), "Medium").otherwise("High"),
    )
    sizes = grouped.groupBy(K, "transaction_group").agg(F.count(F.lit(1)).alias("group_count"))
    totals = sizes.groupBy(K).agg(F.sum("group_count").alias("total_count"))
    wanted = sizes.join(totals, K).select(
        K, "transaction_group",
        F.round(F.col("group_count") * float(total) / F.col("total_count")).alias("stratified_sample_size"),
    )
    keyed = grouped.withColumn("_key", random_key(seed, K, "site"))
    return (
        bucketed_row_number(keyed, [K, "transaction_group"], ["_key"], F.substring("_key", 1, 2), "row_num")
        .join(wanted, [K, "transaction_group"])
        .filter(F.col("row_num") <= F.col("stratified_sample_size"))
        .drop("row_num", "_key")
    )


def required_stores(averages: DataFrame, by: Sequence[str] = (K,), z_alpha: float = 1.96, z_beta: float = 0.84, effect: float = 0.1) -> DataFrame:
    """Stores per group needed to see a relative change of ``effect``."""
    size = F.pow((z_alpha + z_beta) * F.col("stddev_transactions") / (effect * F.col("mean_transactions")), F.lit(2.0))
    return (
        averages.groupBy(*by)
        .agg(
            F.avg("weekly_average_baskets").alias("mean_transactions"),
            F.stddev_samp("weekly_average_baskets").alias("stddev_transactions"),
        )
        .withColumn("sample_size_per_group", size)
        .withColumn("recommended_control_stores", F.ceil("sample_size_per_group"))
    )


def mde_sizes(baseline: DataFrame, effects: Sequence[float] = (0.10, 0.20, 0.30)) -> DataFrame:
    """Sample sizes for several minimum detectable effects from a store's history."""
    cols = {}
    for e in effects:
        top = F.lit((1.96 + 0.84) ** 2 * 2) * F.pow(F.col("stddev_transactions"), F.lit(2.0))
        cols[f"required_{round(e * 100)}"] = safe_divide(top, F.pow(F.lit(e) * F.col("mean_transactions"), F.lit(2.0)))
    return baseline.select(K, "site", "mean_transactions", "stddev_transactions").withColumns(cols)


def duration_margin(
    volumes: DataFrame, controls: Sequence[int], effects: Sequence[float], z: float = 1.645, sigma: float = 0.5,
    required_size: float | None = None,
) -> DataFrame:
    """Days needed and margin of error per daily volume, control-store count and effect.

    The grid of the two short lists is a literal array, so each volume row
    multiplies by it without a join.
    """
    grid = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("control_stores"), F.lit(float(e)).alias("effect_size"))
            for c in controls for e in effects
        ])
    )
    need = F.lit(required_size) if required_size else F.pow((z + 0.84) / F.col("effect_size"), F.lit(2.0)) * 2 * sigma**2
    return (
        volumes.withColumn("g", grid)
        .select(*volumes.columns, "g.*")
        .withColumn("duration_days", safe_divide(need, F.col("daily_units") * F.col("control_stores")))
        .withColumn(
            "margin_of_error",
            z * safe_divide(F.lit(sigma), F.sqrt(F.col("daily_units") * F.col("control_stores") * F.col("duration_days"))),
        )
    )


def histogram(df: DataFrame, group: Sequence[str], col: str, width: float = 0.5) -> DataFrame:
    """Counts per bin of ``width`` with an edge at zero, positives and negatives apart."""
    c = F.col(col)
    return (
        df.filter(c.isNotNull())
        .groupBy(*group, (F.floor(c / width) * width).alias("bin_start"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(c > 0).alias("n_positive"),
            F.count_if(c < 0).alias("n_negative"),
        )
    )
