"""Store-level baselines, campaign windows and uplift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import labelled_bucket, safe_divide, week_diff_sunday, week_start

K = "campaign_id"
START, END = "media_start_date", "media_end_date"


def in_store(sales: DataFrame, sales_org: int = 1005) -> DataFrame:
    """Physical-store lines of one sales organisation (a NULL channel is dropped)."""
    return sales.filter((F.lower("channel") != "online") & (F.col("sales_org") == sales_org))


def tag_sales(
    sales: DataFrame, campaigns: DataFrame, skus: DataFrame, lo: Column, hi: Column
) -> DataFrame:
    """Lines of campaign SKUs dated ``lo..hi`` (expressions over the campaign's dates).

    The join key is the article; the date test rides on the join.  The overall
    date span of the campaigns is put on the fact as a scalar-subquery filter, so
    that a date-laid-out table is pruned at the scan.
    """
    windows = campaigns.withColumns({"_lo": lo, "_hi": hi})
    first = windows.select(F.min("_lo")).scalar()
    last = windows.select(F.max("_hi")).scalar()
    keyed = skus.join(windows, K)
    return (
        sales.filter((F.col("txn_date") >= first) & (F.col("txn_date") <= last))
        .join(keyed, "article")
        .filter(F.col("txn_date").between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def weekly_store_sales(
    sales: DataFrame,
    campaigns: DataFrame,
    skus: DataFrame,
    lookback_weeks: int = 13,
    gap_weeks: int = 1,
    week_first_day: str = "SUN",
    by: Sequence[str] = (),
) -> DataFrame:
    """Distinct baskets and sales per campaign, site and week before the campaign."""
    lo = F.date_sub(START, 7 * lookback_weeks)
    hi = F.date_sub(START, 7 * gap_weeks)
    return (
        tag_sales(in_store(sales), campaigns, skus, lo, hi)
        .withColumn("sales_week", week_start("txn_date", week_first_day))
        .groupBy(K, "site", *by, "sales_week")
        .agg(
            F.count_distinct("basket_key").alias("n_transactions"),
            F.sum("sales_amount").alias("sales_amount"),
        )
    )


def baseline_stats(weekly: DataFrame) -> DataFrame:
    """Spread of the weekly history of each campaign and site."""
    n, s = "n_transactions", "sales_amount"
    return weekly.groupBy(K, "site").agg(
        F.avg(n).alias("mean_transactions"),
        F.stddev_samp(n).alias("stddev_transactions"),
        F.var_samp(n).alias("variance_transactions"),
        F.min(n).alias("min_transactions"),
        F.max(n).alias("max_transactions"),
        F.sum(n).alias("total_transactions"),
        F.stddev_samp(s).alias("stddev_sales_amount"),
        F.sum(s).alias("sales_amount"),
        F.count("sales_week").alias("weeks_count"),
    )


def baseline_sales(weekly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weekly average, deviation, week count and coefficient of variation of sales."""
    return (
        weekly.groupBy(K, "site", *by)
        .agg(
            F.avg("sales_amount").alias("weekly_avg_sales_amount"),
            F.stddev_samp("sales_amount").alias("stddev_sales_amount"),
            F.count("sales_week").alias("weeks_count"),
        )
        .withColumn("cv", safe_divide("stddev_sales_amount", "weekly_avg_sales_amount"))
    )


def with_cohort(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Adds ``test_or_control``: Test for the sites that carried the campaign."""
    marks = stores.select(K, "site").distinct().withColumn("_t", F.lit(1))
    return (
        df.join(marks, [K, "site"], "left")
        .withColumn("test_or_control", F.when(F.col("_t").isNotNull(), "Test").otherwise("Control"))
        .drop("_t")
    )


def history_gate(
    baseline: DataFrame,
    stores: DataFrame,
    weeks: int = 12,
    min_share: float = 0.9,
    by_cohort: bool = True,
) -> DataFrame:
    """Campaigns in which every cohort has enough stores with a full history."""
    full = F.count_if(F.col("weeks_count") >= weeks)
    keys = [K, "test_or_control"] if by_cohort else [K]
    shares = (
        with_cohort(baseline, stores)
        .groupBy(*keys)
        .agg(F.try_divide(full, F.count(F.lit(1))).alias("share"))
    )
    return (
        shares.groupBy(K)
        .agg(F.min("share").alias("lowest_share"))
        .filter(F.col("lowest_share") >= min_share)
    )


def _by_basket(tagged: DataFrame, *keys: str) -> DataFrame:
    """Pre-aggregation to one row per basket and day, before the distinct counts."""
    return tagged.groupBy(*keys, "txn_date", "basket_key").agg(F.sum("sales_amount").alias("amount"))


def campaign_sales(
    sales: DataFrame,
    campaigns: DataFrame,
    skus: DataFrame,
    stores: DataFrame,
    with_skus: bool = False,
) -> DataFrame:
    """Sales of the campaign SKUs while the campaign ran, per site, with its cohort."""
    tagged = tag_sales(in_store(sales), campaigns, skus, F.col(START), F.col(END))
    keys = [K, START, END, "site"]
    out = (
        _by_basket(tagged, *keys)
        .groupBy(*keys)
        .agg(
            F.count_distinct("txn_date").alias("n_days_campaign_period"),
            F.sum("amount").alias("total_sales_campaign_period"),
            F.count_distinct("basket_key").alias("total_baskets_campaign_period"),
        )
    )
    if with_skus:
        sold = tagged.groupBy(K, "site").agg(
            F.array_sort(F.collect_set("article")).alias("campaign_skus")
        )
        out = out.join(sold, [K, "site"])
    return with_cohort(out, stores)


def campaign_store_skus(sales: DataFrame, campaigns: DataFrame, skus: DataFrame) -> DataFrame:
    """campaign_id, site, article and sales of every campaign SKU sold at a site while the campaign ran, one row each."""
    tagged = tag_sales(in_store(sales), campaigns, skus, F.col(START), F.col(END))
    return tagged.groupBy(K, "site", "article").agg(F.sum("sales_amount").alias("sales_amount"), F.count_distinct("basket_key").alias("n_baskets"))


def pre_vs_during(
    during: DataFrame, sales: DataFrame, campaigns: DataFrame, skus: DataFrame, baseline: DataFrame
) -> DataFrame:
    """Adds the equally long pre-window and the baseline to the campaign sales.

    The window of a site is as long as its number of selling days in the
    campaign; sites without sales in it drop out, as in an inner join.
    """
    longest = F.date_sub(START, F.datediff(END, START) + 1)
    tagged = tag_sales(in_store(sales), campaigns.select(K, START, END), skus, longest, F.date_sub(START, 1))
    days = during.select(K, "site", "n_days_campaign_period")
    inside = tagged.join(days, [K, "site"]).filter(
        F.col("txn_date") >= F.date_sub(START, F.col("n_days_campaign_period").cast("int"))
    )
    pre = (
        _by_basket(inside, K, "site")
        .groupBy(K, "site")
        .agg(
            F.sum("amount").alias("total_sales_pre_period"),
            F.count_distinct("txn_date").alias("n_days_pre_period"),
            F.count_distinct("basket_key").alias("total_baskets_pre_period"),
        )
    )
    return during.join(pre, [K, "site"]).join(baseline, [K, "site"], "left")


# windows of the retrospective method: seven days before, from the start, after
SEVEN_DAY_WINDOWS = {
    "pre": ("date_sub(campaign_start_date, 7)", "date_sub(campaign_start_date, 1)"),
    "campaign": ("campaign_start_date", "date_add(campaign_start_date, 6)"),
    "post": ("date_add(campaign_end_date, 1)", "date_add(campaign_end_date, 7)"),
}
LONG_WINDOWS = {
    "history": ("add_months(campaign_start_date, -6)", "date_sub(campaign_start_date, 1)"),
    "campaign": ("campaign_start_date", "date_add(campaign_start_date, 7)"),
    "post": ("date_add(campaign_start_date, 7)", "date_add(campaign_start_date, 28)"),
}


def period_sales(
    sales: DataFrame,
    campaigns: DataFrame,
    skus: DataFrame,
    windows: Mapping[str, tuple[str, str]] = SEVEN_DAY_WINDOWS,
    with_all_baskets: bool = True,
) -> DataFrame:
    """Sales days, amount and baskets of the campaign SKUs in several windows at once.

    Conditional aggregates, so that windows never multiply each other's rows: lines shrink to one
    row per basket and one per day, each with a bit per window, and the bits are counted. Distinct
    counts per window would repeat every line for each of them.
    """
    los = [F.expr(lo) for lo, _ in windows.values()]
    his = [F.expr(hi) for _, hi in windows.values()]
    first = F.least(*los) if len(los) > 1 else los[0]
    last = F.greatest(*his) if len(his) > 1 else his[0]
    tagged = tag_sales(sales, campaigns, skus, first, last)
    hits = {n: F.col("txn_date").between(F.expr(lo), F.expr(hi)) for n, (lo, hi) in windows.items()}
    marks = F.bit_or(sum((F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(hits.values())), F.lit(0))).alias("_in")
    amounts = [F.sum(F.when(hit, F.col("sales_amount"))).alias(f"_amount_{n}") for n, hit in hits.items()]
    baskets = tagged.groupBy(K, "site", "basket_key").agg(marks, *amounts).withColumn("_kind", F.when(F.col("basket_key").isNotNull(), "basket")).drop("basket_key")
    days = tagged.groupBy(K, "site", "txn_date").agg(marks).withColumn("_kind", F.lit("day")).drop("txn_date")
    lines = baskets.unionByName(days, allowMissingColumns=True)
    aggs = []
    for i, n in enumerate(windows):
        hit = F.col("_in").bitwiseAND(1 << i) != 0
        aggs += [
            F.count_if(hit & (F.col("_kind") == "day")).alias(f"n_days_{n}"),
            F.sum(f"_amount_{n}").alias(f"sales_{n}"),
            F.count_if(hit & (F.col("_kind") == "basket")).alias(f"baskets_{n}"),
        ]
    out = lines.groupBy(K, "site").agg(*aggs)
    if not with_all_baskets:
        return out
    # Baskets of any article: count once per distinct date window, not per campaign.
    spans = campaigns.select(
        K, F.explode(F.array(*[
            F.struct(F.lit(n).alias("window"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))
            for n, (lo, hi) in windows.items()
        ])).alias("w")
    ).select(K, "w.*")
    days = spans.select("lo", "hi").distinct().withColumn("txn_date", F.explode(F.sequence("lo", "hi")))
    counted = (
        sales.select("site", "txn_date", "basket_key").distinct()
        .join(days, "txn_date")
        .groupBy("lo", "hi", "site")
        .agg(F.count_distinct("basket_key").alias("n"))
    )
    wide = (
        spans.join(counted, ["lo", "hi"])
        .groupBy(K, "site")
        .agg(*[F.max(F.when(F.col("window") == n, F.col("n"))).alias(f"all_baskets_{n}") for n in windows])
    )
    return out.join(wide, [K, "site"], "left")


def complete_periods(df: DataFrame, days: str = "n_days_campaign_period") -> DataFrame:
    """Sites whose number of selling days equals the highest of their campaign."""
    top = df.groupBy(K).agg(F.max(days).alias("_top"))
    return df.join(top, K).filter(F.col(days) == F.col("_top")).drop("_top")


def uplift(
    df: DataFrame,
    during: str = "total_sales_campaign_period",
    before: str = "total_sales_pre_period",
) -> DataFrame:
    """Relative and absolute change against the pre-window (NULL on zero pre-sales)."""
    return df.withColumns(
        {
            "perc_sales_uplift": safe_divide(during, before) - 1,
            "raw_sales_uplift": F.col(during) - F.col(before),
        }
    )


def min_baskets_per_week(df: DataFrame, threshold: float = 100) -> DataFrame:
    """Sites with enough baskets per week before and during the campaign."""
    weeks = F.col("n_days_campaign_period") / 7
    return df.filter(
        (F.try_divide(F.col("total_baskets_campaign_period"), weeks) >= threshold)
        & (F.try_divide(F.col("total_baskets_pre_period"), weeks) >= threshold)
    )


def period_panel(periods: DataFrame, days: int = 7, full_days: int | None = None) -> DataFrame:
    """Daily averages and basket shares of the three windows, with relative changes."""
    need = days if full_days is None else full_days
    cols = {}
    for n in ("pre", "campaign", "post"):
        cols[f"daily_sales_{n}"] = F.col(f"sales_{n}") / days
        cols[f"daily_baskets_{n}"] = F.col(f"baskets_{n}") / days
        cols[f"basket_share_{n}"] = safe_divide(f"baskets_{n}", f"all_baskets_{n}")
    full = (F.col("n_days_pre") >= need) & (F.col("n_days_campaign") >= need)
    return (
        periods.filter(full)
        .withColumns(cols)
        .withColumns(
            {
                "perc_change_in_sales": safe_divide("sales_campaign", "sales_pre") - 1,
                "perc_change_in_share": safe_divide("basket_share_campaign", "basket_share_pre") - 1,
            }
        )
    )


def within_range(df: DataFrame, column: str, limit: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """How many rows lie inside and outside ``±limit``."""
    c = F.col(column)
    inside = (c >= -limit) & (c <= limit)
    outside = (c <= -limit) | (c >= limit)
    return df.groupBy(*by).agg(
        F.count_if(outside).alias("out_of_range"), F.count_if(inside).alias("within_range")
    )


def price_per_unit(
    sales: DataFrame, campaigns: DataFrame, skus: DataFrame, lookback_weeks: int = 13, gap_weeks: int = 1
) -> DataFrame:
    """Price per unit of each site and article, in the history and in the campaign."""
    history = (F.date_sub(START, 7 * lookback_weeks), F.date_sub(START, 7 * gap_weeks))
    tagged = tag_sales(in_store(sales), campaigns, skus, history[0], F.col(END))
    in_hist = F.col("txn_date") <= history[1]
    in_camp = F.col("txn_date") >= F.col(START)
    amount, units = F.col("sales_amount"), F.col("units")
    # weeks are marked as bits, a distinct count would hold every line of a task in two more tables
    week = week_diff_sunday("txn_date", history[0])
    words = [
        F.bit_or(F.when(in_hist & (F.floor(week / 63) == w), F.call_function("shiftleft", F.lit(1).cast("long"), week % 63)))
        for w in range(max(lookback_weeks - gap_weeks, 0) // 63 + 1)
    ]
    weeks = sum((F.coalesce(F.bit_count(word), F.lit(0)) for word in words), F.lit(0))
    return (
        tagged.groupBy(K, "site", "article")
        .agg(
            weeks.cast("long").alias("history_weeks"),
            safe_divide(F.sum(F.when(in_hist, amount)), F.sum(F.when(in_hist, units))).alias("history_price"),
            safe_divide(F.sum(F.when(in_camp, amount)), F.sum(F.when(in_camp, units))).alias("campaign_price"),
        )
        .filter(F.col("history_price").isNotNull())
    )


def rolling_monthly_orders(transactions: DataFrame) -> DataFrame:
    """Monthly orders per shopper and per shopper and sub-category, with running means."""
    month = F.trunc("start_txn_date", "month").alias("order_month")
    total = transactions.groupBy("shopper_id", month).agg(F.count_distinct("basket_key").alias("n_orders"))
    subcat = transactions.groupBy("shopper_id", "subcat", month).agg(
        F.count_distinct("basket_key").alias("n_orders_subcat")
    )

    def running(col: str, *keys: str) -> Column:
        w = W.partitionBy(*keys).orderBy("order_month").rangeBetween(W.unboundedPreceding, W.currentRow)
        return F.avg(col).over(w)

    total = total.withColumn("rolling_orders", running("n_orders", "shopper_id"))
    subcat = subcat.withColumn("rolling_orders_subcat", running("n_orders_subcat", "shopper_id", "subcat"))
    return total.join(subcat, ["shopper_id", "order_month"], "left")


def article_week_profile(sales: DataFrame) -> DataFrame:
    """Stores, baskets, baskets per store and spend per basket of each article week."""
    return (
        in_store(sales)
        .groupBy("article", week_start("txn_date", "MON").alias("sales_week"))
        .agg(
            F.count_distinct("site").alias("n_stores"),
            F.count_distinct("basket_key").alias("n_baskets"),
            F.sum("sales_amount").alias("sales_amount"),
        )
        .withColumns(
            {
                "baskets_per_store": safe_divide("n_baskets", "n_stores"),
                "spend_per_basket": safe_divide("sales_amount", "n_baskets"),
            }
        )
    )


def daily_baskets(pairs: DataFrame, periods: DataFrame) -> DataFrame:
    """Baskets per day of both sides of each pair, before and during the campaign."""
    rates = periods.select(
        K,
        "site",
        safe_divide("total_baskets_pre_period", "n_days_pre_period").alias("pre"),
        safe_divide("total_baskets_campaign_period", "n_days_campaign_period").alias("during"),
    )
    out = pairs.select(K, "test_store", "control_store")
    for side in ("test", "control"):
        named = rates.select(
            K,
            F.col("site").alias(f"{side}_store"),
            F.col("pre").alias(f"{side}_daily_baskets_pre"),
            F.col("during").alias(f"{side}_daily_baskets_during"),
        )
        out = out.join(named, [K, f"{side}_store"])
    return out


def basket_histogram(averages: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Stores per labelled range of weekly baskets."""
    return (
        averages.withColumn("b", labelled_bucket(column, edges))
        .groupBy("b.bucket", "b.sort_key")
        .agg(F.count(F.lit(1)).alias("n_stores"))
    )
