"""Hourly stock, trading hours and stock-out rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import split_list, weekday_name
from counterlift.operators.campaigns import K

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def carry_forward(df: DataFrame, by: Sequence[str], period: Column, order: Sequence[str], value: str, through: int = W.currentRow) -> DataFrame:
    """``df`` with ``value`` filled from the latest earlier row of the group that has one.

    ``period`` grows with the order and cuts a history into pieces. Each piece is filled by itself, after
    a head row with the last reading before it, taken from one row per piece; so no task holds a history and
    nothing is joined. ``through`` -1 leaves out the row's own reading. Rows without key or period are dropped.
    """
    by, order = list(by), list(order)
    known = F.lit(True)
    for c in (*by, "_piece"):
        known = known & F.col(c).isNotNull()
    cut = df.withColumn("_piece", period).filter(known)
    last = cut.groupBy(*by, "_piece").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    heads = last.select(*by, "_piece", F.last("_last", ignorenulls=True).over(before).alias(value), F.lit(False).alias("_row"))
    rows = cut.withColumn("_row", F.lit(True)).unionByName(heads.filter(F.col(value).isNotNull()), allowMissingColumns=True)
    inside = W.partitionBy(*by, "_piece").orderBy("_row", *order).rowsBetween(W.unboundedPreceding, through)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(inside)).filter("_row").drop("_piece", "_row")


def hourly_stock(stock: DataFrame, skus: DataFrame | None = None, piece_days: int = 28) -> DataFrame:
    """24 rows per (date, site, article) with readings carried forward.

    A day's readings travel as one small list, and readings are carried from day to day before the days are
    unrolled to hours, so that the panel needs neither a cross join nor a join back; hours before the first reading
    stay NULL. Of several readings in one hour the lowest counts, as a shelf seen empty was empty. Histories are
    filled in pieces of ``piece_days`` days.
    """
    if skus is not None:
        stock = stock.join(skus.select("article").distinct(), "article", "left_semi")
    hours = stock.groupBy("article", "site", "soh_date", F.col("soh_hour").cast("int").alias("hour")).agg(F.min("soh").alias("soh"))
    day = hours.groupBy("article", "site", "soh_date").agg(
        F.collect_list(F.when(F.col("soh").isNotNull(), F.struct("hour", "soh"))).alias("readings")  # at most 24
    )
    piece = F.floor(F.unix_date("soh_date") / piece_days)
    days = carry_forward(day.withColumn("_known", F.array_max("readings")["soh"]), ["site", "article"], piece, ["soh_date"], "_known", through=-1)
    read = F.array_max(F.filter("readings", lambda r: r["hour"] <= F.col("hour")))
    return days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        "soh_date", "hour", "site", "article", F.coalesce(read["soh"], F.col("_known")).alias("stock_level"))


def trading_hours(site_hours: DataFrame, midnight_hour: int = 0) -> DataFrame:
    """Opening and closing hour per site and weekday; a started hour counts as open.

    A closing time of 24:00 is hour ``midnight_hour``; the default 0 leaves such a
    day without trading hours.  Sites with a blank time on any day are left out.
    """
    def hour(c: Column) -> Column:
        return F.substring(c, 1, 2).cast("int")

    def minute(c: Column) -> Column:
        return F.substring(c, 3, 2).cast("int")

    complete = F.lit(True)
    for d in DAYS:
        complete = complete & (F.col(f"{d}_open") != "") & (F.col(f"{d}_close") != "")
    entries = []
    for d in DAYS:
        closing = F.col(f"{d}_close")
        close_hour = F.when(closing == "240000", F.lit(midnight_hour)).otherwise(
            hour(closing) + F.when(minute(closing) > 0, 1).otherwise(0)
        )
        entries.append(
            F.struct(
                F.lit(d).alias("weekday"),
                hour(F.col(f"{d}_open")).alias("opening_hour"),
                close_hour.alias("closing_hour"),
            )
        )
    return site_hours.filter(complete).select("site", F.explode(F.array(*entries)).alias("e")).select("site", "e.*")


def _hour_bit(hour: str, shift: int = 0) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.col(hour) + shift, F.lit(62)).cast("int"))


def oos_hours(panel: DataFrame, hours: DataFrame) -> DataFrame:
    """Trading hours and trading hours without stock per site, article and day.

    The hours of a day become the bits of a number before opening times are joined, one row per day.
    """
    days = panel.groupBy("site", "soh_date", "article").agg(
        F.bit_or(_hour_bit("hour")).alias("_seen"), F.bit_or(F.when(F.col("stock_level") == 0, _hour_bit("hour"))).alias("_empty")
    )
    span = F.when(F.col("closing_hour") >= F.col("opening_hour"), _hour_bit("closing_hour", 1) - _hour_bit("opening_hour"))
    trading = hours.groupBy("site", "weekday").agg(F.bit_or(span).alias("_open"))
    return (
        days.withColumn("weekday", weekday_name("soh_date"))
        .join(trading, ["site", "weekday"])
        .select(
            "site", "soh_date", "article",
            F.bit_count(F.col("_seen").bitwiseAND(F.col("_open"))).cast("long").alias("total_trading_hours"),
            F.bit_count(F.coalesce("_empty", F.lit(0).cast("long")).bitwiseAND(F.col("_open"))).cast("long").alias("n_trading_hours_oos"),
        )
        .filter("total_trading_hours > 0")
    )


def _line_skus(bookings: DataFrame) -> DataFrame:
    return bookings.select(
        F.col("booking_number").alias(K), "line_name", F.explode(split_list("quoteline_sku")).alias("article")
    )


def stockout_rate(cohorts: DataFrame, bookings: DataFrame, oos: DataFrame, days: int = 7) -> DataFrame:
    """Listed and checked SKUs and the share of trading hours without stock.

    SKUs are counted per line and stock per store, so that a store's row is never
    multiplied by all SKUs of its line.
    """
    skus = _line_skus(bookings)
    per_line = skus.groupBy(K, "line_name").agg(F.count_distinct("article").alias("total_skus"))
    rows = cohorts.select(K, "campaign_start_date", "site", "line_name", "is_compliant").distinct()
    spans = rows.select(K, "campaign_start_date", "site", "line_name").distinct()
    hit = (
        oos.join(spans, "site")
        .filter(F.col("soh_date").between(F.col("campaign_start_date"), F.date_add("campaign_start_date", days - 1)))
        .join(skus.hint("merge"), [K, "line_name", "article"], "left_semi")  # unpacked lists look small to the optimizer
        .groupBy(K, "line_name", "site")
        .agg(
            F.count_distinct("article").alias("stocktake_skus"),
            F.sum("total_trading_hours").alias("total_trading_hours"),
            F.sum("n_trading_hours_oos").alias("total_oos_trading_hours"),
        )
    )
    return (
        rows.join(per_line, [K, "line_name"])
        .join(hit, [K, "line_name", "site"], "left")
        .withColumn("stocktake_skus", F.coalesce("stocktake_skus", F.lit(0)))
        .withColumn(
            "perc_of_trading_hours_oos",
            F.try_divide(F.col("total_oos_trading_hours"), F.col("total_trading_hours")),
        )
    )


def store_coverage(cohorts: DataFrame, bookings: DataFrame, oos: DataFrame, days: int = 7) -> DataFrame:
    """Distinct SKUs of a campaign in a store, over all its lines there, and those without any stock reading."""
    listed = (
        cohorts.select(K, "campaign_start_date", "site", "line_name").distinct()
        .join(_line_skus(bookings), [K, "line_name"])
        .select(K, "campaign_start_date", "site", "article").distinct()
    )
    read = (
        oos.select("site", "article", "soh_date").distinct()
        .join(listed, ["site", "article"])
        .filter(F.col("soh_date").between(F.col("campaign_start_date"), F.date_add("campaign_start_date", days - 1)))
        .select(K, "site", "article", F.lit(1).alias("seen")).distinct()
    )
    one = listed.select(K, "site", "article").distinct().join(read, [K, "site", "article"], "left")
    return one.groupBy(K, "site").agg(
        F.count(F.lit(1)).alias("total_store_skus"), F.count_if(F.col("seen").isNull()).alias("unchecked_skus")
    ).withColumn("unchecked_share", F.try_divide("unchecked_skus", "total_store_skus"))


def coverage_gate(coverage: DataFrame, max_unchecked: float = 0.025) -> DataFrame:
    """Stores whose share of SKUs without any stock reading is small enough."""
    return coverage.filter(F.col("unchecked_share") <= max_unchecked)


def missing_stock(cohorts: DataFrame, bookings: DataFrame, stock: DataFrame, articles: DataFrame, days: int = 7) -> DataFrame:
    """Listed SKUs of audited stores without a reading in the first days, with names."""
    listed = (
        cohorts.select(K, "campaign_start_date", "site", "line_name").distinct()
        .join(_line_skus(bookings), [K, "line_name"])
        .select(K, "campaign_start_date", "site", "article")
        .distinct()
    )
    seen = stock.select("article", "site", "soh_date").distinct()
    read = (
        listed.join(seen, ["article", "site"])
        .filter(F.col("soh_date").between(F.col("campaign_start_date"), F.date_add("campaign_start_date", days - 1)))
        .select(K, "site", "article")
        .distinct()
    )
    return listed.join(read, [K, "site", "article"], "left_anti").join(
        articles.select("article", "description"), "article", "left"
    )
