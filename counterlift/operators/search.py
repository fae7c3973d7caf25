"""Page- and search-term-based exposure, and unmatched conversion reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlift.functions import local_date, packed_part, safe_divide


def first_term(term: str | Column) -> Column:
    """Text before the first bar of a tracked search term, trimmed and in lower case."""
    c = F.col(term) if isinstance(term, str) else term
    return F.lower(F.trim(F.regexp_extract(c, r"^([^|]*)", 1)))


def cleaned_term(term: str) -> Column:
    """A term without characters other than letters, digits and common punctuation."""
    return F.lower(F.regexp_replace(term, r"[^a-zA-Z0-9 &-'@]", ""))


def impressions_with_terms(impressions: DataFrame) -> DataFrame:
    """Adds the first search term, tracked per platform."""
    return impressions.withColumn(
        "first_search_term", F.when(F.col("site_platform").isin("web", "app"), first_term("search_term"))
    )


def campaign_hits(impressions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Hits that carry a booking line of a campaign, with the line's dates and medium."""
    lines = taxonomy.select(
        F.col("booking_number").alias("booking_id"), F.col("line_name").alias("ci_id"), "media_type",
        "campaign_start_date", "campaign_end_date", "media_start_date", "media_end_date",
    ).distinct()
    return impressions.join(lines, ["booking_id", "ci_id"])


def impression_pages(hits: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Pages and days on which a campaign line was shown, with its number of SKUs."""
    sizes = taxonomy.groupBy(
        F.col("booking_number").alias("booking_id"), F.col("line_name").alias("ci_id")
    ).agg(F.count_distinct("article").alias("n_skus"))
    return (
        hits.filter(F.col("action") == "impression")
        .select(
            "page_name", F.col("date_time").cast("date").alias("impression_date"), "booking_id", "ci_id", "media_type",
            "campaign_start_date", "campaign_end_date",
        )
        .distinct()
        .join(sizes, ["booking_id", "ci_id"], "left")
    )


def impression_page_skus(hits: DataFrame, taxonomy: DataFrame, articles: DataFrame) -> DataFrame:
    """Every SKU of a campaign line, with its description, on each page and day on which the line was shown."""
    shown = hits.filter(F.col("action") == "impression").select(
        "booking_id", F.col("date_time").cast("date").alias("impression_date"), "campaign_start_date", "campaign_end_date",
        "site_platform", "media_type", "ci_id", "page_name").distinct()
    listed = taxonomy.select(F.col("booking_number").alias("booking_id"), F.col("line_name").alias("ci_id"), "article").distinct()
    return shown.join(listed, ["booking_id", "ci_id"]).join(articles.select("article", "description").distinct(), "article")


def exposed_at_time(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct customer and exposure time for lines that were shown."""
    shown = pages.select("booking_id", "ci_id").distinct()
    return (
        hits.filter(F.col("crn").isNotNull())
        .join(shown, ["booking_id", "ci_id"], "left_semi")
        .select("booking_id", "ci_id", "media_type", "crn", F.col("date_time").alias("exposure_time"))
        .distinct()
    )


def page_day_controls(impressions: DataFrame, pages: DataFrame, exposed: DataFrame) -> DataFrame:
    """Customers on a campaign's page on the same day that the campaign never reached."""
    where = pages.select(
        "booking_id", "page_name", "impression_date", "media_type", "campaign_start_date", "campaign_end_date"
    ).distinct()
    day = F.col("date_time").cast("date")
    return (
        impressions.filter(F.col("crn").isNotNull())
        .select("page_name", "crn", "date_time", day.alias("impression_date"))
        .join(where, ["page_name", "impression_date"])
        .filter(F.col("impression_date").between(F.col("campaign_start_date"), F.col("campaign_end_date")))
        .join(exposed.select("booking_id", "crn").distinct(), ["booking_id", "crn"], "left_anti")
        .select("booking_id", "media_type", "crn", F.col("date_time").alias("exposure_time"))
        .distinct()
    )


def purchases_after(events: DataFrame, txns: DataFrame, skus: DataFrame, days: int = 7) -> DataFrame:
    """Purchases of campaign SKUs within ``days`` after each event.

    Events without a purchase keep one row.  Transactions are reduced to the time of the
    events and to the campaign's SKUs before they meet the events.
    """
    first = events.select(F.min("exposure_time")).scalar()
    last = events.select(F.max("exposure_time")).scalar()
    tagged = (
        txns.filter(F.col("shopper_id").isNotNull() & (F.col("start_txn_time") >= first) & (F.col("start_txn_time") <= last + F.make_dt_interval(days=F.lit(days))))
        .join(skus.select("booking_id", "article").distinct(), "article")
        .select(
            "booking_id", F.col("shopper_id").alias("crn"), "order_context", "start_txn_time", "basket_key", "article", "amount"
        )
    )
    span = F.make_dt_interval(days=F.lit(days))
    e, t = events.alias("e"), tagged.alias("t")
    cond = (
        (F.col("e.booking_id") == F.col("t.booking_id"))
        & (F.col("e.crn") == F.col("t.crn"))
        & (F.col("t.start_txn_time") >= F.col("e.exposure_time"))
        & (F.col("t.start_txn_time") <= F.col("e.exposure_time") + span)
    )
    early = F.col("t.start_txn_time") < F.col("e.exposure_time") + F.make_dt_interval(days=F.lit(3))
    return e.join(t, cond, "left").select(
        F.col("e.booking_id").alias("booking_id"), "e.media_type", F.col("e.crn").alias("exposure_crn"), "e.exposure_time",
        F.col("t.crn").alias("converted_crn"), "t.order_context", "t.start_txn_time", "t.basket_key", "t.article", "t.amount",
        F.when(early, "3 Days").otherwise("7 Days").alias("exposure_to_purchase_window"),
    )


def distinct_conversions(exposed: DataFrame, controls: DataFrame) -> DataFrame:
    """Distinct purchase lines of both cohorts with the media that led to them."""
    both = exposed.withColumn("exposure_context", F.lit("Exposed")).unionByName(
        controls.withColumn("exposure_context", F.lit("Not Exposed"))
    )
    return both.groupBy(
        "booking_id", "exposure_context", "exposure_crn", "converted_crn", "order_context", "basket_key", "article", "amount"
    ).agg(F.array_join(F.array_sort(F.collect_set("media_type")), ",").alias("media_types"))


def conversion_summary(conv: DataFrame, by: Sequence[str] = ("booking_id", "media_types", "exposure_context")) -> DataFrame:
    """Visitors, buyers, rate, baskets and spend per visitor and buyer."""
    visitors, buyers = F.count_distinct("exposure_crn"), F.count_distinct("converted_crn")
    baskets, spend = F.count_distinct("basket_key"), F.sum("amount")
    return conv.groupBy(*by).agg(
        visitors.alias("visitors"),
        buyers.alias("buyers"),
        safe_divide(buyers, visitors).alias("conversion_rate"),
        safe_divide(baskets, buyers).alias("baskets_per_buyer"),
        safe_divide(baskets, visitors).alias("baskets_per_visitor"),
        safe_divide(spend, visitors).alias("spend_per_visitor"),
        safe_divide(spend, buyers).alias("spend_per_buyer"),
    )


MEASURES = ["conversion_rate", "baskets_per_visitor", "spend_per_visitor", "spend_per_buyer"]


def exposed_vs_not(summary: DataFrame, min_visitors: int = 2000) -> DataFrame:
    """Both cohorts side by side with relative and point differences."""
    cols = ["visitors", "buyers", *MEASURES]
    wide = summary.groupBy("booking_id", "media_types").pivot("exposure_context", ["Exposed", "Not Exposed"]).agg(
        *[F.max(c).alias(c) for c in cols]
    )
    for c in cols:
        wide = wide.withColumnRenamed(f"Exposed_{c}", f"exposed_{c}").withColumnRenamed(f"Not Exposed_{c}", f"control_{c}")
    wide = wide.filter((F.col("exposed_visitors") >= min_visitors) & (F.col("control_visitors") >= min_visitors))
    extra = {}
    for c in MEASURES:
        extra[f"{c}_perc"] = safe_divide(f"exposed_{c}", f"control_{c}") - 1
        extra[f"{c}_points"] = F.col(f"exposed_{c}") - F.col(f"control_{c}")
    return wide.withColumns(extra)


def averages_by_media(report: DataFrame) -> DataFrame:
    return (
        report.withColumn("media_type", F.explode(F.split("media_types", ",")))
        .groupBy("media_type")
        .agg(
            F.count_distinct("booking_id").alias("n_campaigns"),
            F.avg("conversion_rate_perc").alias("avg_conversion_rate_perc"),
            F.avg("spend_per_visitor_perc").alias("avg_spend_per_visitor_perc"),
        )
    )


def log_with_media(log: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Run-log rows with the media of their campaign."""
    media = taxonomy.groupBy(F.col("booking_number").alias("campaign_id")).agg(
        F.array_join(F.array_sort(F.collect_set("media_type")), ", ").alias("media_types")
    )
    return log.join(media, "campaign_id", "left")


def visitors_by_page(hits: DataFrame, lines: DataFrame, zone: str = "Australia/Sydney") -> DataFrame:
    """Visitors per page and term: exposed to a listed asset or not, first and last local day."""
    listed = lines.select(
        F.col("booking_number").alias("b"), F.col("line_name").alias("l"), F.lit(True).alias("is_listed")
    ).distinct()
    keyed = hits.withColumns(
        {"b": packed_part("packed_key", 0), "l": packed_part("packed_key", 3), "term": cleaned_term("search_term")}
    ).join(listed, ["b", "l"], "left")
    seen = F.col("is_listed").isNotNull()
    return keyed.groupBy("page_name", "term").agg(
        F.count_distinct("visitor_id").alias("visitors"),
        F.count_distinct(F.when(seen, F.col("visitor_id"))).alias("exposed_visitors"),
        F.count_distinct(F.when(~seen, F.col("visitor_id"))).alias("unexposed_hits_visitors"),
        F.min(local_date("date_time", zone)).alias("first_visit"),
        F.max(local_date("date_time", zone)).alias("last_visit"),
    )


def search_test_group(impressions: DataFrame, reach_all: DataFrame) -> DataFrame:
    """Visitor, page and asset with the terms used, without reach-everyone bookings."""
    shown = impressions.filter(F.col("ci_id").isNotNull()).join(
        reach_all.select(F.col("booking_number").alias("booking_id")).distinct(), "booking_id", "left_anti"
    )
    return shown.groupBy("visitor_id", "crn", "page_name", "booking_id", "ci_id").agg(
        F.array_join(F.array_sort(F.collect_set(first_term("search_term"))), ",").alias("terms"),
        F.min("date_time").alias("first_seen"),
    )


def search_control_group(impressions: DataFrame, test: DataFrame, reach_all: DataFrame) -> DataFrame:
    """Visitors with the same page and term but without the asset.

    Left out are those that saw the asset anywhere, by visitor or by customer, and
    hits on reach-everyone bookings.
    """
    used = (
        test.withColumn("term", F.explode(F.split("terms", ",")))
        .select("booking_id", "ci_id", "page_name", "term").distinct()
    )
    others = impressions.join(
        reach_all.select(F.col("booking_number").alias("booking_id")).distinct(), "booking_id", "left_anti"
    ).select("visitor_id", "crn", "page_name", first_term("search_term").alias("term")).distinct()
    asset = ["booking_id", "ci_id"]
    return (
        others.join(used, ["page_name", "term"])
        .join(test.select(*asset, "visitor_id").distinct(), [*asset, "visitor_id"], "left_anti")
        .join(test.select(*asset, "crn").distinct(), [*asset, "crn"], "left_anti")
        .select(*asset, "visitor_id", "crn", "page_name", "term")
        .distinct()
    )


def unmatched_conversion(sales: DataFrame) -> DataFrame:
    """Conversion, baskets and spend per shopper, exposed against not exposed.

    Lines already credited to an exposed shopper are removed from the control.
    """
    keys = ["booking_id", "order_context", "basket_key", "article", "amount"]
    exposed = sales.filter(F.col("exposure_context") == "Exposed")
    control = sales.filter(F.col("exposure_context") != "Exposed").join(
        exposed.select(*keys).distinct(), keys, "left_anti"
    )
    return conversion_summary(exposed.unionByName(control), ("booking_id", "exposure_context"))


def unmatched_report(lines: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Conversion, baskets and spend of exposed and not exposed customers of a booking, side by side.

    Lines credited to an exposed customer are taken from the same customer's control lines. With the booking's
    dates, number of days, number of SKUs and media; ``booking_members`` lists its SKUs and sub-categories.
    """
    key = ["booking_id", "exposure_crn", "basket_key", "article", "amount"]
    bought = lines.filter(F.col("basket_key").isNotNull())
    exposed = bought.filter(F.col("exposure_context") == "Exposed").select(*key).distinct()
    control = bought.filter(F.col("exposure_context") != "Exposed").select(*key).distinct().join(exposed, key, "left_anti")
    sums = exposed.withColumn("side", F.lit("exposed")).unionByName(control.withColumn("side", F.lit("not_exposed"))).groupBy("booking_id").pivot(
        "side", ["exposed", "not_exposed"]).agg(F.count_distinct("basket_key").alias("baskets"), F.sum("amount").alias("sales"))
    people = lines.groupBy("booking_id").pivot("exposure_context", ["Exposed", "Not Exposed"]).agg(
        F.count_distinct("exposure_crn").alias("n"), F.count_distinct(F.when(F.col("converted_crn").isNotNull(), F.col("exposure_crn"))).alias("c"))
    facts = taxonomy.groupBy(F.col("booking_number").alias("booking_id")).agg(
        F.min("campaign_start_date").alias("campaign_start_date"), F.max("campaign_end_date").alias("campaign_end_date"),
        F.count_distinct("article").alias("n_skus"), F.array_join(F.array_sort(F.collect_set("media_type")), ",").alias("media_types"))  # a taxonomy has few media
    out = people.join(sums, "booking_id", "left").join(facts, "booking_id", "left")
    cols = {"n_days": F.datediff("campaign_end_date", "campaign_start_date")}
    for side, name in (("exposed", "Exposed"), ("not_exposed", "Not Exposed")):
        n = F.coalesce(f"{name}_n", F.lit(0))
        cols[f"n_{side}"] = n
        cols[f"{side}_conversion_rate"] = safe_divide(F.col(f"{name}_c"), n)
        cols[f"{side}_baskets_per_shopper"] = safe_divide(F.coalesce(f"{side}_baskets", F.lit(0)), n)
        cols[f"{side}_sales_per_shopper"] = safe_divide(F.coalesce(f"{side}_sales", F.lit(0.0)), n)
    return out.withColumns(cols).select("booking_id", "campaign_start_date", "campaign_end_date", "media_types", "n_skus", *cols)


def booking_members(taxonomy: DataFrame, articles: DataFrame) -> DataFrame:
    """booking_id, kind (``media``, ``sku`` or ``subcat``) and member of every booking, one row each."""
    rows = taxonomy.select(F.col("booking_number").alias("booking_id"), "media_type", F.trim("article").alias("article")).distinct()
    named = rows.select("booking_id", "article").join(articles.select("article", "subcat"), "article")
    parts = [rows.select("booking_id", F.lit("media").alias("kind"), F.col("media_type").alias("member")),
             rows.select("booking_id", F.lit("sku").alias("kind"), F.col("article").alias("member")),
             named.select("booking_id", F.lit("subcat").alias("kind"), F.col("subcat").alias("member"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("member").isNotNull()).distinct()


def conversion_uplift(summary: DataFrame) -> DataFrame:
    """Relative and point uplift of rate and spend, exposed over not exposed."""
    cols = ["conversion_rate", "spend_per_visitor"]
    wide = summary.groupBy("booking_id").pivot("exposure_context", ["Exposed", "Not Exposed"]).agg(
        *[F.max(c).alias(c) for c in cols]
    )
    out = {}
    for c in cols:
        out[f"{c}_perc"] = safe_divide(f"Exposed_{c}", f"Not Exposed_{c}") - 1
        out[f"{c}_points"] = F.col(f"Exposed_{c}") - F.col(f"Not Exposed_{c}")
    return wide.withColumns(out).select("booking_id", *out)


def both_cohorts(summary: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows of finished runs whose campaign and media have visitors in both cohorts."""
    keys = ["booking_id", "media_types"]
    seen = summary.filter(F.col("visitors") > 0)
    for cohort in ("Exposed", "Not Exposed"):
        summary = summary.join(
            seen.filter(F.col("exposure_context") == cohort).select(*keys).distinct(), keys, "left_semi"
        )
    return summary.join(finished.select(F.col("campaign_id").alias("booking_id")).distinct(), "booking_id", "left_semi")


def assets_by_media(hits: DataFrame) -> DataFrame:
    """Distinct booking and asset seen in hits per medium."""
    return hits.groupBy("media_type").agg(F.count_distinct("booking_id", "ci_id").alias("n_assets"))
