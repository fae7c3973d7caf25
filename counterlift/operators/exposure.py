"""Web hits to campaign exposures, control shoppers and conversions.

The SKUs of an exposure are not packed into its row.  An exposure names a
``sku_set`` and the long table ``booking_id, sku_set, article`` holds its SKUs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import packed_part, prefix_before_dash, safe_divide, within_dates_inclusive
from counterlift.operators.intervals import after, moment, segments, with_open_set
from counterlift.session import cut_lineage

NOT_FOUND = "Not Found"
CATALOGUE, HOME_PAGE = "Catalogue", "Home Page"


def brand_map(products: DataFrame, sales_org: str = "1005") -> DataFrame:
    """article -> brand and sub-category, without placeholder brands."""
    return (
        products.filter(
            (F.col("sales_org") == sales_org)
            & ~F.upper("brand").isin("UNBRANDED", "OTHER", "")
            & F.col("subcat").isNotNull()
        )
        .groupBy(prefix_before_dash("product_number").alias("article"))
        .agg(F.max("subcat").alias("subcat"), F.max("brand").alias("brand"))
    )


def unified_transactions(
    instore: DataFrame, cards: DataFrame, online: DataFrame, shoppers: DataFrame, brands: DataFrame
) -> DataFrame:
    """In-store card transactions and online orders under one customer number."""
    store = (
        instore.filter(
            (F.length("card") > 3) & F.col("division").isin(1005, 1030) & (F.lower("void_flag") == "n")
        )
        .join(cards.filter(F.length("crn") > 3), "card")
        .select(
            F.lit("Instore Order").alias("order_context"), "start_txn_date", "start_txn_time",
            F.col("crn").alias("shopper_id"), "article", "basket_key", "amount",
        )
    )
    web = online.join(shoppers, "customer_number", "left").select(
        F.lit("Online Order").alias("order_context"), "start_txn_date", "start_txn_time",
        F.col("crn").alias("shopper_id"), "article", "basket_key", "amount",
    )
    return store.unionByName(web).join(brands, "article", "left")


def identity_asof(hits: DataFrame, id_map: DataFrame, on: str = "visitor_id", ts: str = "date_time") -> DataFrame:
    """Adds the mapped identity valid at the time of each hit (NULL when there is none).

    A newer window replaces an older one from its effective time on.  The windows
    are made disjoint on the small map, so the join never duplicates a hit.
    """
    following = F.lead("effective_time").over(W.partitionBy(on).orderBy("effective_time"))
    windows = id_map.withColumn("_next", following)
    keep = [c for c in id_map.columns if c not in (on, "effective_time", "expiry_time")]
    h, m = hits.alias("h"), windows.alias("m")
    valid = (
        (F.col(f"h.{on}") == F.col(f"m.{on}"))
        & (F.col(f"h.{ts}") >= F.col("m.effective_time"))
        & (F.col(f"h.{ts}") <= F.col("m.expiry_time"))
        & (F.col("m._next").isNull() | (F.col(f"h.{ts}") < F.col("m._next")))
    )
    return h.join(m, valid, "left").select("h.*", *[f"m.{c}" for c in keep])


def _on_campaign_page() -> Column:
    catalogue = (packed_part("page_name", 2) == "catalogue") | (F.lower("section") == "catalogue")
    home = F.col("page_name") == "ww:homepage"
    has_asset = packed_part("packed_key", 3).isNotNull()
    return F.coalesce(catalogue, F.lit(False)) | home | has_asset


def _identified_pages(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    pages = hits.filter(_on_campaign_page() & (F.col("channel") != "Order Confirmation Section"))
    return identity_asof(pages, id_map).filter(F.col("shopper_id").isNotNull() | F.col("crn").isNotNull())


def asset_impressions(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """Identified hits on catalogue, home and asset pages with flags and packed ids."""
    catalogue = (packed_part("page_name", 2) == "catalogue") | (F.lower("section") == "catalogue")
    return _identified_pages(hits, id_map).select(
        "event_id", "visitor_id", "date_time", "shopper_id", "crn", "page_name", "action", "site_platform", "search_term",
        F.when(catalogue, 1).otherwise(0).alias("catalogue_flag"),
        F.when(F.col("page_name") == "ww:homepage", 1).otherwise(0).alias("homepage_flag"),
        F.coalesce(packed_part("packed_key", 0), F.lit(NOT_FOUND)).alias("booking_id"),
        packed_part("packed_key", 3).alias("ci_id"),
    )


def active_visitors(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """Distinct day, shopper and customer seen on those pages."""
    return _identified_pages(hits, id_map).select(
        F.col("date_time").cast("date").alias("date"), "shopper_id", "crn"
    ).distinct()


def sku_sets(taxonomy: DataFrame) -> DataFrame:
    """booking_id, sku_set, article: per line, and per medium for catalogue and home page."""
    per_line = taxonomy.select(F.col("booking_number").alias("booking_id"), F.col("line_name").alias("sku_set"), "article")
    per_medium = taxonomy.filter(F.col("media_type").isin(CATALOGUE, HOME_PAGE)).select(
        F.col("booking_number").alias("booking_id"), F.col("media_type").alias("sku_set"), "article"
    )
    return per_line.union(per_medium).distinct()


_DATES = ["campaign_start_date", "campaign_end_date", "media_start_date", "media_end_date"]


def attribute_exposures(impressions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Impressions joined to the campaigns they belong to, by one of three rules.

    With an asset id: the booking line of that id.  Without a booking: catalogue
    and home-page hits belong to every booking with such media at that time; a hit
    first gets the set of bookings open at it, and sets are resolved last.
    """
    lines = taxonomy.select(
        F.col("booking_number").alias("booking_id"), F.col("line_name").alias("ci_id"), "media_type", *_DATES
    ).distinct()
    base = impressions.select("date_time", "shopper_id", "crn", "booking_id", "ci_id", "catalogue_flag", "homepage_flag")
    in_time = within_dates_inclusive("date_time", "media_start_date", "media_end_date")
    by_asset = (
        base.filter(F.col("ci_id").isNotNull() & (F.col("ci_id") != ""))
        .join(lines, ["booking_id", "ci_id"])
        .filter(in_time)
        .withColumns({"join_method": F.lit("CI ID Rows"), "sku_set": F.col("ci_id")})
    )

    def by_time(flag: str, media: str, method: str) -> DataFrame:
        seen, members = open_media(impressions, taxonomy, flag, media)
        hits = seen.select("date_time", "shopper_id", "crn", "ci_id", "catalogue_flag", "homepage_flag", "set_id")
        named = hits.filter("set_id IS NOT NULL").join(members, "set_id").drop("set_id")
        return named.withColumns({"join_method": F.lit(method), "sku_set": F.lit(media)})

    return by_asset.unionByName(by_time("catalogue_flag", CATALOGUE, "Catalogue")).unionByName(
        by_time("homepage_flag", HOME_PAGE, "Homepage Rows")
    ).drop("catalogue_flag", "homepage_flag")


def open_media(impressions: DataFrame, taxonomy: DataFrame, flag: str, media: str) -> tuple[DataFrame, DataFrame]:
    """Impressions without a booking on a medium's pages with the set of bookings open then, and the sets' members."""
    windows = taxonomy.filter(F.lower("media_type") == media.lower()).select(
        F.col("booking_number").alias("booking_id"), "media_type", *_DATES,
        moment(F.col("media_start_date")).alias("lo"), after(F.date_add("media_end_date", 1)).alias("hi"),
    )
    cuts, members = segments(windows, ["booking_id", "media_type", *_DATES])
    hits = impressions.filter((F.col(flag) == 1) & (F.col("booking_id") == NOT_FOUND))
    return with_open_set(hits, moment(F.col("date_time")), cuts), members


def distinct_exposures(exposures: DataFrame) -> DataFrame:
    """Day, booking, asset, medium and identity of every exposed customer once.

    A customer's rows lie together, so later steps by customer shrink them before they are shuffled.
    """
    return exposures.filter(F.col("crn").isNotNull()).select(
        F.col("date_time").cast("date").alias("date"), "booking_id", "campaign_start_date", "campaign_end_date",
        "ci_id", "media_type", "shopper_id", "crn", "sku_set",
    ).repartition("crn").distinct()


def control_shoppers(exposures: DataFrame, active: DataFrame) -> DataFrame:
    """Customers active while a campaign ran that it did not reach by either id."""
    campaigns = exposures.select("booking_id", "campaign_start_date", "campaign_end_date").distinct()
    days = campaigns.withColumns({"lo": F.unix_date("campaign_start_date").cast("long"), "hi": F.unix_date("campaign_end_date").cast("long") + 1})
    cuts, members = segments(days, campaigns.columns, width=7)
    # a shopper meets a set of campaigns once, however many of its days it was active
    seen = with_open_set(active.filter(F.col("crn").isNotNull()), F.unix_date("date").cast("long"), cuts, width=7)
    present = (
        seen.filter("set_id IS NOT NULL").select("set_id", "shopper_id", "crn").distinct()
        .join(members, "set_id")
        .select("booking_id", "campaign_start_date", "campaign_end_date", "shopper_id", "crn")
        .distinct()
    )
    key = ["booking_id", "campaign_start_date"]
    return present.join(
        exposures.select(*key, "shopper_id").distinct(), [*key, "shopper_id"], "left_anti"
    ).join(exposures.select(*key, "crn").distinct(), [*key, "crn"], "left_anti")


def union_cohorts(exposures: DataFrame, controls: DataFrame) -> DataFrame:
    """Exposed and not exposed customers in one table; a control has no exposure day.

    A control customer stands for every SKU set of the campaign's exposures.
    """
    sets = exposures.select("booking_id", "sku_set").distinct()
    control_rows = controls.join(sets, "booking_id").withColumn("cohort", F.lit("Not Exposed"))
    return exposures.withColumn("cohort", F.lit("Exposed")).unionByName(control_rows, allowMissingColumns=True)


def cohort_people(exposures: DataFrame, controls: DataFrame) -> DataFrame:
    """Every customer of a cohort once per campaign, without the days and sets of ``union_cohorts``."""
    cols = ["booking_id", "campaign_start_date", "campaign_end_date", "crn"]
    exposed = exposures.select(*cols, F.lit("Exposed").alias("cohort"))
    return exposed.unionByName(controls.select(*cols, F.lit("Not Exposed").alias("cohort"))).distinct()


def purchases_of(people: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions of the customers of any cohort; the semi join reaches the orders before their lines."""
    return txns.join(people.select(F.col("crn").alias("shopper_id")).distinct(), "shopper_id", "left_semi")


def conversions(cohorts: DataFrame, txns: DataFrame, sets: DataFrame, level: str = "sku", brands: DataFrame | None = None) -> DataFrame:
    """Purchases of each cohort row inside the campaign dates, by SKU or by brand.

    One row per purchase line of a cohort row, labelled ``3 Days`` or ``7 Days``
    after the exposure.  A cohort row whose SKU set has members it did not buy
    gets one more row without purchase; ``n_unmatched`` says for how many members.
    Transactions are tagged with campaign and set first, so that cohort rows are
    never multiplied by their SKUs.
    """
    item = "article" if level == "sku" else "brand"
    # a booking has many more sets than its exposures name; the others meet no cohort row
    members = sets.join(cohorts.select("booking_id", "sku_set").distinct(), ["booking_id", "sku_set"], "left_semi")
    if level != "sku":
        members = members.join(brands.select("article", "brand"), "article").select("booking_id", "sku_set", "brand").distinct()
    dates = cohorts.select("booking_id", "campaign_start_date", "campaign_end_date").distinct()
    first = dates.select(F.min("campaign_start_date")).scalar()
    last = dates.select(F.max("campaign_end_date")).scalar()
    day = F.col("start_txn_time").cast("date")
    tagged = (
        txns.filter(F.col("shopper_id").isNotNull() & (day >= first) & (day <= last))
        .join(members.join(dates, "booking_id"), item)
        .filter(day.between(F.col("campaign_start_date"), F.col("campaign_end_date")))
        .select(
            "booking_id", "sku_set", F.col("shopper_id").alias("crn"), "order_context", "start_txn_time",
            "basket_key", "brand", "article", "amount",
        )
    )
    rows = cohorts.select(
        F.col("date").alias("impression_date"), "booking_id", "sku_set", F.col("cohort").alias("exposure_context"), "ci_id",
        "media_type", "crn",
    )
    key = ["booking_id", "sku_set", "crn"]
    bought = rows.hint("merge").join(tagged, key).withColumns(  # rows look small to the optimizer
        {"converted_crn": F.col("crn"), "n_unmatched": F.lit(0).cast("long")}
    )
    sizes = members.groupBy("booking_id", "sku_set").agg(F.count(F.lit(1)).alias("size"))
    got = tagged.groupBy(*key).agg(F.count_distinct(item).alias("got"))
    missing = (
        rows.join(sizes, ["booking_id", "sku_set"])
        .join(got.hint("merge"), key, "left")
        .withColumn("n_unmatched", F.col("size") - F.coalesce("got", F.lit(0)))
        .filter(F.col("n_unmatched") > 0)
        .drop("size", "got")
    )
    label = F.when(
        F.col("start_txn_time").cast("date") < F.date_add("impression_date", 3), "3 Days"
    ).otherwise("7 Days")
    return (
        bought.unionByName(missing, allowMissingColumns=True)
        .withColumn("exposure_to_purchase_window", label)
        .withColumnRenamed("crn", "exposure_crn")
    )


def conversion_lines(
    exposures: DataFrame, controls: DataFrame, txns: DataFrame, sets: DataFrame, level: str = "sku", brands: DataFrame | None = None
) -> DataFrame:
    """``conversions`` without repeats: one row per cohort, customer and purchase line.

    ``n_rows`` says for how many exposures, or sets of a control, the line counts, and last_exposure is
    the latest of the exposures; the label is ``3 Days`` if that one makes it so.  A customer whose sets have
    members it did not buy gets one more row; ``n_unmatched`` counts them over its exposures or sets.
    Purchases are tagged with booking and item only and meet the customers before any set is resolved;
    how many of a booking's sets hold an item comes from the inverted index item -> sets.
    """
    item = "article" if level == "sku" else "brand"
    members = sets
    if level != "sku":
        members = sets.join(brands.select("article", "brand"), "article").select("booking_id", "sku_set", "brand").distinct()
    key = ["booking_id", "crn"]
    rows = exposures.groupBy("booking_id", "sku_set", "crn").agg(F.count(F.lit(1)).alias("times"), F.max("date").alias("latest"))
    used = exposures.select("booking_id", "sku_set").distinct()
    index = members.join(used, ["booking_id", "sku_set"], "left_semi")
    held = index.groupBy("booking_id", item).agg(F.count(F.lit(1)).alias("n_sets"))
    sizes = index.groupBy("booking_id", "sku_set").agg(F.count(F.lit(1)).alias("size"))
    dates = exposures.select("booking_id", "campaign_start_date", "campaign_end_date").distinct()
    first = dates.select(F.min("campaign_start_date")).scalar()
    last = dates.select(F.max("campaign_end_date")).scalar()
    day = F.col("start_txn_time").cast("date")
    people = exposures.select(*key, F.lit("Exposed").alias("exposure_context")).distinct().unionByName(
        controls.select(*key, F.lit("Not Exposed").alias("exposure_context"), F.lit(1).alias("one")).groupBy(*key, "exposure_context").agg(F.count("one").alias("copies")),
        allowMissingColumns=True)
    lines = cut_lineage(
        txns.filter(F.col("shopper_id").isNotNull() & (day >= first) & (day <= last))
        .join(held.join(dates, "booking_id"), item)
        .filter(day.between(F.col("campaign_start_date"), F.col("campaign_end_date")))
        .withColumnRenamed("shopper_id", "crn")
        .join(people, key)
        .groupBy(*key, "exposure_context", "copies", "n_sets", "order_context", "start_txn_time", "basket_key", "brand", "article", "amount")
        .agg(F.count(F.lit(1)).alias("alike"))
    )
    control = F.col("exposure_context") == "Not Exposed"
    bought = lines.select(*key, "exposure_context", item, "n_sets", "copies").distinct()
    # exposed customers: which of their exposures' sets hold the item
    met = bought.filter(~control).select(*key, item).join(index, ["booking_id", item]).join(rows, [*key, "sku_set"])
    reach = met.groupBy(*key, item).agg(F.sum("times").alias("times"), F.max("latest").alias("last_exposure"))
    exposed = lines.filter(~control).join(reach, [*key, item]).withColumn("n_rows", F.col("times") * F.col("alike"))
    others = lines.filter(control).withColumns({"n_rows": F.col("n_sets") * F.col("copies") * F.col("alike"), "last_exposure": F.lit(None).cast("date")})
    names = [*key, "exposure_context", "order_context", "start_txn_time", "basket_key", "brand", "article", "amount", "n_rows", "last_exposure"]
    found = exposed.select(*names).unionByName(others.select(*names)).withColumns({"converted_crn": F.col("crn"), "n_unmatched": F.lit(0).cast("long")})
    of_exposed = rows.join(sizes, ["booking_id", "sku_set"]).groupBy(*key).agg(F.sum(F.col("times") * F.col("size")).alias("all")).withColumn("exposure_context", F.lit("Exposed"))
    of_booking = sizes.groupBy("booking_id").agg(F.sum("size").alias("all"))
    of_control = people.filter(control).join(of_booking, "booking_id").select(*key, (F.col("all") * F.col("copies")).alias("all"), "exposure_context")
    got = reach.groupBy(*key).agg(F.sum("times").alias("got")).withColumn("exposure_context", F.lit("Exposed")).unionByName(
        bought.filter(control).groupBy(*key, "exposure_context").agg(F.sum(F.col("n_sets") * F.col("copies")).alias("got")))
    missing = (
        of_exposed.unionByName(of_control)
        .join(got, [*key, "exposure_context"], "left")
        .withColumn("n_unmatched", F.col("all") - F.coalesce("got", F.lit(0)))
        .filter(F.col("n_unmatched") > 0)
        .select(*key, "exposure_context", "n_unmatched")
    )
    early = F.col("start_txn_time").cast("date") < F.date_add("last_exposure", 3)
    return (
        found.unionByName(missing, allowMissingColumns=True)
        .withColumn("exposure_to_purchase_window", F.when(early, "3 Days").otherwise("7 Days"))
        .withColumnRenamed("crn", "exposure_crn")
    )


def distinct_sales(conv: DataFrame, window: str = "7 Days") -> DataFrame:
    """Distinct purchase lines per customer; the 3-day subset keeps non-converters."""
    if window == "3 Days":
        conv = conv.filter((F.col("exposure_to_purchase_window") == "3 Days") | F.col("converted_crn").isNull())
    return conv.select(
        "booking_id", "exposure_context", "order_context", "exposure_crn", "converted_crn", "start_txn_time",
        "basket_key", "brand", "article", "amount",
    ).distinct()


def window_aggregate(sales: DataFrame, by: Sequence[str] = ("booking_id",)) -> DataFrame:
    """Exposed and converted shoppers, baskets, online and in-store sales."""
    online = F.col("order_context") == "Online Order"
    return sales.groupBy(*by).agg(
        F.count_distinct("exposure_crn").alias("exposed_shoppers"),
        F.count_distinct("converted_crn").alias("converted_shoppers"),
        F.count_distinct("basket_key").alias("baskets"),
        F.sum(F.when(online, F.col("amount")).otherwise(0.0)).alias("sales_online"),
        F.sum(F.when(~online, F.col("amount")).otherwise(0.0)).alias("sales_instore"),
    )


def compare_windows(sku_conv: DataFrame, brand_conv: DataFrame) -> DataFrame:
    """3-day and 7-day results by SKU and brand, side by side with conversion rates."""
    tagged = None
    for level, conv in (("sku", sku_conv), ("brand", brand_conv)):
        for window, days in (("3 Days", 3), ("7 Days", 7)):
            part = window_aggregate(distinct_sales(conv, window)).withColumn("slice", F.lit(f"{level}_{days}"))
            tagged = part if tagged is None else tagged.unionByName(part)
    wide = tagged.groupBy("booking_id").pivot("slice", ["sku_3", "sku_7", "brand_3", "brand_7"]).agg(
        F.max("exposed_shoppers").alias("exposed"),
        F.max("converted_shoppers").alias("converted"),
        F.max("baskets").alias("baskets"),
    )
    rates = {f"{s}_rate": safe_divide(f"{s}_converted", f"sku_{s[-1]}_exposed") for s in ("sku_3", "sku_7", "brand_3", "brand_7")}
    return wide.withColumns(rates)


def totals_check(sku_sales: DataFrame, brand_sales: DataFrame) -> DataFrame:
    """Exposed and converted counts by SKU and by brand with their differences."""
    def counts(df: DataFrame, level: str) -> DataFrame:
        return df.groupBy("booking_id").agg(
            F.count_distinct("exposure_crn").alias(f"n_exposed_{level}"),
            F.count_distinct("converted_crn").alias(f"n_converted_{level}"),
        )

    return counts(sku_sales, "sku").join(counts(brand_sales, "brand"), "booking_id", "left").withColumns(
        {
            "exposed_diff": F.col("n_exposed_brand") - F.col("n_exposed_sku"),
            "converted_diff": F.col("n_converted_brand") - F.col("n_converted_sku"),
        }
    )


def tagged_totals(sku_sales: DataFrame, brand_sales: DataFrame) -> DataFrame:
    def total(df: DataFrame, level: str) -> DataFrame:
        return df.agg(F.sum("amount").alias("total"), F.count_distinct("basket_key").alias("baskets")).select(
            F.lit(level).alias("level"), "total", "baskets"
        )

    return total(sku_sales, "sku").unionByName(total(brand_sales, "brand"))


def cohort_overlap(cohorts: DataFrame) -> DataFrame:
    """Customers found in one, two or more cohorts of a campaign."""
    n = F.col("n_cohorts")
    return (
        cohorts.groupBy("booking_id", "crn").agg(F.count_distinct("cohort").alias("n_cohorts"))
        .groupBy("booking_id")
        .agg(
            F.count_if(n == 1).alias("n_one_cohort"),
            F.count_if(n == 2).alias("n_two_cohorts"),
            F.count_if(n > 2).alias("n_more_cohorts"),
        )
    )


def hash_audit(hits: DataFrame) -> DataFrame:
    """Hits whose tracked hash is not the hash of the customer number."""
    own = F.sha2(F.col("crn"), 256)
    return hits.filter(
        F.col("crn").isNotNull() & F.col("hashed_crn").isNotNull() & (own != F.col("hashed_crn"))
    ).select("booking_id", "visitor_id", "crn", "hashed_crn", own.alias("own_hash")).distinct()


def missing_id_counts(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count_distinct(F.when(F.col("hashed_crn").isNull(), F.col("visitor_id"))).alias("n_visitors_no_hash"),
        F.count_distinct(F.when(F.col("visitor_id").isNull(), F.col("hashed_crn"))).alias("n_hash_no_visitor"),
    )


def spend_reconciliation(brand_conv: DataFrame, txns: DataFrame, sets: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Spend by the exposure path against spend straight from the transactions."""
    path = (
        brand_conv.select("booking_id", "exposure_crn", "basket_key", "article", "amount").distinct()
        .groupBy("booking_id", F.col("exposure_crn").alias("crn"))
        .agg(F.sum("amount").alias("spend_by_path"))
    )
    dates = cohorts.select("booking_id", "campaign_start_date", "campaign_end_date").distinct()
    direct = (
        txns.join(sets.select("booking_id", "article").distinct().join(dates, "booking_id"), "article")
        .filter(F.col("start_txn_date").between(F.col("campaign_start_date"), F.col("campaign_end_date")))
        .groupBy("booking_id", F.col("shopper_id").alias("crn"))
        .agg(F.sum("amount").alias("spend_by_transactions"))
    )
    return path.join(direct, ["booking_id", "crn"], "left")


def hashed_key_conversions(exposures: DataFrame, txns: DataFrame, sets: DataFrame, days: int = 7) -> DataFrame:
    """Purchases on a hashed customer key up to ``days`` after each exposure day."""
    seen = exposures.select(
        "booking_id", "sku_set", "date", F.coalesce(F.sha2(F.col("crn"), 256), F.col("hashed_crn")).alias("hashed_key")
    ).distinct()
    first, last = seen.select(F.min("date")).scalar(), seen.select(F.max("date")).scalar()
    when = F.col("start_txn_time").cast("date")
    in_time = (when >= first) & (when <= F.date_add(last, days))  # of any exposure, before anything is joined
    bought = txns.filter(F.col("shopper_id").isNotNull() & in_time).join(sets, "article").select(
        "booking_id", "sku_set", F.sha2(F.col("shopper_id"), 256).alias("hashed_key"), "order_context", "start_txn_time",
        "basket_key", "article", "amount",
    )
    day = F.col("start_txn_time").cast("date")
    return (
        seen.join(bought, ["booking_id", "sku_set", "hashed_key"])
        .filter((day >= F.col("date")) & (day <= F.date_add("date", days)))
        .withColumn("exposure_to_purchase_window", F.when(day < F.date_add("date", 3), "3 Days").otherwise("7 Days"))
        .drop("sku_set")
        .distinct()
    )
