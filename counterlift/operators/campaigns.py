"""Campaign preparation: bookings to assets, SKUs, stores, gates and compliance.

Delimited lists are unpacked once and stay long tables (one row per element);
no operator packs all SKUs or stores of a campaign into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import split_list, trailing_digit
from counterlift.operators.design import bucketed_row_number

K = "campaign_id"

# Fixed values of the reporting taxonomy.
MASS_MEDIA_TYPES = [
    "Counter Card", "POC", "Spotify", "YouTube", "Social", "Social - Wrapper", "Build Capacity",
]
IN_STORE_LOCATIONS = ["Category", "Aisle", "Store", "Screens", "Emma Reach"]
REPORTING_TYPE = {
    "Always On eDMs": "eDM",
    "Single Send eDM": "eDM",
    "BRANDED SHOP": "Branded Shop",
    "CONTENT CARD": "Content Card",
    "Digital Standalone Catalogue": "Catalogue",
    "Display Recipes - Wrapper": "Display Recipes",
    "RECIPE PACKAGE": "Display Recipes",
    "Recipe Package": "Display Recipes",
    "Standalone Catalogue - Double Spot": "Catalogue",
    "Standalone Catalogue - Single Spot": "Catalogue",
    "Standalone Catalogue- Third Page Vertical": "Catalogue",
    "Catalogue Card": "Catalogue",
    "BF Meal": "Others",
    "Sampling": "Others",
    "Bus Stop": "in-store",
    "Display Promo Tile": "in-store",
    "Aisle Fin": "in-store",
    "Additional Production Fees": "Others",
    "Event": "Others",
    "National Radio": "Mass_Social_Media",
    "Chilled Bus Stop & Decal Package": "in-store",
    "National TV": "Mass_Social_Media",
    "Press": "Mass_Social_Media",
    "Content Card": "Others",
    "Competition Management Fee": "Others",
    "Prize pool": "Others",
    "Chilled Fin Package": "in-store",
    "Editorial": "Mass_Social_Media",
    "BUS STOP": "in-store",
    "Door Take": "in-store",
    "Freezer Package": "in-store",
    "PL - Mag": "Others",
    "PL - Fresh Mag": "Others",
    "PL - Demos": "Others",
    "Pelmet": "in-store",
    "Overlay Card": "in-store",
    "Mass/Social Media": "Others",
}
DROPPED_STATUSES = ["Not Approved", "Draft", "For Review", "Sent"]
UNBOOKABLE_TYPES = ["Counter Card", "POC", "Spotify", "YouTube", "Social", "Social - Wrapper", "Event"]
UNBOOKABLE_MEDIA = ["Competition Management Fee", "Additional Production Fees"]
REPORTED_EXCLUSIONS = ["in-store", "Others", "eDM", "Radio", "Mass_Social_Media"]
REPORTED_EXCLUSION_PATTERNS = ["%Woolworths Rewards%", "%SAMPLING%", "%Road Block%"]
COMPLIANCE_TYPES = ["AISLE FIN", "BUS STOP", "CATEGORY HEADER", "DECAL", "FLOOR MEDIA"]


def reporting_type() -> Column:
    """Reporting type of a booking line; the first rule that applies wins."""
    mt, loc, media = F.col("media_type"), F.col("media_location"), F.col("media")
    table = F.create_map(*[F.lit(x) for kv in REPORTING_TYPE.items() for x in kv])
    exact = F.try_element_at(table, mt)
    return (
        F.when(loc.like("%TV%"), "Mass_Social_Media")
        .when(mt.isin(MASS_MEDIA_TYPES), "Mass_Social_Media")
        .when(loc.isin(IN_STORE_LOCATIONS), "in-store")
        .when(media.like("%FB Post%"), "Mass_Social_Media")
        .when(exact.isNotNull(), exact)
        .when(F.lower(mt).like("%catalogue%"), "Catalogue")
        .when(F.lower(mt).like("%homepage%"), "Home Page")
        .otherwise(mt)
    )


def media_taxonomy(bookings: DataFrame, from_date: str, before_date: str) -> DataFrame:
    """Approved digital booking lines per article with their reporting type and spend."""
    loc, media = F.col("media_location"), F.col("media")
    bookable = bookings.filter(
        (F.col("business_unit") == "Supermarket")
        & F.col("booking_number").isNotNull()
        & ~F.col("quote_status").isin(DROPPED_STATUSES)
        & ~loc.isin(IN_STORE_LOCATIONS)
        & ~loc.like("%TV%")
        & ~F.col("media_type").isin(UNBOOKABLE_TYPES)
        & ((loc != "None") | media.like("%FB Post%") | media.like("%Branded%") | media.like("%Segments%"))
        & ~media.isin(UNBOOKABLE_MEDIA)
        & (F.col("media_start_date") >= F.lit(from_date).cast("date"))
        & (F.col("media_end_date") < F.lit(before_date).cast("date"))
    )
    mt = F.col("media_type")
    reported = ~mt.isin(REPORTED_EXCLUSIONS) & ~F.lower(mt).like("%branded shop%")
    for pattern in REPORTED_EXCLUSION_PATTERNS:
        reported = reported & ~mt.like(pattern)
    return (
        bookable.withColumn("media_type", reporting_type())
        .withColumn("article", F.explode(split_list("quoteline_sku")))
        .groupBy("booking_number", "campaign_start_date", "campaign_end_date", "line_name", "media_type", "article")
        .agg(
            F.min("media_start_date").alias("media_start_date"),
            F.max("media_end_date").alias("media_end_date"),
            (F.sum("quantity") * F.sum("media_spend")).alias("total_media_spend"),
        )
        .filter(reported)
    )


def compliance_media_type(media_type: Column) -> Column:
    """Audited media group: the first of the known names contained in the type."""
    chain = None
    for name in COMPLIANCE_TYPES:
        hit = F.upper(media_type).like(f"%{name}%")
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("OTHERS")


def campaign_assets(bookings: DataFrame, media_like: Sequence[str] = ("%digital screen%", "%hba screens%")) -> DataFrame:
    """Screen bookings with distinct trimmed SKU and store lists and numbered assets."""
    wanted = F.lit(False)
    for pattern in media_like:
        wanted = wanted | F.lower("media_type").like(pattern)

    def cleaned(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(split_list(c), lambda x: F.trim(x))))

    screens = bookings.filter(
        wanted
        & (F.col("business_unit") == "Supermarket")
        & F.col("store_list").isNotNull()
        & F.col("quoteline_sku").isNotNull()
    )
    # numbered on slim rows, so that the lists stay out of the sort
    slim = screens.select("booking_number", "line_name", "media_start_date")
    numbered = bucketed_row_number(
        slim, ["booking_number"], ["media_start_date", "line_name"], F.coalesce(F.trunc("media_start_date", "month"), F.lit("0001-01-01").cast("date")), "asset_num")
    return screens.join(numbered, ["booking_number", "line_name", "media_start_date"]).select(
        F.concat_ws("_", "booking_number", F.col("asset_num").cast("string")).alias(K),
        "booking_number", "campaign_start_date", "campaign_end_date", "media_start_date", "media_end_date",
        "media_type", "line_name", "asset_num",
        cleaned("quoteline_sku").alias("skus"),
        cleaned("store_list").alias("store_ids"),
    )


def asset_info_per_line(bookings: DataFrame) -> DataFrame:
    """Number of each line inside its booking, in name order."""
    lines = bookings.select("booking_number", "line_name").distinct()
    return (
        bucketed_row_number(lines, ["booking_number"], ["line_name"], F.coalesce(F.substring("line_name", 1, 2), F.lit("")), "asset_number")
        .withColumn("booking_and_asset", F.concat_ws("_", "booking_number", F.col("asset_number").cast("string")))
    )


def campaign_skus(assets: DataFrame) -> DataFrame:
    """campaign_id, article: listed SKUs without blanks and placeholders."""
    return (
        assets.select(K, F.explode("skus").alias("article"))
        .filter((F.col("article") != "") & (F.lower("article") != "npd"))
        .distinct()
    )


def campaign_stores(assets: DataFrame) -> DataFrame:
    """campaign_id, site of every listed store; ids that are no numbers are dropped."""
    return (
        assets.select(K, F.explode("store_ids").alias("s"))
        .select(K, F.col("s").try_cast("long").alias("site"))
        .filter(F.col("site").isNotNull())
        .distinct()
    )


def exclude_empty(assets: DataFrame, skus: DataFrame) -> DataFrame:
    """Campaigns without any usable SKU, with the reason."""
    return (
        assets.select(K).distinct()
        .join(skus.select(K).distinct(), K, "left_anti")
        .withColumn("reason", F.lit("Excluded for having zero promoted skus"))
    )


def exclude_prior_promoted(assets: DataFrame, skus: DataFrame) -> DataFrame:
    """Campaigns whose SKUs were promoted in the equally long window before the start."""
    dates = assets.select(K, "media_start_date", "media_end_date")
    mine = skus.join(dates, K)
    listed = assets.select(
        F.explode("skus").alias("article"),
        F.col("campaign_start_date").alias("other_start"),
        F.col("campaign_end_date").alias("other_end"),
    ).distinct()
    length = F.datediff("media_end_date", "media_start_date")
    return (
        mine.join(listed, "article")
        .filter(
            (F.col("other_start") >= F.date_sub("media_start_date", length))
            & (F.col("other_end") <= F.date_sub("media_start_date", 1))
        )
        .select(K)
        .distinct()
        .withColumn("reason", F.lit("Excluded for having promoted skus in the pre period"))
    )


def audit_week(label) -> Column:
    """Week of an audit: the installation counts as week 1, else the label's last digit."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == "Installation", 1).otherwise(trailing_digit(c))


def compliance_schema(bookings: DataFrame, audit: DataFrame) -> DataFrame:
    """Audited booking lines per store and run week."""
    checked = (
        audit.filter(F.col("missing_record_flag") == 0)
        .select(
            K,
            F.col("quote_line").alias("line_name"),
            F.col("store_id").cast("long").alias("site"),
            audit_week("week_number").alias("week_number"),
            F.col("result").alias("is_compliant"),
        )
        .distinct()
    )
    lines = bookings.select(
        F.col("booking_number").alias(K),
        "line_name",
        "campaign_start_date",
        "campaign_end_date",
        compliance_media_type(F.col("media_type")).alias("media_type"),
        "media_location",
        "media_start_date",
    )
    return (
        lines.join(checked, [K, "line_name"])
        .withColumn("run_week_start", F.date_add("media_start_date", (F.col("week_number") - 1) * 7))
        .drop("media_start_date")
    )


def campaign_info(
    bookings: DataFrame, articles: DataFrame, sales: DataFrame, schema: DataFrame, from_date: str
) -> DataFrame:
    """Categories, sub-categories and compliance counts of each audited line and week."""
    sold = (
        sales.filter((F.col("txn_date") >= F.lit(from_date).cast("date")) & (F.col("sales_amount") > 0))
        .select("article")
        .distinct()
    )
    line_cats = (
        bookings.select(
            F.col("booking_number").alias(K), "line_name", F.explode(split_list("quoteline_sku")).alias("article")
        )
        .join(articles.filter(F.col("subcat") != ""), "article")
        .join(sold, "article", "left_semi")
        .groupBy(K, "line_name")
        .agg(
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.array_sort(F.collect_set("subcat")).alias("subcats"),
        )
    )
    ok, bad = F.col("is_compliant") == 1, F.col("is_compliant") == 0
    counts = schema.groupBy(K, "line_name", "media_type", "campaign_start_date", "week_number", "run_week_start").agg(
        F.count_distinct("site").alias("n_stores"),
        F.count_distinct(F.when(ok, F.col("site"))).alias("n_compliant_stores"),
        F.count_distinct(F.when(bad, F.col("site"))).alias("n_non_compliant_stores"),
    )
    return counts.join(line_cats, [K, "line_name"], "left")


def instore_only(bookings: DataFrame) -> DataFrame:
    """1 for bookings that have nothing but in-store assets."""
    in_store = (
        F.upper("media_type").like("%SCREEN%")
        | F.col("media_location").isin("Category", "Aisle", "Store")
        | F.lower("media_type").like("%bus stop%")
    )
    return bookings.groupBy(F.col("booking_number").alias(K)).agg(
        F.min(F.when(in_store, 1).otherwise(0)).alias("instore_only")
    )


def concurrent_campaigns(info: DataFrame) -> DataFrame:
    """Whether another campaign ran in the same week with a common sub-category, and which.

    Campaigns are counted per (week, sub-category) instead of pairing all lines of
    a week; a line without such a campaign lists all others of its week.
    """
    lines = info.select(K, "line_name", "run_week_start", "subcats").distinct()
    sub = lines.withColumn("subcat", F.explode("subcats")).filter(F.col("subcat") != "")
    per_subcat = sub.groupBy("run_week_start", "subcat").agg(F.collect_set(K).alias("ids"))
    per_week = lines.groupBy("run_week_start").agg(F.collect_set(K).alias("week_ids"))
    own = F.array(F.col(K))
    matches = (
        sub.join(per_subcat, ["run_week_start", "subcat"])
        .groupBy(K, "line_name", "run_week_start")
        .agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        .withColumn("ids", F.array_except("ids", own))
    )
    some = F.size("ids") > 0
    return (
        lines.select(K, "line_name", "run_week_start").distinct()
        .join(matches, [K, "line_name", "run_week_start"], "left")
        .join(per_week, "run_week_start")
        .select(
            K, "line_name", "run_week_start",
            F.when(some, 1).otherwise(0).alias("matching_subcat_flag"),
            F.array_sort(F.when(some, F.col("ids")).otherwise(F.array_except("week_ids", own))).alias("overlapping_ids"),
        )
    )


def concurrent_pairs(info: DataFrame) -> DataFrame:
    """``concurrent_campaigns`` as a long table: one row per line, week and other campaign, with no list built.

    Others with a common sub-category, or, for a line without any, all others of its week.
    """
    lines = info.select(K, "line_name", "run_week_start", "subcats").distinct()
    key = [K, "line_name", "run_week_start"]
    sub = lines.withColumn("subcat", F.explode("subcats")).filter(F.col("subcat") != "").select(*key, "subcat").distinct()
    others = sub.select(F.col(K).alias("other"), "run_week_start", "subcat").distinct()
    met = sub.join(others, ["run_week_start", "subcat"]).filter(F.col("other") != F.col(K)).select(*key, "other").distinct()
    week = lines.select(F.col(K).alias("other"), "run_week_start").distinct()
    alone = lines.select(*key).distinct().join(met.select(*key).distinct(), key, "left_anti")
    rest = alone.join(week, "run_week_start").filter(F.col("other") != F.col(K))
    return met.withColumn("matching_subcat_flag", F.lit(1)).unionByName(rest.select(*key, "other").withColumn("matching_subcat_flag", F.lit(0)))


def discount_depth(schema: DataFrame, bookings: DataFrame, price_lines: DataFrame) -> DataFrame:
    """How far the paid price of a line's SKUs fell below the unit price in its run week."""
    weeks = schema.select(K, "line_name", "media_type", "week_number", "run_week_start").distinct()
    skus = bookings.select(
        F.col("booking_number").alias(K), "line_name", F.explode(split_list("quoteline_sku")).alias("article")
    )
    keys = [K, "line_name", "media_type", "week_number", "run_week_start"]
    priced = (
        price_lines.filter(F.col("unit_price") > 0)
        .join(skus.join(weeks, [K, "line_name"]), "article")
        .filter(F.col("txn_date").between(F.col("run_week_start"), F.date_add("run_week_start", 6)))
        .groupBy(*keys)
        .agg(F.avg("unit_price").alias("p"), F.sum("amount").alias("a"), F.sum("quantity").alias("q"))
    )
    depth = F.try_divide(F.col("p") - F.try_divide("a", "q"), F.col("p"))
    return weeks.join(priced, keys, "left").select(*keys, depth.alias("average_discount_depth"))


def compliance_cohorts(schema: DataFrame) -> DataFrame:
    """Stores of a campaign grouped by the media combination of week 1."""
    week1 = schema.filter((F.col("week_number") == 1) & (F.col("media_type") != "OTHERS"))
    combos = week1.groupBy(K, "site").agg(
        F.array_join(F.array_sort(F.collect_set("line_name")), ",").alias("line_names_string"),
        F.array_join(F.array_sort(F.collect_set("media_type")), ",").alias("media_types_string"),
    )
    number = F.row_number().over(W.partitionBy(K).orderBy("media_types_string"))
    numbered = combos.select(K, "media_types_string").distinct().withColumn("media_split_cohort", number)
    return (
        week1.select(K, "site", "campaign_start_date", "line_name", "media_type", "is_compliant")
        .join(combos, [K, "site"])
        .join(numbered, [K, "media_types_string"])
    )


def compliant_first_campaign(schema: DataFrame) -> DataFrame:
    """First start date of each campaign with its compliant media and number of stores."""
    return (
        schema.filter((F.col("is_compliant") == 1) & (F.col("week_number") == 1) & (F.col("media_type") != "OTHERS"))
        .groupBy(K, "campaign_start_date")
        .agg(
            F.array_join(F.array_sort(F.collect_set("media_type")), ",").alias("media_types"),
            F.count_distinct("site").alias("n_compliant_stores"),
        )
        .withColumn("n", F.row_number().over(W.partitionBy(K).orderBy("campaign_start_date")))
        .filter(F.col("n") == 1)
        .drop("n")
    )


def first_campaign_members(schema: DataFrame, bookings: DataFrame) -> DataFrame:
    """Compliant stores and SKUs of each campaign's first compliant start, one row per member.

    campaign_id, campaign_start_date, kind (``store`` or ``sku``) and member.
    """
    rows = schema.filter((F.col("is_compliant") == 1) & (F.col("week_number") == 1) & (F.col("media_type") != "OTHERS"))
    first = rows.groupBy(K).agg(F.min("campaign_start_date").alias("campaign_start_date"))
    kept = rows.join(first, [K, "campaign_start_date"]).select(K, "campaign_start_date", "site", "line_name")
    stores = kept.select(K, "campaign_start_date", F.lit("store").alias("kind"), F.col("site").cast("string").alias("member"))
    listed = bookings.select(F.col("booking_number").alias(K), "line_name", F.explode(split_list("quoteline_sku")).alias("member"))
    skus = kept.select(K, "campaign_start_date", "line_name").distinct().join(listed, [K, "line_name"]).select(
        K, "campaign_start_date", F.lit("sku").alias("kind"), "member")
    return stores.unionByName(skus).filter(F.col("member").isNotNull()).distinct()


def week1_skus(schema: DataFrame, bookings: DataFrame) -> DataFrame:
    """campaign_id, article of all media that started with the campaign."""
    campaigns = schema.select(K, "campaign_start_date").distinct()
    return (
        bookings.select(F.col("booking_number").alias(K), F.col("media_start_date").alias("campaign_start_date"), "quoteline_sku")
        .join(campaigns, [K, "campaign_start_date"], "left_semi")
        .select(K, F.explode(split_list("quoteline_sku")).alias("article"))
        .distinct()
    )


def compliant_media(cohorts: DataFrame) -> DataFrame:
    """Compliant and non-compliant media of each store as sorted lists."""
    def listed(flag: int) -> Column:
        picked = F.collect_list(F.when(F.col("is_compliant") == flag, F.col("media_type")))
        return F.array_join(F.array_sort(picked), ", ")

    return cohorts.groupBy(
        K, "site", F.concat(F.lit("GROUP "), F.col("media_split_cohort").cast("string")).alias("test_group")
    ).agg(listed(1).alias("compliant"), listed(0).alias("non_compliant"))


def single_media(taxonomy: DataFrame, media_type: str, min_skus: int = 6) -> DataFrame:
    """Bookings with one media type only and enough SKUs."""
    return (
        taxonomy.groupBy("booking_number")
        .agg(
            F.count_if(F.col("media_type") != media_type).alias("others"),
            F.count_distinct("article").alias("n_skus"),
        )
        .filter((F.col("others") == 0) & (F.col("n_skus") >= min_skus))
        .select("booking_number", "n_skus")
    )


def media_combinations(cohorts: DataFrame) -> DataFrame:
    return cohorts.select("media_types_string").distinct()


def campaign_counts_by_month(periods: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns with pre-period sales per start month."""
    measured = periods.groupBy(K).agg(F.sum("sales_pre").alias("s")).filter(F.col("s").isNotNull())
    return (
        campaigns.join(measured, K, "left_semi")
        .groupBy(F.trunc("campaign_start_date", "month").alias("start_month"))
        .agg(F.count_distinct(K).alias("n_campaigns"))
    )


def campaign_counts_by_category(info: DataFrame, flags: DataFrame, depth: DataFrame, max_depth: float = 0.05) -> DataFrame:
    """Campaigns per category, in-store only and (nearly) undiscounted ones apart."""
    rows = (
        info.select(K, "line_name", "week_number", F.explode("categories").alias("category"))
        .join(flags, K)
        .join(depth.select(K, "line_name", "week_number", "average_discount_depth"), [K, "line_name", "week_number"], "left")
    )
    only, flat = F.col("instore_only") == 1, F.col("average_discount_depth") <= max_depth
    return rows.groupBy("category").agg(
        F.count_distinct(K).alias("n_campaigns"),
        F.count_distinct(F.when(only, F.col(K))).alias("n_instore_only"),
        F.count_distinct(F.when(flat, F.col(K))).alias("n_no_discount"),
        F.count_distinct(F.when(only & flat, F.col(K))).alias("n_instore_only_no_discount"),
    )
