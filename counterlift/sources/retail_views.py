"""Retail view over the supplied star-schema tables.

The supplied tables carry suppliers, parts and web events rather than shops and
shoppers.  This adapter renames them once, so that every operator can be run on
them: supplier = site, part = article, order = basket, brand = campaign booking.
Dates of seven years are folded onto 24 weeks (``FOLD_DAYS``) that overlap the
web events, which gives each site the daily sales a real shop has.

Lists inside a booking line are bounded by construction: a line covers one block
of ``PARTS_PER_LINE`` consecutive parts and ``SITES_PER_LINE`` suppliers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.session import cut_lineage

BASE_DATE = "2023-09-03"  # a Sunday
FOLD_DAYS = 168
CAMPAIGN_OFFSET = 98
CAMPAIGN_DAYS = 28
PARTS_PER_LINE = 1000
SITES_PER_LINE = 50
SALES_ORG = 1005

# media type, media location, media name by line index modulo 8
MEDIA = [
    ("Digital Screen", "Front", "Standard"),
    ("HBA Screens", "Front", "Standard"),
    ("Aisle Fin", "Aisle", "Standard"),
    ("Bus Stop", "Store", "Standard"),
    ("Digital Catalogue", "Digital", "Standard"),
    ("App Homepage", "Digital", "Standard"),
    ("Floor Media", "Category", "Standard"),
    ("Content Card", "None", "Branded Tile"),
]


def fold_date(d: Column) -> Column:
    days = F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")) % FOLD_DAYS
    return F.date_add(F.lit(BASE_DATE).cast("date"), days)


def _pick(index: Column, pos: int) -> Column:
    return F.element_at(F.array(*[F.lit(m[pos]) for m in MEDIA]), (index + 1).cast("int"))


class Retail:
    """Lazily built views of one data directory."""

    def __init__(self, spark: SparkSession, folder: str, result: str | None = None):
        self.spark = spark
        self.folder = folder
        self.result = result
        self._stages: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Stage table written once per job where several later steps read it.

        The stage that is itself the job's result is not written.
        """
        if name == self.result:
            return build()
        if name not in self._stages:
            self._stages[name] = cut_lineage(build())
        return self._stages[name]

    # ---- store side -----------------------------------------------------

    @cached_property
    def sales(self) -> DataFrame:
        """site, article, txn_date, basket_key, sales_amount, units, channel, sales_org."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("site"),
            F.col("l_partkey").cast("string").alias("article"),
            fold_date(F.col("l_shipdate")).alias("txn_date"),
            F.col("l_orderkey").cast("string").alias("basket_key"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_amount"),
            F.col("l_quantity").alias("units"),
            F.when(F.col("l_linenumber") == 1, "Online").otherwise("In Store").alias("channel"),
            F.lit(SALES_ORG).alias("sales_org"),
        )

    @cached_property
    def price_lines(self) -> DataFrame:
        """article, txn_date, amount, unit_price, quantity -- one row per sold line."""
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("unit_price")
        )
        return (
            self.table("lineitem")
            .join(part, "l_partkey")
            .select(
                F.col("l_partkey").cast("string").alias("article"),
                fold_date(F.col("l_shipdate")).alias("txn_date"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 50).alias("amount"),
                "unit_price",
                F.col("l_quantity").alias("quantity"),
            )
        )

    @cached_property
    def articles(self) -> DataFrame:
        """article, description, brand, category, subcat."""
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("article"),
            F.col("p_name").alias("description"),
            F.col("p_brand").alias("brand"),
            F.concat(F.lit("CAT"), (F.col("p_size") % 5).cast("string")).alias("category"),
            F.col("p_type").alias("subcat"),
        )

    @cached_property
    def products(self) -> DataFrame:
        """Product attribute rows whose number is ``article-suffix``."""
        return self.table("part").select(
            F.concat(F.col("p_partkey").cast("string"), F.lit("-EA")).alias("product_number"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("subcat"),
            F.lit("1005").alias("sales_org"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """site and its trading area of at most SITES_PER_LINE sites."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("site"),
            F.floor(F.col("s_suppkey") / SITES_PER_LINE).cast("long").alias("area"),
        )

    @cached_property
    def _line_skus(self) -> DataFrame:
        part = self.table("part")
        return part.select(
            F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("b"),
            F.floor(F.col("p_partkey") / PARTS_PER_LINE).cast("int").alias("blk"),
            F.col("p_partkey"),
        )

    @cached_property
    def _line_stores(self) -> DataFrame:
        """One delimited store list per (b mod 4, block); at most SITES_PER_LINE sites."""
        s = F.col("s_suppkey")
        return (
            self.table("supplier")
            .groupBy(
                (s % 4).cast("int").alias("bmod"),
                F.floor(s / SITES_PER_LINE).cast("int").alias("blk"),
            )
            .agg(F.array_join(F.array_sort(F.collect_list(s.cast("string"))), ",").alias("store_list"))
        )

    @cached_property
    def bookings(self) -> DataFrame:
        """One row per booking line (asset) with its delimited SKU and store lists."""
        key = F.col("p_partkey").cast("string")
        lists = (
            self._line_skus.groupBy("b", "blk")
            .agg(
                F.array_join(F.array_sort(F.collect_list(key)), ",").alias("main_sku"),
                F.array_join(
                    F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 3 == 0, key))), ","
                ).alias("repeat_sku"),
            )
            .withColumn("bmod", F.col("b") % 4)
            .join(self._line_stores, ["bmod", "blk"], "left")
        )
        start = F.date_add(
            F.lit(BASE_DATE).cast("date"), F.lit(CAMPAIGN_OFFSET) + (F.col("b") % 5) * 7
        )
        idx = (F.col("b") + F.col("blk")) % 8
        kinds = F.array(
            F.struct(
                F.lit("main").alias("kind"), F.lit("L").alias("tag"), F.lit(0).alias("shift"), F.lit(27).alias("len"),
                F.concat("main_sku", F.lit(",NPD,")).alias("quoteline_sku"), idx.alias("idx"),
            ),
            F.struct(
                F.lit("repeat").alias("kind"), F.lit("R").alias("tag"), F.lit(-21).alias("shift"), F.lit(20).alias("len"),
                F.col("repeat_sku").alias("quoteline_sku"), F.lit(0).alias("idx"),
            ),
            F.struct(
                F.lit("empty").alias("kind"), F.lit("E").alias("tag"), F.lit(0).alias("shift"), F.lit(27).alias("len"),
                F.lit("npd").alias("quoteline_sku"), F.lit(0).alias("idx"),
            ),
        )
        wanted = (
            (F.col("x.kind") == "main")
            | ((F.col("x.kind") == "repeat") & (F.col("b") % 4 == 0))
            | ((F.col("x.kind") == "empty") & (F.col("b") % 6 == 0))
        )
        return (
            lists.withColumn("x", F.explode(kinds))
            .filter(wanted)
            .select(
                F.format_string("BK%02d", F.col("b")).alias("booking_number"),
                F.concat("x.tag", F.col("blk").cast("string")).alias("line_name"),
                F.col("x.kind").alias("kind"),
                _pick(F.col("x.idx"), 0).alias("media_type"),
                _pick(F.col("x.idx"), 1).alias("media_location"),
                _pick(F.col("x.idx"), 2).alias("media"),
                F.lit("Supermarket").alias("business_unit"),
                F.when(F.col("b") % 12 == 11, "Draft").otherwise("Approved").alias("quote_status"),
                F.date_add(start, F.col("x.shift")).alias("campaign_start_date"),
                F.date_add(start, F.col("x.shift") + F.col("x.len")).alias("campaign_end_date"),
                F.date_add(start, F.col("x.shift") + 7 * (F.col("blk") % 2)).alias("media_start_date"),
                F.date_add(start, F.col("x.shift") + F.col("x.len")).alias("media_end_date"),
                F.col("x.quoteline_sku").alias("quoteline_sku"),
                "store_list",
                (F.col("blk") % 3 + 1).cast("long").alias("quantity"),
                (1000.0 + F.col("b") * 10 + F.col("blk")).cast("double").alias("media_spend"),
            )
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        """campaign_id with its media and campaign dates; one row per booking."""
        start = F.date_add(
            F.lit(BASE_DATE).cast("date"), F.lit(CAMPAIGN_OFFSET) + (F.col("b") % 5) * 7
        )
        end = F.date_add(start, CAMPAIGN_DAYS - 1)
        return (
            self._line_skus.groupBy("b")
            .agg(F.min(F.col("blk") % 2).alias("first"))
            .select(
                F.format_string("BK%02d", F.col("b")).alias("campaign_id"),
                F.date_add(start, F.col("first") * 7).alias("media_start_date"),
                end.alias("media_end_date"),
                F.date_add(start, 0).alias("campaign_start_date"),
                F.date_add(end, 0).alias("campaign_end_date"),
            )
        )

    @cached_property
    def campaign_skus(self) -> DataFrame:
        return self._line_skus.select(
            F.format_string("BK%02d", F.col("b")).alias("campaign_id"),
            F.col("p_partkey").cast("string").alias("article"),
        )

    @cached_property
    def campaign_stores(self) -> DataFrame:
        """Test sites: a quarter of the chain carries each campaign."""
        brands = self._line_skus.select("b").distinct().withColumn("bmod", F.col("b") % 4)
        return (
            self.table("supplier")
            .select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 4).cast("int").alias("bmod"))
            .join(brands, "bmod")
            .select(F.format_string("BK%02d", F.col("b")).alias("campaign_id"), "site")
        )

    @cached_property
    def compliance(self) -> DataFrame:
        """Audit rows per in-store line, store and week."""
        weeks = F.explode(
            F.array(
                F.struct(F.lit("Installation").alias("label"), F.lit(1).alias("n")),
                F.struct(F.lit("Week 2").alias("label"), F.lit(2).alias("n")),
                F.struct(F.lit("Week 3").alias("label"), F.lit(3).alias("n")),
            )
        )
        instore = (
            self.bookings.filter((F.col("kind") == "main") & (F.col("media_location") != "Digital"))
            .filter(F.col("media_location") != "None")
            .withColumn("store_id", F.explode(F.split("store_list", ",")))
            .withColumn("w", weeks)
        )
        site = F.col("store_id").cast("long")
        b = F.substring("booking_number", 3, 2).cast("long")
        return instore.select(
            F.col("booking_number").alias("campaign_id"),
            F.col("line_name").alias("quote_line"),
            "store_id",
            F.col("w.label").alias("week_number"),
            F.when((site + b + F.col("w.n")) % 3 > 0, 1).otherwise(0).alias("result"),
            F.when(site % 17 == 0, 1).otherwise(0).alias("missing_record_flag"),
        )

    @cached_property
    def stock(self) -> DataFrame:
        """Sparse hourly stock readings: article, site, soh_date, soh_hour, soh."""
        v = F.col("value")
        return (
            self._events.groupBy(
                F.col("k").cast("string").alias("article"),
                F.col("user_id").alias("site"),
                F.col("ts").cast("date").alias("soh_date"),
                F.hour("ts").alias("soh_hour"),
            )
            .agg(F.min(F.when(v < 8, 0.0).otherwise(F.floor(v).cast("double"))).alias("soh"))
        )

    @cached_property
    def site_hours(self) -> DataFrame:
        """Opening and closing times per weekday as ``HHMMSS`` strings."""
        s = F.col("s_suppkey")
        days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
        cols = [s.alias("site")]
        for i, d in enumerate(days):
            opening = F.concat(F.lpad((6 + (s + i) % 3).cast("string"), 2, "0"), F.lit("0000"))
            if i == 0:
                opening = F.when(s % 23 == 0, "").otherwise(opening)
            closing = (
                F.when((s + i) % 4 == 0, "240000").when((s + i) % 4 == 1, "213000").otherwise("220000")
            )
            cols += [opening.alias(f"{d}_open"), closing.alias(f"{d}_close")]
        return self.table("supplier").select(*cols)

    # ---- shopper side ---------------------------------------------------

    @cached_property
    def _events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        """Shopper transactions: who bought which article in which basket when."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority"
        )
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
        day = fold_date(F.col("o_orderdate"))
        return (
            self.table("lineitem")
            .join(orders, "l_orderkey")
            .join(part, "l_partkey")
            .select(
                F.when(F.col("o_orderpriority") == "1-URGENT", "Online Order")
                .otherwise("Instore Order").alias("order_context"),
                day.alias("start_txn_date"),
                (day.cast("timestamp_ntz")
                 + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).alias("start_txn_time"),
                F.col("o_custkey").cast("string").alias("shopper_id"),
                F.col("l_partkey").cast("string").alias("article"),
                F.col("p_brand").alias("brand"),
                F.col("p_type").alias("subcat"),
                F.col("l_orderkey").cast("string").alias("basket_key"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            )
        )

    @cached_property
    def hits(self) -> DataFrame:
        """Web hits with page, section, packed booking key, search term and action."""
        k, kind = F.col("k"), F.col("event_type")
        page = (
            F.when(kind == "view", "ww:shop:catalogue")
            .when(kind == "signup", "ww:homepage")
            .when(kind == "click", "ww:shop:asset")
            .when(kind == "purchase", "ww:order:confirmation")
            .otherwise("ww:other")
        )
        booking = F.format_string("BK%02d", k % 25 + 1)
        packed = F.when(
            kind == "click",
            F.when(k % 10 == 0, booking).otherwise(
                F.concat(booking, F.lit(":web:x:L"), (F.floor(k / 25) % 2).cast("string"))
            ),
        )
        return self._events.select(
            "event_id",
            F.col("user_id").cast("string").alias("visitor_id"),
            F.col("ts").alias("date_time"),
            page.alias("page_name"),
            F.when((kind == "error") & (k % 2 == 0), "Catalogue").otherwise("shop").alias("section"),
            packed.alias("packed_key"),
            F.when(kind == "purchase", "Order Confirmation Section").otherwise("Browse").alias("channel"),
            F.when(kind.isin("click", "view"), "impression").otherwise("other").alias("action"),
            F.when(k % 2 == 0, "web").otherwise("app").alias("site_platform"),
            F.when(kind.isin("click", "view"),
                   F.concat(F.lit(" term"), (k % 7).cast("string"), F.lit(" | rest"))).alias("search_term"),
        )

    @cached_property
    def id_map(self) -> DataFrame:
        """visitor -> shopper and customer, two validity windows that overlap by half a day."""
        u = F.col("user_id")

        def ts(s: str) -> Column:
            return F.lit(s).cast("timestamp_ntz")

        windows = F.array(
            F.struct(F.lit(0).alias("n"), ts("2024-01-01 00:00:00").alias("a"), ts("2024-01-16 12:00:00").alias("z")),
            F.struct(F.lit(1).alias("n"), ts("2024-01-16 00:00:00").alias("a"), ts("2024-02-01 00:00:00").alias("z")),
        )
        return (
            self.table("events").select("user_id").distinct()
            .withColumn("w", F.explode(windows))
            .select(
                u.cast("string").alias("visitor_id"),
                F.concat(F.lit("S"), (u * 10 + F.col("w.n")).cast("string")).alias("shopper_id"),
                F.when(u % 11 != 0, (u * 10 + F.col("w.n")).cast("string")).alias("crn"),
                F.col("w.a").alias("effective_time"),
                F.col("w.z").alias("expiry_time"),
            )
        )
