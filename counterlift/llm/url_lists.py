"""URL filtering against dated lists: validity intervals and an as-of join at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterlift.llm.registry import query, table

LAST_DAY = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and leading ``www.``; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, at least ``/``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(F.length(path) == 0, F.lit("/")).otherwise(path)


def match_keys(url: Column) -> Column:
    """Every list key that covers a URL: its host, all parent domains of two labels or more,
    and the host with each leading part of its path that ends at a slash."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(
        n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))
    ).otherwise(F.array(host))
    parts = F.split(path_of(url), "/")
    deep = F.size(parts)
    prefixes = F.when(
        deep >= 3, F.transform(F.sequence(F.lit(1), deep - 2), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list_name, key, valid_from, valid_to (exclusive) from dated ``add``/``remove`` entries.

    Entries of a list and key are read in date order; an add opens an interval unless one is
    open, a remove closes it. With several entries on one day a remove wins. Entries with a
    null list, key, date or another action count for nothing.
    """
    clean = entries.filter(
        F.col("list_name").isNotNull() & F.col("key").isNotNull() & F.col("entry_date").isNotNull() & F.col("action").isin("add", "remove")
    )
    days = clean.groupBy("list_name", "key", "entry_date").agg(F.max((F.col("action") == "remove").cast("int")).alias("off"))
    by = Window.partitionBy("list_name", "key").orderBy("entry_date")
    changes = days.withColumn("before", F.lag("off", 1, 1).over(by)).filter(F.col("off") != F.col("before"))
    closed = changes.withColumn("valid_to", F.coalesce(F.lead("entry_date").over(by), F.lit(LAST_DAY).cast("date")))
    return closed.filter("off = 0").select("list_name", "key", F.col("entry_date").alias("valid_from"), "valid_to")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture row: page_id, fetched, n_active (list entries active at fetch time that cover
    the URL), n_lists, first_match (smallest list:key) and blocked.

    ``captures`` has page_id, url and fetched (date); ``entries`` list_name, key, action and
    entry_date. Intervals are unrolled to the months they touch, up to the last capture, so the
    join is an equality on key and month and a hot host is split by month; the date test decides.
    A null or malformed URL and a null fetch date match nothing. Repeated captures stay; equal
    (url, fetched) pairs are evaluated once. Other columns are ignored.
    """
    shots = captures.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched"))
    span = shots.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi"))
    intervals = validity_intervals(entries).crossJoin(F.broadcast(span)).filter("valid_from <= hi AND valid_to > lo")
    months = F.sequence(F.trunc(F.greatest("valid_from", "lo"), "month"), F.trunc(F.least("valid_to", "hi"), "month"), F.expr("interval 1 month"))
    active = intervals.withColumn("month", F.explode(months)).select("list_name", "key", "valid_from", "valid_to", "month")
    distinct = shots.filter("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    keyed = distinct.select("url", "fetched", F.trunc("fetched", "month").alias("month"), F.explode(match_keys(F.col("url"))).alias("key"))
    hits = keyed.join(active, ["key", "month"]).filter("fetched >= valid_from AND fetched < valid_to")
    verdict = hits.groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), F.count_distinct("list_name").alias("n_lists"), F.min(F.concat_ws(":", "list_name", "key")).alias("first_match")
    )
    return shots.join(verdict, ["url", "fetched"], "left").select(
        "page_id", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"), "first_match", F.col("n_active").isNotNull().alias("blocked"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures; the supplied table has no fetch date, so one is derived from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Three dated lists over the hosts and first path parts of the pages (the supplied tables hold none).

    Dates and choice follow from the md5 of the key, so that lists add, remove and add again.
    """
    host = host_of(F.col("url"))
    section = F.regexp_extract(path_of(F.col("url")), r"^(/[^/]+/)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    keys = pages.select(F.explode(F.array(
        F.struct(F.lit("hosts").alias("list_name"), host.alias("key")),
        F.struct(F.lit("domains").alias("list_name"), domain.alias("key")),
        F.struct(F.lit("sections").alias("list_name"), F.when(F.length(section) > 0, F.concat(host, section)).alias("key")),
    )).alias("e")).select("e.*").filter("key IS NOT NULL AND key <> ''").distinct()
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", "list_name", "key").cast("binary")), 1, 7), 16, 10).cast("long")
    day = lambda k, m: F.date_add(F.lit("2023-11-01").cast("date"), (k + seed % m).cast("int"))
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(0, 200).alias("entry_date")),
        F.struct(F.lit("remove").alias("action"), day(60, 290).alias("entry_date")),
        F.struct(F.lit("add").alias("action"), day(250, 170).alias("entry_date")),
    )
    return keys.filter(seed % 3 != 0).select("list_name", "key", F.explode(rows).alias("r")).select("list_name", "key", "r.*")


_ORACLE = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS path
  FROM pages
), k AS (
  SELECT DISTINCT * FROM (
    SELECT 'hosts' AS list_name, host AS key FROM p
    UNION ALL SELECT 'domains', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM p
    UNION ALL SELECT 'sections', host || regexp_extract(path, '^(/[^/]+/)', 1) FROM p WHERE regexp_extract(path, '^(/[^/]+/)', 1) <> ''
  ) WHERE key IS NOT NULL AND key <> ''
), s AS (SELECT list_name, key, CAST('0x' || md5(list_name || '|' || key)[1:7] AS BIGINT) AS seed FROM k), e AS (
  SELECT list_name, key, seed, DATE '2023-11-01' + CAST(seed % 200 AS INTEGER) AS d, 0 AS off FROM s WHERE seed % 3 <> 0
  UNION ALL SELECT list_name, key, seed, DATE '2023-11-01' + CAST(60 + seed % 290 AS INTEGER), 1 FROM s WHERE seed % 3 <> 0
  UNION ALL SELECT list_name, key, seed, DATE '2023-11-01' + CAST(250 + seed % 170 AS INTEGER), 0 FROM s WHERE seed % 3 <> 0
), x AS (
  SELECT list_name, key, d, max(off) AS off FROM e GROUP BY ALL
), m AS (
  SELECT p.page_id, p.fetched, x.list_name, x.key, arg_max(x.off, x.d) AS off
  FROM p JOIN x ON x.d <= p.fetched AND p.host <> '' AND (
    p.host = x.key OR (x.key LIKE '%.%' AND x.key NOT LIKE '%/%' AND suffix(p.host, '.' || x.key))
    OR (x.key LIKE '%/' AND starts_with(p.host || p.path, x.key)))
  GROUP BY ALL
), a AS (
  SELECT page_id, fetched, count(*) AS n_active, count(DISTINCT list_name) AS n_lists, min(list_name || ':' || key) AS first_match
  FROM m WHERE off = 0 GROUP BY ALL
)
SELECT p.page_id, p.fetched, coalesce(a.n_active, 0)::BIGINT AS n_active, coalesce(a.n_lists, 0)::BIGINT AS n_lists,
  a.first_match, a.n_active IS NOT NULL AS blocked
FROM p LEFT JOIN a ON a.page_id = p.page_id
"""


@query("op6_url_lists", _ORACLE)
def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(captures_of(pages), entries_of(pages))
