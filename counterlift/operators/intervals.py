"""Events against windows that share no key: every event gets the id of the set of windows open at it.

A keyless interval join repeats each event once per open window. Here the starts and ends of the
windows cut time into segments; a segment names its set of open windows, an event its segment.
Rows grow as events plus windows, and only who needs the windows themselves resolves a set.
Positions are longs and windows half-open; ``moment`` and ``after`` make them of timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 2 * 86_400_000_000  # positions of a day


def moment(ts: Column) -> Column:
    """Position of a timestamp; the position after it is free for windows that include it."""
    return F.unix_micros(ts.cast("timestamp")) * 2


def after(ts: Column) -> Column:
    """Position just after a timestamp, the end of a window that includes it."""
    return moment(ts) + 1


def _buckets(lo: str, hi: str, width: int) -> Column:
    return F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))


def segments(windows: DataFrame, keys: Sequence[str], width: int = DAY) -> tuple[DataFrame, DataFrame]:
    """(segments, members) of windows with the columns ``keys``, lo and hi.

    segments: at, set_id and n_open; from ``at`` to the next one the windows of set_id are open, n_open
    of them. Segments with the same windows share a set; with none open set_id is null. members: set_id and
    ``keys``. Empty windows and those with a null end count for nothing; equal windows count once.
    """
    keys = list(keys)
    real = windows.filter(F.col("lo") < F.col("hi")).select(*keys, "lo", "hi").distinct()
    ends = real.select(F.explode(F.array("lo", "hi")).alias("at")).distinct().withColumn("_b", F.floor(F.col("at") / width))
    unrolled = real.withColumn("_b", F.explode(_buckets("lo", "hi", width)))
    held = ends.join(unrolled, "_b").filter((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi"))).select("at", *keys)
    # the sum of the members' hashes does not depend on their order, and no list is built
    one = F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]).cast("decimal(38,0)")
    named = held.groupBy("at").agg(F.sum(one).alias("_s"), F.count("*").alias("n_open")).select("at", F.xxhash64("_s", "n_open").alias("set_id"), "n_open")
    found = ends.select("at").join(named, "at", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    first = named.groupBy("set_id").agg(F.min("at").alias("at"))
    return found, held.join(first, "at").select("set_id", *keys)


def with_open_set(events: DataFrame, position: Column, cuts: DataFrame, width: int = DAY, salts: int | None = None) -> DataFrame:
    """``events`` with at, set_id and n_open of the segment that holds their position.

    Events and cuts of a bucket of time are one ordered stream; what is open when a bucket begins is
    carried over from the buckets before it, one row each. A bucket's events are dealt to ``salts``
    streams, which each hold the bucket's cuts, so a busy day is spread over tasks. Events before the first
    or in a bucket after the last cut, and those without a position, have no set and 0 open windows.
    """
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = events.withColumn("_p", position).withColumn("_b", F.floor(F.col("_p") / width))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(salts)).cast("int"))
    cuts = cuts.select("at", "set_id", "n_open").withColumn("_b", F.floor(F.col("at") / width))
    last = cuts.groupBy("_b").agg(F.max(F.struct("at", "set_id", "n_open")).alias("_last"))
    # after the last cut nothing is open, so the buckets between the first and the last cut are enough
    span = last.agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).filter("lo IS NOT NULL")
    buckets = span.select(F.explode(F.sequence("lo", "hi")).alias("_b")).join(last, "_b", "left")
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket of time
    carried = buckets.select("_b", F.last("_last", ignorenulls=True).over(before).alias("_c")).filter("_c IS NOT NULL")
    begin = carried.select("_b", F.col("_b") * width - 1, F.col("_c"))
    marks = begin.toDF("_b", "_p", "_cut").unionByName(cuts.select("_b", F.col("at").alias("_p"), F.struct("at", "set_id", "n_open").alias("_cut")))
    marks = marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_event", F.lit(False))
    stream = placed.withColumn("_event", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    so_far = W.partitionBy("_b", "_salt").orderBy("_p", "_event").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = stream.withColumn("_now", F.last("_cut", ignorenulls=True).over(so_far)).filter("_event")
    known = F.col("_p").isNotNull()
    return seen.select(
        *events.columns, F.when(known, F.col("_now.at")).alias("at"), F.when(known, F.col("_now.set_id")).alias("set_id"),
        F.when(known, F.coalesce("_now.n_open", F.lit(0))).otherwise(0).cast("long").alias("n_open"),
    )
