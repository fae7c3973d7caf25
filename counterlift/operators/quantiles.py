"""Exact quantiles of groups of any size, and codes of categories.

A group whose values fit one task is sorted there. A larger one is narrowed in rounds: its values
fall into buckets between splitters taken from a sketch, the buckets are counted exactly, and only
the buckets that hold a wanted order statistic go on, until they hold one value or few. No task
ever holds a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.session import cut_lineage

FEW = 100_000  # values that one task may sort
SPLITTERS = 31


def order_statistics(df: DataFrame, by: Sequence[str], col: str, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """``wanted`` (by, k) with value, the k-th smallest known value of the group, counted from 0.

    The group columns must not be null; ranks beyond a group's size have no row.
    """
    by = list(by)
    rows = df.filter(F.col(col).isNotNull()).select(*by, F.lit("").alias("_iv"), F.col(col).cast("double").alias("_x"))
    rows = cut_lineage(rows.join(wanted.select(*by).distinct(), by, "left_semi"))
    ask = cut_lineage(wanted.select(*by, "k", F.lit("").alias("_iv"), F.col("k").alias("_left")))
    found: DataFrame | None = None
    key = [*by, "_iv"]
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        state = cut_lineage(ask.join(sizes, key).filter(F.col("_left") < F.col("_n")))
        done = state.filter(F.col("_lo") == F.col("_hi")).select(*by, "k", F.col("_lo").alias("value"))
        small = state.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= few))
        held = rows.join(small.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list("_x")).alias("_v"))
        sorted_out = small.join(held, key).select(*by, "k", F.get("_v", F.col("_left").cast("int")).alias("value"))
        part = done.unionByName(sorted_out)
        found = part if found is None else found.unionByName(part)
        large = state.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > few))
        if large.isEmpty():
            return found
        inside = rows.join(large.select(*key).distinct(), key, "left_semi")
        splits = [(i + 1) / (SPLITTERS + 1) for i in range(SPLITTERS)]
        at = inside.groupBy(*key).agg(F.array_distinct(F.percentile_approx("_x", splits, 10_000)).alias("_at"))
        # a splitter's own value is a bucket by itself, so every round makes progress
        bucket = F.size(F.filter("_at", lambda s: s < F.col("_x"))) * 2 + F.array_contains("_at", F.col("_x")).cast("int")
        dealt = cut_lineage(inside.join(at, key).select(*key, "_x", bucket.alias("_c")))
        before = W.partitionBy(*key).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)  # at most 63 rows
        counts = dealt.groupBy(*key, "_c").agg(F.count("*").alias("_m")).withColumn("_below", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        hit = large.select(*key, "k", "_left").join(counts, key).filter((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_m")))
        deeper = F.concat_ws("/", "_iv", F.col("_c").cast("string"))
        hit = cut_lineage(hit.select(*by, "k", deeper.alias("_new"), (F.col("_left") - F.col("_below")).alias("_left")))
        ask = hit.withColumnRenamed("_new", "_iv")
        rows = cut_lineage(dealt.select(*by, deeper.alias("_iv"), "_x").join(ask.select(*key).distinct(), key, "left_semi"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probabilities: Sequence[float], few: int = FEW) -> DataFrame:
    """``by`` and q, the group's quantiles in the order given, interpolated between neighbours.

    Null values, groups without a known value and rows with a null in ``by`` are left out; with no
    ``by`` the frame is one group.
    """
    by = list(by)
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], col, probabilities, few).drop("_all")
    known = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias(col))
    sizes = cut_lineage(known.groupBy(*by).agg(F.count("*").alias("_n")))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    few_rows = known.join(sizes.filter(F.col("_n") <= few).drop("_n"), by, "left_semi")
    out = few_rows.groupBy(*by).agg(F.percentile(col, wanted).alias("q"))
    many = sizes.filter(F.col("_n") > few)
    if many.isEmpty():
        return out
    place = many.select(*by, F.posexplode(F.transform(wanted, lambda p: p * (F.col("_n") - 1))).alias("_i", "_at"))
    ends = place.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    ks = ends.select(*by, F.explode(F.array("_lo", "_hi")).alias("k")).distinct()
    values = cut_lineage(order_statistics(known, by, col, ks, few))

    def side(name: str) -> DataFrame:
        return values.select(*by, F.col("k").alias(name), F.col("value").alias(f"_v{name}"))

    met = ends.join(side("_lo"), [*by, "_lo"]).join(side("_hi"), [*by, "_hi"])
    value = F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * (F.col("_at") - F.col("_lo"))
    lists = met.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_q"))  # as many as probabilities
    return out.unionByName(lists.select(*by, F.transform("_q", lambda s: s["v"]).alias("q")))


def category_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """``df`` with the dense rank from 0 of a column's value among its distinct values; null is -1.

    Distinct values are dealt to ranges and numbered inside each; ranges are shifted by the sizes of
    those before, so no task sees all values.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.filter(F.col(col).isNotNull()).select(col).distinct()
    # written at once: the number of a range must not change when a task is repeated
    ranged = cut_lineage(values.repartitionByRange(parts, col).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    shift = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(col)) - 1
    codes = ranged.withColumn("_in", inside).join(shift, "_part").select(F.col(col).alias("_value"), (F.col("_in") + F.col("_shift")).cast("long").alias(name))
    return df.join(codes, F.col(col) == F.col("_value"), "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(-1)))


def number_pair(label: str, pattern: str = r"(\d+\.?\d*)_(\d+\.?\d*)") -> tuple[Column, Column]:
    """Two whole numbers of a label such as ``101.0_202.0``; null where it has no such pair."""
    return tuple(F.regexp_extract(label, pattern, i).try_cast("double").cast("long") for i in (1, 2))


def quantile_list(df: DataFrame, by: Sequence[str], col: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """``by`` and one column per named quantile."""
    q = exact_quantiles(df, by, col, list(named.values()), few)
    return q.select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(named)])

