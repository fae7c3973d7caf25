"""One-to-one matching over whole campaigns without listing their pairs.

Stores are points: mean and deviation of the weekly sales, or the unit vector of a sales series.
An edge that is the lightest at both of its ends is what a scan of all pairs by weight would
take, whatever happens elsewhere. So each round looks up the nearest free partner of every free
store, takes the mutual ones and goes on with the rest. A campaign whose free stores make few
enough pairs is finished in one task.

The nearest partner is exact. By mean and deviation, points are put into cells whose bounds give the
least distance of their points; a query is measured in the closest cell and in those that may still
hold a nearer point. By correlation, blocks of both sides are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import safe_divide
from counterlift.operators.matching import distance
from counterlift.operators.store_sales import K, with_cohort
from counterlift.session import cut_lineage

FINISH_PAIRS = 1 << 20  # free pairs of a campaign that one task may finish: 8 MB of distances
CELL_POINTS = 4096  # points of a cell of the search by mean and deviation
CELL_TILE = 1 << 20  # distances that a task holds at once
BLOCK = 1 << 15  # series of each side that one task of the search by correlation measures

Nearest = Callable[[DataFrame, DataFrame, bool], DataFrame]
MATCHED = f"{K} string, test_store long, control_store long, weight double"


# --- nearest by mean and deviation -------------------------------------------------------------------


def _ratio_bounds(query: str, low: Column, high: Column, query_is_test: bool) -> tuple[Column, Column]:
    """Least and largest ``|test / control - 1|`` over the points between ``low`` and ``high``.

    Division rounds the same way everywhere, so the bounds hold for the rounded distances too.
    """
    a, b = (safe_divide(query, low), safe_divide(query, high)) if query_is_test else (safe_divide(low, query), safe_divide(high, query))
    inside = (F.least(a, b) <= 1) & (F.greatest(a, b) >= 1)
    least = F.when(inside, F.lit(0.0)).otherwise(F.least(F.abs(a - 1), F.abs(b - 1)))
    return least, F.greatest(F.abs(a - 1), F.abs(b - 1))


def _splits(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)] or [0.5]


def _slot(x: str, cuts: str, parts: int) -> Column:
    """Number of the quantile range that ``x`` lies in."""
    return F.size(F.filter(cuts, lambda c: c < F.col(x))).cast("long") if parts > 1 else F.lit(0).cast("long")


def _in_cells(places: DataFrame, parts: int) -> DataFrame:
    """``places`` with strip (signs and range of pm) and cell (range of ps inside the strip); quantiles even out both."""
    strips = places.groupBy(K).agg(F.percentile_approx("pm", _splits(parts)).alias("cuts"))
    sign = (F.signum("pm") + 1) * 3 + F.signum("ps") + 1
    keyed = places.join(strips, K).withColumn("strip", _slot("pm", "cuts", parts) * 9 + sign.cast("long")).drop("cuts")
    cells = keyed.groupBy(K, "strip").agg(F.percentile_approx("ps", _splits(parts)).alias("cuts"))
    return keyed.join(cells, [K, "strip"]).withColumn("cell", _slot("ps", "cuts", parts)).drop("cuts")


def _boxes(keyed: DataFrame, up: Sequence[str], name: str) -> DataFrame:
    """One list per campaign and ``up`` of the bounds of its strips or cells."""
    sides = [F.min("pm").alias("m0"), F.max("pm").alias("m1"), F.min("ps").alias("s0"), F.max("ps").alias("s1")]
    part = F.struct(F.col(name).alias("c"), "m0", "m1", "s0", "s1")
    return cut_lineage(keyed.groupBy(K, *up, name).agg(*sides).groupBy(K, *up).agg(F.collect_list(part).alias("parts")))


def _nearest_in_cell(query_is_test: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or places.empty:
            return pd.DataFrame(columns=[K, "m", "s", "d", "id", "pm", "ps", "n_places"])
        places = places.sort_values("id")  # the first of equal distances has the smallest id
        pm, ps = (places[c].to_numpy(float)[None, :] for c in ("pm", "ps"))
        m, s = (asked[c].to_numpy(float)[:, None] for c in ("m", "s"))
        step = max(1, CELL_TILE // len(places))
        found = []
        with np.errstate(all="ignore"):
            for i in range(0, len(asked), step):
                a, b = m[i:i + step], s[i:i + step]
                d = np.abs(a / pm - 1) + np.abs(b / ps - 1) if query_is_test else np.abs(pm / a - 1) + np.abs(ps / b - 1)
                at = d.argmin(1)
                least = d[np.arange(len(d)), at]
                found.append((least, at, (d == least[:, None]).sum(1)))
        d, at, n = (np.concatenate(c) for c in zip(*found, strict=True))
        best = places[["id", "pm", "ps"]].iloc[at].reset_index(drop=True)
        return pd.concat([asked[[K, "m", "s"]].reset_index(drop=True), best], axis=1).assign(d=d, n_places=n)[[K, "m", "s", "d", "id", "pm", "ps", "n_places"]]

    return run


def nearest_by_moments(queries: DataFrame, points: DataFrame, query_is_test: bool) -> DataFrame:
    """Nearest point of every query by the distance of mean and deviation.

    Both frames have campaign_id, id, m and s; campaign_id and the pair (m, s) name a query, so equal
    queries are searched once. Returns campaign_id, m, s, d, the smallest id at that distance, its
    coordinates (pm, ps) and n_places, the number of different coordinates at that distance.

    Quantiles cut a campaign's points into strips and those into cells of about ``CELL_POINTS``. A query is measured in the
    cell that lies closest, then in those whose bound does not exceed what it found there, which few do.
    """
    places = cut_lineage(points.groupBy(K, F.col("m").alias("pm"), F.col("s").alias("ps")).agg(F.min("id").alias("id")))
    n, total = places.groupBy(K).count().agg(F.max("count"), F.sum("count")).first()
    parts = int(np.ceil(np.sqrt((n or 1) / CELL_POINTS)))
    tasks = max(8, 3 * (total or 0) // CELL_POINTS)
    keyed = cut_lineage(_in_cells(places, parts))
    strips, cells = _boxes(keyed, [], "strip"), _boxes(keyed, ["strip"], "cell")

    def bounds(cell: Column) -> Column:
        (least_m, most_m), (least_s, most_s) = (_ratio_bounds(q, cell[f"{q}0"], cell[f"{q}1"], query_is_test) for q in "ms")
        return F.struct((least_m + least_s).alias("least"), (most_m + most_s).alias("most"), cell["c"].alias("c"))

    def measured(asked: DataFrame) -> DataFrame:
        # both sides are spread by number: their few bytes would be read by a single task
        sides = [side.repartition(tasks, K, "strip", "cell").groupBy(K, "strip", "cell") for side in (asked, keyed)]
        return sides[0].cogroup(sides[1]).applyInPandas(_nearest_in_cell(query_is_test), f"{K} string, m double, s double, d double, id long, pm double, ps double, n_places long")

    one = [K, "m", "s"]
    closest = F.array_min(F.transform("parts", bounds))["c"]
    near = queries.select(*one).distinct().join(strips, K).select(*one, closest.alias("strip"))
    home = near.join(cells, [K, "strip"]).select(*one, "strip", closest.alias("cell"))
    first = cut_lineage(measured(home))
    reached = F.transform(F.filter(F.transform("parts", bounds), lambda p: p["least"] <= F.col("d")), lambda p: p["c"])
    wide = first.select(*one, "d").join(strips, K).select(*one, "d", F.explode(reached).alias("strip"))
    all_cells = wide.join(cells, [K, "strip"]).select(*one, "strip", F.explode(reached).alias("cell"))
    more = measured(all_cells.join(home, [*one, "strip", "cell"], "left_anti"))
    found = F.struct("d", "id", "pm", "ps", "n_places")
    best = first.unionByName(more).groupBy(*one).agg(F.collect_list(found).alias("found")).withColumn("b", F.array_min("found"))
    same = F.filter("found", lambda x: x["d"] == F.col("b.d"))
    places_at = F.aggregate(same, F.lit(0).cast("long"), lambda c, x: c + x["n_places"])
    return best.select(*one, "b.d", "b.id", "b.pm", "b.ps", places_at.alias("n_places"))


# --- nearest by correlation ---------------------------------------------------------------------------


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``1 - correlation`` of rows to nine digits, summed from left to right, the same from both sides."""
    dot = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
    return np.round(1 - dot, 9)


def _nearest_in_block(asked: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    if asked.empty or places.empty:
        return pd.DataFrame(columns=[K, "q", "d", "id", "n_places"])
    places = places.sort_values("id")
    v, pv, ids = np.stack(asked["v"].to_list()), np.stack(places["pv"].to_list()), places["id"].to_numpy()
    step = max(1, CELL_TILE // len(places))
    found = []
    for i in range(0, len(asked), step):
        dot = v[i:i + step] @ pv.T
        row, at = np.nonzero(dot >= dot.max(1, keepdims=True) - 2e-9)  # all that may be nearest to nine digits
        d = _unlike(v[i:i + step][row], pv[at])
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(d, starts)
        ties = d == np.repeat(least, np.diff(np.append(starts, len(row))))
        first = np.minimum.reduceat(np.where(ties, at, len(ids)), starts)
        found.append((least, ids[first], np.add.reduceat(ties.astype(np.int64), starts)))
    d, at, n = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({K: asked[K].to_numpy(), "q": asked["q"].to_numpy(), "d": d, "id": at, "n_places": n})


def nearest_by_correlation(queries: DataFrame, points: DataFrame, query_is_test: bool, block: int = BLOCK) -> DataFrame:
    """Nearest unit vector of every query: blocks of queries meet blocks of points, and each task multiplies two blocks.

    Both frames have campaign_id, id and v. A vector is copied once per block of the other side, not once per
    partner, and a block returns one row per query; a task holds two blocks and a tile of their products. Pairs
    are still all measured. Result as ``nearest_by_moments``, with v and pv in place of the coordinates.
    """
    places = cut_lineage(points.groupBy(K, F.col("v").alias("pv")).agg(F.min("id").alias("id")))
    asked = cut_lineage(queries.groupBy(K, "v").agg(F.min("id").alias("q")))
    sizes = asked.groupBy(K).agg(F.ceil(F.count("*") / block).alias("nq")).join(places.groupBy(K).agg(F.ceil(F.count("*") / block).alias("np")), K)
    tasks = int(min(4096, max(8, sizes.agg(F.sum(F.col("nq") * F.col("np"))).first()[0] or 0)))

    def blocked(side: DataFrame, own: str, n: str, other: str, n_other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))
        met = side.join(sizes, K).withColumn(own, F.pmod(F.xxhash64(side.columns[-1]), F.col(n)))
        return met.withColumn(other, every).drop("nq", "np").repartition(tasks, K, "bq", "bp")

    keys = [K, "bq", "bp"]
    left, right = blocked(asked, "bq", "nq", "bp", "np").groupBy(*keys), blocked(places, "bp", "np", "bq", "nq").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(_nearest_in_block, f"{K} string, q long, d double, id long, n_places long")
    best = found.groupBy(K, "q").agg(F.collect_list(F.struct("d", "id", "n_places")).alias("found")).withColumn("b", F.array_min("found"))
    same = F.filter("found", lambda x: x["d"] == F.col("b.d"))
    places_at = F.aggregate(same, F.lit(0).cast("long"), lambda c, x: c + x["n_places"])
    named = best.select(K, "q", "b.d", "b.id", places_at.alias("n_places"))
    return named.join(asked, [K, "q"]).join(places, [K, "id"]).select(K, "v", "d", "id", "pv", "n_places")


# --- rounds ----------------------------------------------------------------------------------------------


def _take_in_order(weights: np.ndarray, tests: np.ndarray, controls: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs of a small campaign by weight, then test, then control, while both are free; NaN is no pair."""
    if not weights.size:
        return []
    order = np.argsort(weights, axis=None, kind="stable")
    free_t, free_c = np.ones(len(tests), bool), np.ones(len(controls), bool)
    out = []
    for at in order.tolist():
        i, j = divmod(at, len(controls))
        if np.isnan(weights[i, j]) or len(out) == min(len(tests), len(controls)):
            break
        if free_t[i] and free_c[j]:
            free_t[i] = free_c[j] = False
            out.append((int(tests[i]), int(controls[j]), float(weights[i, j])))
    return out


def _finish(weigh: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]):
    def run(key: tuple, stores: pd.DataFrame) -> pd.DataFrame:
        stores = stores.sort_values("id")
        t, c = stores[stores["is_test"]], stores[~stores["is_test"]]
        rows = _take_in_order(weigh(t, c), t["id"].to_numpy(), c["id"].to_numpy()) if len(t) and len(c) else []
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[K, "test_store", "control_store", "weight"])

    return run


def match_in_rounds(stores: DataFrame, place: Sequence[str], nearest: Nearest, weigh, finish_pairs: int = FINISH_PAIRS) -> DataFrame:
    """campaign_id, test_store, control_store and weight of the pairs that a scan of all pairs by weight takes.

    ``stores`` has campaign_id, id, is_test and the columns ``place``; ``nearest`` is one of the
    searches above, ``weigh`` gives the weights of a small campaign's tests x controls. Rounds go on
    as long as a campaign has more than ``finish_pairs`` free pairs; their number follows the longest
    chain of dependent choices. Stores of the same place whose mutual nearest place has no rival
    are paired in the order of their ids at once.
    """
    place = list(place)
    other = [f"p{c}" for c in place]
    free = cut_lineage(stores.select(K, "id", "is_test", *place))
    taken: DataFrame | None = None
    while True:
        sizes = free.groupBy(K).agg((F.count_if("is_test") * F.count_if(~F.col("is_test"))).alias("pairs"))
        big = cut_lineage(sizes.filter(F.col("pairs") > finish_pairs).select(K))
        if big.isEmpty():
            break
        now = free.join(big, K, "left_semi")
        tests, controls = now.filter("is_test").drop("is_test"), now.filter(~F.col("is_test")).drop("is_test")
        by_test = nearest(tests, controls, True)
        by_control = nearest(controls, tests, False)
        swapped = by_control.select(K, *[F.col(c).alias(o) for c, o in zip(place, other, strict=True)], *[F.col(o).alias(c) for c, o in zip(place, other, strict=True)],
                                    F.col("id").alias("test_id"), F.col("n_places").alias("rivals"))
        mutual = by_test.join(swapped, [K, *place, *other]).withColumn("all", (F.col("n_places") == 1) & (F.col("rivals") == 1)).select(K, *place, *other, "d", "all")
        mutual = cut_lineage(mutual)
        rank = F.row_number().over(W.partitionBy(K, *place).orderBy("id"))
        left = tests.join(mutual, [K, *place]).withColumn("n", rank).select(K, *other, "n", "d", "all", F.col("id").alias("test_store"))
        named = mutual.select(K, *other).join(controls.select(K, *[F.col(c).alias(o) for c, o in zip(place, other, strict=True)], "id"), [K, *other])
        right = named.withColumn("n", F.row_number().over(W.partitionBy(K, *other).orderBy("id"))).withColumnRenamed("id", "control_store")
        chosen = cut_lineage(left.join(right, [K, *other, "n"]).filter(F.col("all") | (F.col("n") == 1)).select(K, "test_store", "control_store", F.col("d").alias("weight")))
        if chosen.isEmpty():  # no pair of these campaigns has a weight
            free = cut_lineage(free.join(big, K, "left_anti"))
            continue
        taken = chosen if taken is None else taken.unionByName(chosen)
        used = chosen.select(K, F.col("test_store").alias("id"), F.lit(True).alias("is_test")).unionByName(
            chosen.select(K, F.col("control_store").alias("id"), F.lit(False).alias("is_test")))
        free = cut_lineage(free.join(used, [K, "id", "is_test"], "left_anti"))
    last = free.groupBy(K).applyInPandas(_finish(weigh), MATCHED)
    return last if taken is None else taken.unionByName(last)


def _weigh_moments(t: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    a, b = (t[x].to_numpy(float)[:, None] for x in "ms")
    p, q = (c[x].to_numpy(float)[None, :] for x in "ms")
    return np.abs(a / p - 1) + np.abs(b / q - 1)


def _moment_places(features: DataFrame) -> DataFrame:
    is_test = F.col("test_or_control") == "Test"
    known = F.col("mean").isNotNull() & F.col("std").isNotNull() & (is_test | ((F.col("mean") != 0) & (F.col("std") != 0)))
    return features.filter(known).select(K, F.col("site").cast("long").alias("id"), is_test.alias("is_test"), F.col("mean").cast("double").alias("m"), F.col("std").cast("double").alias("s"))


def nearest_control_of_all(features: DataFrame) -> DataFrame:
    """Best control of every test store of a campaign, whatever lies between them; ties go to the lower id.

    Stores with an unknown mean or deviation and controls where one is zero have no distance.
    """
    stores = cut_lineage(_moment_places(features))
    tests, controls = stores.filter("is_test"), stores.filter(~F.col("is_test"))
    found = nearest_by_moments(tests, controls, True).withColumnRenamed("id", "control_store")
    return tests.join(found, [K, "m", "s"]).select(K, F.col("id").alias("test_store"), "control_store", F.col("d").alias("abs_perc_diff"))


def match_campaigns(features: DataFrame, finish_pairs: int = FINISH_PAIRS) -> DataFrame:
    """One-to-one pairs of whole campaigns by increasing distance, then test, then control.

    Equals a scan over all test x control pairs of a campaign sorted by distance.
    """
    pairs = match_in_rounds(_moment_places(features), ["m", "s"], nearest_by_moments, _weigh_moments, finish_pairs)
    return pairs.withColumnRenamed("weight", "abs_perc_diff")


def unit_series(weekly: DataFrame) -> DataFrame:
    """campaign_id, site and v, the weekly sales of a store relative to their mean and scaled to length one.

    Weeks of the campaign without sales count as zero; a store whose sales never change has no row.
    The series of a store is as long as the weeks of the campaign's history.
    """
    weeks = weekly.select(K, "sales_week").distinct().groupBy(K).agg(F.array_sort(F.collect_set("sales_week")).alias("weeks"))
    point = F.struct(F.col("sales_week").alias("d"), F.col("sales_amount").cast("double").alias("v"))
    per_store = weekly.groupBy(K, "site").agg(F.map_from_entries(F.collect_list(point)).alias("by_week")).join(weeks, K)
    series = per_store.select(K, "site", F.transform("weeks", lambda d: F.coalesce(F.try_element_at("by_week", d), F.lit(0.0))).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    centred = series.withColumn("mean", mean).withColumn("v", F.transform("v", lambda x: x - F.col("mean"))).drop("mean")
    scaled = centred.withColumn("norm", F.sqrt(_dot("v", "v"))).filter("norm > 0")
    return scaled.select(K, "site", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _weigh_series(t: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    return np.round(1 - np.stack(t["v"].to_list()) @ np.stack(c["v"].to_list()).T, 9)


def match_on_correlation(weekly: DataFrame, stores: DataFrame, finish_pairs: int = FINISH_PAIRS) -> DataFrame:
    """One-to-one pairs of whole campaigns by decreasing correlation of the weekly sales, then test, then control."""
    series = with_cohort(unit_series(weekly), stores)
    places = series.select(K, F.col("site").cast("long").alias("id"), (F.col("test_or_control") == "Test").alias("is_test"), "v")
    pairs = match_in_rounds(places, ["v"], nearest_by_correlation, _weigh_series, finish_pairs)
    return pairs.select(K, "test_store", "control_store", F.round(1 - F.col("weight"), 9).alias("corr"))
