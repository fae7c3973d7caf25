"""Purchase history, features, sampling and matching of shoppers."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlift.functions import random_key, safe_divide, week_diff_sunday
from counterlift.operators.design import bucketed_row_number
from counterlift.session import cut_lineage

FEATURES = [
    "total_orders_brand", "spend_brand", "avg_days_between_brand", "avg_spend_per_order_brand",
    "total_orders_sku", "spend_sku", "avg_days_between_sku", "avg_spend_per_order_sku",
]
KEY = ["booking_id", "cohort", "crn"]


def purchase_frequency(cohorts: DataFrame, txns: DataFrame, sets: DataFrame, level: str = "sku", brands: DataFrame | None = None) -> DataFrame:
    """Orders with campaign SKUs (or brands) per shopper, with gaps and running means.

    By SKU orders up to the campaign end count, by brand those before its start.
    The running means include all orders of the same date.
    """
    people = cohorts.select(
        "booking_id", "campaign_start_date", "campaign_end_date", "cohort", "crn"
    ).distinct()
    item = "article" if level == "sku" else "brand"
    if level == "sku":
        members = sets.filter(F.col("article") != "").select("booking_id", "article").distinct()
    else:
        members = sets.join(brands.select("article", "brand"), "article").select("booking_id", "brand").distinct()
    bought = txns.join(members, item).join(people.withColumnRenamed("crn", "shopper_id"), ["booking_id", "shopper_id"])
    if level == "sku":
        bought = bought.filter(F.col("start_txn_date") <= F.col("campaign_end_date"))
    else:
        bought = bought.filter(F.col("start_txn_date") < F.col("campaign_start_date"))
    orders = bought.groupBy(
        "booking_id", "campaign_start_date", "campaign_end_date", "cohort", F.col("shopper_id").alias("crn"),
        "start_txn_date", "basket_key", "order_context",
    ).agg(F.count_distinct("article").alias("n_articles"), F.sum("amount").alias("spend"))
    in_order = W.partitionBy(*KEY).orderBy("start_txn_date", "basket_key")
    so_far = W.partitionBy(*KEY).orderBy("start_txn_date").rangeBetween(W.unboundedPreceding, W.currentRow)
    return (
        orders.withColumn("previous_txn_date", F.lag("start_txn_date").over(in_order))
        .withColumn("days_since_last_order", F.datediff("start_txn_date", "previous_txn_date"))
        .withColumns(
            {
                "rolling_avg_days": F.avg("days_since_last_order").over(so_far),
                "rolling_avg_spend": F.avg("spend").over(so_far),
            }
        )
    )


def shopper_summary(sku: DataFrame, brand: DataFrame) -> DataFrame:
    """First and last order, orders, spend and latest running means, brand and SKU level."""
    def summary(freq: DataFrame, level: str) -> DataFrame:
        last = F.struct("start_txn_date", "basket_key")
        return (
            freq.filter(F.col("start_txn_date") < F.col("campaign_start_date"))
            .groupBy("booking_id", "campaign_start_date", "campaign_end_date", "cohort", "crn")
            .agg(
                F.min("start_txn_date").alias(f"earliest_order_{level}"),
                F.max("start_txn_date").alias(f"latest_order_{level}"),
                F.count_distinct("basket_key").alias(f"total_orders_{level}"),
                F.sum("spend").alias(f"spend_{level}"),
                F.max_by("rolling_avg_days", last).alias(f"avg_days_between_{level}"),
                F.max_by("rolling_avg_spend", last).alias(f"avg_spend_per_order_{level}"),
            )
        )

    keys = ["booking_id", "campaign_start_date", "campaign_end_date", "cohort", "crn"]
    return summary(brand, "brand").join(summary(sku, "sku"), keys, "left")


def never_buyers(cohorts: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows without history for shoppers that never bought the brand before."""
    keys = ["booking_id", "campaign_start_date", "campaign_end_date", "cohort", "crn"]
    absent = cohorts.select(*keys).distinct().join(summary.select("booking_id", "crn"), ["booking_id", "crn"], "left_anti")
    types = dict(summary.dtypes)
    return absent.withColumns({c: F.lit(None).cast(types[c]) for c in summary.columns if c not in keys})


def exposure_plus_history(brand_conv: DataFrame, summary: DataFrame) -> DataFrame:
    """Converted flag, baskets and spend of each shopper next to the history."""
    lines = brand_conv.select(
        "booking_id", F.col("exposure_crn").alias("crn"), "converted_crn", "basket_key", "article", "amount"
    ).distinct()
    outcome = (
        lines.withColumn("converted", F.when(F.col("converted_crn").isNull(), 0).otherwise(1))
        .groupBy("booking_id", "crn", "converted")
        .agg(
            F.count_distinct("basket_key").alias("n_converted_baskets"),
            F.sum("amount").alias("total_converted_spend"),
        )
    )
    return outcome.join(summary, ["booking_id", "crn"])


def features(history: DataFrame) -> DataFrame:
    """The eight features, zero-filled, one row per shopper of a campaign."""
    return history.select(
        *KEY, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES]
    ).distinct()


def cluster_counts(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("booking_id", "cluster", "cohort").agg(F.count_distinct("crn").alias("customer_count"))


def cap_sample(clustered: DataFrame, cap: int = 6000, seed: str = "sample") -> DataFrame:
    """Random shoppers per cluster and cohort: all of them, or ``floor(cap x share)``.

    The share is that of the cluster and cohort among all shoppers of the campaign.
    """
    people = cut_lineage(clustered.select("booking_id", "cluster", "cohort", "crn").distinct())
    counts = cluster_counts(people)
    totals = people.groupBy("booking_id").agg(F.count_distinct("crn").alias("total"))
    n = F.col("customer_count")
    size = F.when(n > cap, F.floor(cap * n / F.col("total"))).otherwise(n)
    stratum = ["booking_id", "cluster", "cohort"]
    sizes = counts.join(totals, "booking_id").select(*stratum, size.alias("sample_size"))
    keyed = people.withColumn("_key", random_key(seed, "booking_id", "crn"))
    return (
        bucketed_row_number(keyed, stratum, ["_key", "crn"], F.substring("_key", 1, 3), "rank")
        .join(sizes, stratum)
        .filter(F.col("rank") <= F.col("sample_size"))
        .drop("rank", "sample_size", "_key")
    )


def within_cluster_pair_counts(people: DataFrame) -> DataFrame:
    """Size of the exposed x not exposed comparison of each cluster, without listing it."""
    return (
        people.groupBy("booking_id", "cluster")
        .agg(
            F.count_if(F.col("cohort") == "Exposed").alias("n_exposed"),
            F.count_if(F.col("cohort") == "Not Exposed").alias("n_not_exposed"),
        )
        .withColumn("n_pairs", F.col("n_exposed") * F.col("n_not_exposed"))
    )


_MATCH_SCHEMA = (
    "booking_id string, cluster long, place string, candidate string, sum_of_diff_ranks long, "
    + ", ".join(f"{f}_diff double" for f in FEATURES)
)


class _RankedFeature:
    """One feature of the candidates: its distinct values in order and the candidates of each, by id."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.u, group = np.unique(values, return_inverse=True)
        self.group = group.reshape(-1)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.group, minlength=len(self.u)))))
        order = np.argsort(self.group, kind="stable")
        self.keys = self.group[order] * self.n + order  # ascending: by value, then id
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.in_group = place - self.start[self.group]
        self.middle = (self.start[self.group] + self.start[self.group + 1]) / 2
        self.edged = np.concatenate(([-np.inf], self.u, [np.inf]))

    def before(self, group: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Candidates of a group with a lower id."""
        return np.searchsorted(self.keys, group * self.n + row) - self.start[group]

    def _away(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.abs(self.edged[group + 1] - x)

    def nearer(self, group: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """How many candidates differ less from ``x`` than the group does; the difference, the first nearer group beyond
        ``x`` and the group nearest to ``x`` with the same difference (different values may round to one)."""
        above = group >= at
        d = self._away(group, x)
        q = np.where(above, x - d, x + d)
        q[np.isnan(d)] = -np.inf
        k = np.searchsorted(self.u, q)
        k = np.where(above, np.minimum(k, at), np.maximum(k, at))
        while True:  # the sought difference was rounded
            here, last = self._away(k, x), self._away(k - 1, x)
            up = np.where(above, (k < at) & (here >= d), here < d)
            down = np.where(above, last < d, (k > at) & (last >= d)) & ~up
            if not (up.any() or down.any()):
                break
            k = k + up - down
        near, toward = group, np.where(above, -1, 1)
        while True:
            alike = (self._away(near + toward, x) == d) & np.where(above, near > at, near + 1 < at)
            if not alike.any():
                break
            near = near + toward * alike
        less = np.where(above, self.start[near] - self.start[k], self.start[k] - self.start[near + 1])
        return less, d, k, near

    def rank(self, row: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of candidates by difference to ``x``, then id."""
        group = self.group[row]
        less, d, k, near = self.nearer(group, x, at)
        rank = less + self.in_group[row] + 1
        above = group >= at
        for first, step, own in ((np.where(above, k - 1, k), np.where(above, -1, 1), False), (near, np.where(above, 1, -1), True)):
            which, h = np.arange(len(row)), first
            while len(which):
                which = which[self._away(h, x[which]) == d[which]]
                if own:  # not past the point
                    which = which[(first[which] >= at[which]) == (group[which] >= at[which])]
                h = first[which]
                if not len(which):
                    break
                other = h != group[which]
                rank[which[other]] += self.before(h[other], row[which[other]])
                first = first.copy()
                first[which] += step[which]
                h = first[which]
        return np.where(np.isnan(x), row + 1, rank)


class RankedCandidates:
    """The candidates of one cluster as a sorted list per feature and a tree of cells over the lists' positions.

    The best candidate of a point is the one whose ranks by the absolute difference to the point, summed over the
    features, are lowest. No member of a cell has a lower rank than the cell's closest value and lowest id would have,
    so only cells are opened whose sum may still be the lowest: few, whatever the number of candidates.
    About 500 bytes a candidate; many points are searched at once.
    """

    LEAF, FAN = 32, 8

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        """``ids`` ascending; ``values`` candidates x features."""
        self.ids, self.values = ids, values
        every = [_RankedFeature(v) for v in values.T] if len(ids) else []
        # where all have one value, the rank is the place of the id
        self.varied = [(j, f) for j, f in enumerate(every) if len(f.u) > 1]
        self.equal = len(every) - len(self.varied)
        if len(ids):
            self._build()

    def _build(self) -> None:
        n = len(self.ids)
        depth = max(0, int(np.ceil(np.log2(n / self.LEAF))))
        leaf = -(-n // (1 << depth))
        # the last candidate fills the last cells up
        rows = np.minimum(np.arange(leaf << depth), n - 1)
        points = np.stack([*[f.middle for _, f in self.varied], np.arange(n, dtype=float)])
        for level in range(depth):
            rows = rows.reshape(1 << level, -1)
            spread = np.stack([np.ptp(p[rows], axis=1) for p in points])
            spread[-1] *= self.equal + (spread[:-1] == 0).sum(axis=0)  # ids decide where values are equal
            keys = points[spread.argmax(axis=0)[:, None], rows]
            half = rows.shape[1] // 2
            rows = np.take_along_axis(rows, np.argpartition(keys, half, axis=1), axis=1)
        self.leaves = rows.reshape(1 << depth, leaf)
        self.levels = []  # from the leaves up, FAN cells to one
        first = self.leaves.min(axis=1)
        edges = [(f.group[self.leaves].min(axis=1), f.group[self.leaves].max(axis=1)) for _, f in self.varied]
        while True:
            cells = [(lo, hi, f.before(lo, first), f.before(hi, first)) for (_, f), (lo, hi) in zip(self.varied, edges, strict=True)]
            self.levels.insert(0, (first, cells))
            if len(first) == 1:
                return
            fan = min(self.FAN, len(first))
            first = first.reshape(-1, fan).min(axis=1)
            edges = [(lo.reshape(-1, fan).min(axis=1), hi.reshape(-1, fan).max(axis=1)) for lo, hi in edges]

    def _bounds(self, level: int, which: np.ndarray, cell: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """(point, cell, lowest possible sum) of the cells whose members may have a sum up to ``most``."""
        first, cells = self.levels[level]
        low = first[cell]
        total = (low + 1) * self.equal - self.lost[which] * (self.equal + len(self.varied))
        for i, ((j, f), (lo, hi, at_lo, at_hi)) in enumerate(zip(self.varied, cells, strict=True)):
            x, at = self.points[which, j], self.at[j][which]
            lo, hi = lo[cell], hi[cell]
            right, left = lo >= at, hi < at
            inside = np.where(f._away(at - 1, x) <= f._away(at, x), at - 1, at)
            group = np.where(right, lo, np.where(left, hi, inside))
            bound = f.nearer(group, x, at)[0] + np.where(right, at_lo[cell], np.where(left, at_hi[cell], 0)) + 1
            total = total + np.where(np.isnan(x), 1, bound)
            keep = total + len(self.varied) - 1 - i <= most[which] + self.lost[which] * len(self.varied)
            if not keep.all():
                which, cell, total = which[keep], cell[keep], total[keep]
        keep = total <= most[which]
        return which[keep], cell[keep], total[keep]

    def _measure(self, which: np.ndarray, cell: np.ndarray) -> None:
        """Sums of all members of some leaves; keeps each point's lowest."""
        step = max(1, 200_000 // self.leaves.shape[1])
        for a in range(0, len(cell), step):
            w = np.repeat(which[a : a + step], self.leaves.shape[1])
            row = self.leaves[cell[a : a + step]].reshape(-1)
            other = (row < self.own[w, 0]) | (row >= self.own[w, 1])
            w, row = w[other], row[other]
            total = (row + 1) * self.equal
            for o in range(int(self.lost.max())):
                mine = self.own[w, 0] + o
                total -= ((mine < self.own[w, 1]) & (mine < row)) * self.equal
            for i, (j, f) in enumerate(self.varied):
                x, at = self.points[w, j], self.at[j][w]
                total = total + f.rank(row, x, at)
                for o in range(int(self.lost.max())):  # a shopper of both cohorts has no rank before its candidates
                    there = np.flatnonzero(self.own[w, 0] + o < self.own[w, 1])
                    mine = self.own[w[there], 0] + o
                    d, own = np.abs(f.u[f.group[row[there]]] - x[there]), np.abs(f.u[f.group[mine]] - x[there])
                    total[there] -= (own < d) | ((own == d) & (mine < row[there]))
                keep = total + len(self.varied) - 1 - i <= self.least[w]
                if not keep.all():
                    w, row, total = w[keep], row[keep], total[keep]
            order = np.lexsort((row, total, w))
            w, row, total = w[order], row[order], total[order]
            one = np.flatnonzero(np.diff(w, prepend=-1))
            w, row, total = w[one], row[one], total[one]
            better = (total < self.least[w]) | ((total == self.least[w]) & (row < self.found[w]))
            self.least[w[better]], self.found[w[better]] = total[better], row[better]

    def best_of(self, points: np.ndarray, own: np.ndarray | None = None, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Candidate and sum of ranks for each point; of equal sums the lower id, -1 without any.

        ``own`` (points x 2) are the first candidate, and the one behind the last, that are no candidates of a point.
        """
        n = len(self.ids)
        found, least = np.full(len(points), -1), np.full(len(points), np.iinfo(np.int64).max // 2)
        if own is None:
            own = np.zeros((len(points), 2), np.int64)
        for a in range(0, len(points) if n else 0, step):
            self._search(points[a : a + step], own[a : a + step])
            found[a : a + step], least[a : a + step] = np.where(self.found < n, self.found, -1), self.least
        return found, least

    def _search(self, points: np.ndarray, own: np.ndarray) -> None:
        m, bottom = len(points), len(self.levels) - 1
        self.points, self.own, self.lost = points, own, own[:, 1] - own[:, 0]
        self.at = {j: np.searchsorted(f.u, points[:, j]) for j, f in self.varied}
        self.least, self.found = np.full(m, np.iinfo(np.int64).max // 2), np.full(m, len(self.ids))
        # one way down, through the cell with the lowest bound each time
        which, cell = np.arange(m), np.zeros(m, np.int64)
        for level in range(1, bottom + 1):
            w, c, bound = self._bounds(level, *self._opened(level, which, cell), self.least)
            order = np.lexsort((bound, w))
            one = order[np.flatnonzero(np.diff(w[order], prepend=-1))]
            which, cell = w[one], c[one]
        self._measure(which, cell)
        which, cell, bound = np.arange(m), np.zeros(m, np.int64), None
        for level in range(1, bottom + 1):
            which, cell, bound = self._bounds(level, *self._opened(level, which, cell), self.least)
        if bound is None:
            return
        # the leaves with the lowest bounds first, which leaves fewer to the later ones
        order = np.lexsort((bound, which))
        which, cell, bound = which[order], cell[order], bound[order]
        turn = np.arange(len(which)) - np.searchsorted(which, which)
        a = 0
        while a <= turn.max(initial=-1):
            b = 2 * a + 2
            now = (turn >= a) & (turn < b) & (bound <= self.least[which])
            self._measure(which[now], cell[now])
            a = b

    def _opened(self, level: int, which: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fan = len(self.levels[level][0]) // len(self.levels[level - 1][0])
        return np.repeat(which, fan), (cell[:, None] * fan + np.arange(fan)).reshape(-1)

    def best(self, point: np.ndarray) -> tuple[int, int]:
        """(candidate, sum of ranks) of one point."""
        found, least = self.best_of(np.asarray(point, dtype=float)[None, :])
        return int(found[0]), int(least[0])


def _rank_match(places: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Candidate with the lowest sum of the eight difference ranks, for every place of a chunk."""
    candidates = candidates.sort_values("crn", kind="stable")
    ids, values = candidates["crn"].to_numpy(dtype=object), candidates[FEATURES].to_numpy(dtype=float)
    pool = RankedCandidates(ids, values)
    points = places[FEATURES].to_numpy(dtype=float)
    # a shopper of both cohorts is no candidate for itself
    own, both = np.zeros((len(places), 2), np.int64), places["own"].notna().to_numpy()
    if both.any():
        mine = places["own"].to_numpy(dtype=object)[both]
        own[both] = np.stack([np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")], axis=1)
    found, least = pool.best_of(points, own)
    kept = np.flatnonzero(found >= 0)
    picked, chosen = places.iloc[kept], found[kept]
    table = np.abs(values[chosen] - points[kept])
    return pd.DataFrame(
        {
            "booking_id": pd.Series(picked["booking_id"].to_numpy(dtype=object), dtype=object),
            "cluster": picked["cluster"].to_numpy(dtype=np.int64),
            "place": pd.Series(picked["place"].to_numpy(dtype=object), dtype=object),
            "candidate": pd.Series(ids[chosen], dtype=object),
            "sum_of_diff_ranks": least[kept],
            **{f"{f}_diff": table[:, j] for j, f in enumerate(FEATURES)},
        }
    )


def place_chunks(places: DataFrame, candidates: DataFrame, chunk_rows: int) -> DataFrame:
    """Into how many chunks the places of each cluster are dealt; clusters without candidates have none."""
    cluster = ["booking_id", "cluster"]
    asked = places.groupBy(*cluster).agg(F.count(F.lit(1)).alias("asked"))
    sizes = candidates.groupBy(*cluster).agg(F.greatest(F.lit(float(chunk_rows)), F.count(F.lit(1)) / 4).alias("size"))
    return asked.join(sizes, cluster).select(*cluster, F.ceil(F.col("asked") / F.col("size")).cast("int").alias("chunks"))


def rank_match(people: DataFrame, feats: DataFrame, chunk_rows: int = 2000) -> DataFrame:
    """Best not exposed shopper of each exposed one inside its cluster, over all shoppers.

    Each of the eight absolute differences is ranked among the candidates (ties by
    id) and the ranks are summed; of equal sums the lower id is chosen.  Exposed shoppers with equal
    features stand at one place, which is searched once.  The places of a cluster are dealt to chunks of about
    ``chunk_rows``, or a quarter of the cluster's candidates where that is more: each chunk meets all of them,
    which so repeats them no more than four times as often as there are places.
    """
    rows = cut_lineage(people.join(feats, KEY).select("booking_id", F.col("cluster").cast("long"), "crn", "cohort", *FEATURES))
    cluster = ["booking_id", "cluster"]
    candidates = rows.filter(F.col("cohort") == "Not Exposed").drop("cohort")
    both = candidates.select(*cluster, "crn").withColumn("own", F.col("crn"))
    place = F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in FEATURES], "own"), 256)
    exposed = rows.filter(F.col("cohort") == "Exposed").drop("cohort").join(both, [*cluster, "crn"], "left").withColumn("place", place)
    places = exposed.groupBy(*cluster, "place").agg(F.min("own").alias("own"), *[F.min(f).alias(f) for f in FEATURES])
    places = cut_lineage(places)
    chunks = place_chunks(places, candidates, chunk_rows)
    asked = places.join(chunks, cluster).withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
    met = candidates.join(chunks, cluster).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    # fresh column ids: both sides come from one stage table
    met = met.toDF(*met.columns)
    keys = [*cluster, "chunk"]
    found = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(
        lambda left, right: _rank_match(left[["booking_id", "cluster", "place", "own", *FEATURES]], right), _MATCH_SCHEMA
    )
    return exposed.select(*cluster, "place", "crn").join(found, [*cluster, "place"]).select(
        *cluster, "crn", "candidate", "sum_of_diff_ranks", *[f"{f}_diff" for f in FEATURES]
    )


def unique_candidates(matches: DataFrame) -> DataFrame:
    """Keeps for each candidate the exposed shopper it fits best."""
    best = F.min(F.struct("sum_of_diff_ranks", "crn")).alias("b")
    kept = matches.groupBy("booking_id", "candidate").agg(best).select("booking_id", "candidate", F.col("b.crn").alias("crn"))
    return matches.join(kept, ["booking_id", "candidate", "crn"], "left_semi")


def shopper_uplift(matches: DataFrame, sku_sales: DataFrame, brand_sales: DataFrame) -> DataFrame:
    """Spend of each exposed shopper against its match, by SKU and by brand."""
    out = matches.select("booking_id", "crn", "candidate")
    for level, sales in (("sku", sku_sales), ("brand", brand_sales)):
        spend = sales.groupBy("booking_id", "converted_crn").agg(
            F.sum("amount").alias("spend"), F.count_distinct("basket_key").alias("baskets")
        )
        for side, key in (("exposed", "crn"), ("control", "candidate")):
            named = spend.select(
                "booking_id", F.col("converted_crn").alias(key),
                F.col("spend").alias(f"{side}_spend_{level}"), F.col("baskets").alias(f"{side}_baskets_{level}"),
            )
            out = out.join(named, ["booking_id", key], "left")
        out = out.withColumn(f"uplift_{level}", F.col(f"exposed_spend_{level}") - F.col(f"control_spend_{level}"))
    return out


def campaign_uplift(uplift: DataFrame, cohorts: DataFrame, history: DataFrame, sample: DataFrame, sku_conv: DataFrame, brand_conv: DataFrame) -> DataFrame:
    """Sums, relative uplift and the estimate for all exposed shoppers of a campaign."""
    sums = uplift.groupBy("booking_id").agg(
        F.count("candidate").alias("n_pairs"),
        *[F.sum(f"{s}_{m}_{lv}").alias(f"{s}_{m}_{lv}") for s in ("exposed", "control") for m in ("spend", "baskets") for lv in ("sku", "brand")],
    )
    total = cohorts.filter(F.col("cohort") == "Exposed").groupBy("booking_id").agg(
        F.count_distinct("crn").alias("total_exposed_shoppers")
    )
    sampled = (
        history.filter(F.col("cohort") == "Exposed")
        .join(sample.select("booking_id", "crn").distinct(), ["booking_id", "crn"], "left_semi")
        .groupBy("booking_id")
        .agg(
            F.count_distinct("crn").alias("sampled_exposed_shoppers"),
            F.count_distinct(F.when(F.col("converted") == 1, F.col("crn"))).alias("sampled_converted_shoppers"),
        )
    )

    def converted(conv: DataFrame, level: str) -> DataFrame:
        return conv.filter(F.col("exposure_context") == "Exposed").groupBy("booking_id").agg(
            F.count_distinct("converted_crn").alias(f"converted_exposed_{level}")
        )

    out = sums
    for part in (total, sampled, converted(sku_conv, "sku"), converted(brand_conv, "brand")):
        out = out.join(part, "booking_id", "left")
    cols: dict[str, Column] = {}
    for lv in ("sku", "brand"):
        diff = F.col(f"exposed_spend_{lv}") - F.col(f"control_spend_{lv}")
        cols[f"total_uplift_{lv}"] = diff
        cols[f"percentage_uplift_{lv}"] = safe_divide(f"exposed_spend_{lv}", f"control_spend_{lv}") - 1
        cols[f"estimated_uplift_{lv}"] = safe_divide(diff, "sampled_exposed_shoppers") * F.col("total_exposed_shoppers")
    return out.withColumns(cols)


def uplift_profile(results: DataFrame, exposures: DataFrame, sets: DataFrame, articles: DataFrame, min_baskets: int = 2000) -> DataFrame:
    """Campaign uplift with brands, categories, media, SKU count and weeks."""
    used = exposures.select("booking_id", "sku_set").distinct()
    items = sets.join(used, ["booking_id", "sku_set"], "left_semi").select("booking_id", "article").distinct()
    named = items.join(articles.select("article", "brand", "category"), "article", "left").groupBy("booking_id").agg(
        F.array_join(F.array_sort(F.collect_set("brand")), ", ").alias("brands"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"),
        F.count_distinct("article").alias("n_skus"),
    )
    media = exposures.groupBy("booking_id").agg(
        F.array_join(F.array_sort(F.collect_set("media_type")), ", ").alias("media_types"),
        week_diff_sunday(F.max("campaign_end_date"), F.min("campaign_start_date")).alias("n_campaign_weeks"),
    )
    return (
        results.filter((F.col("exposed_baskets_brand") > min_baskets) & (F.col("control_baskets_brand") > min_baskets))
        .join(named, "booking_id", "left")
        .join(media, "booking_id", "left")
        .withColumn("brand_spend_per_convert", safe_divide("exposed_spend_brand", "sampled_converted_shoppers"))
    )


def uplift_by(profile: DataFrame, dim: str | None, level: str = "brand") -> DataFrame:
    """Average relative uplift per member of a listed dimension, or over all campaigns."""
    col = f"percentage_uplift_{level}"
    known = profile.filter(F.col(col).isNotNull())
    out = [F.count_distinct("booking_id").alias("n_campaigns"), F.avg(col).alias("avg_uplift")]
    if dim is None:
        return known.agg(*out)
    return known.withColumn("member", F.explode(F.split(dim, ", "))).groupBy("member").agg(*out)


def cohort_conversion(history: DataFrame) -> DataFrame:
    """Customers, converters and rate by cohort and buyer type."""
    kind = F.when(F.col("total_orders_brand").isNull(), "Never Buyer").otherwise("Buyer")
    converted = F.count_distinct(F.when(F.col("total_converted_spend").isNotNull(), F.col("crn")))
    return history.groupBy("booking_id", "cohort", kind.alias("relationship")).agg(
        F.count_distinct("crn").alias("customers"),
        converted.alias("converted"),
        F.try_divide(converted, F.count_distinct("crn")).alias("rate"),
    )


def cluster_balance(sample: DataFrame) -> DataFrame:
    """Exposed and not exposed sampled shoppers per cluster."""
    wide = sample.groupBy("booking_id", "cluster").pivot("cohort", ["Exposed", "Not Exposed"]).agg(F.count_distinct("crn"))
    return wide.select(
        "booking_id", "cluster", F.col("Exposed").alias("n_exposed"), F.col("Not Exposed").alias("n_not_exposed")
    )
