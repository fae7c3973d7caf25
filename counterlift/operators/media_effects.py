"""Effect of each medium with a random intercept per sub-category.

The rows of a group enter only through their moments, so one aggregation over the rows is all
that reads them. The likelihood is then profiled over the ratio of the two variances, which
is where an EM iteration on the same moments ends; intervals come from resampled groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlift.session import cut_lineage

LEVEL = "(intercept)"


def media_rows(results: DataFrame, group: str = "test_group") -> DataFrame:
    """grp, y and terms (term, value): the level, +1 for media of the test store, -1 for those of the control."""
    def media(c: str, sign: float):
        names = F.array_except(F.split(F.coalesce(F.col(c), F.lit("")), ", "), F.array(F.lit("")))
        return F.transform(F.array_distinct(names), lambda m: F.struct(F.concat(F.lit("media:"), F.trim(m)).alias("term"), F.lit(sign).alias("value")))

    entries = F.concat(F.array(F.struct(F.lit(LEVEL).alias("term"), F.lit(1.0).alias("value"))), media("compliant", 1.0), media("other_non_compliant", -1.0))
    return results.select(F.coalesce(group, F.lit("")).alias("grp"), F.coalesce("effect_sales", F.lit(0.0)).cast("double").alias("y"), entries.alias("terms"))


def group_moments(rows: DataFrame) -> DataFrame:
    """grp, i, j, value: sums of x_i x_j per group for i <= j, of x_i y under j = 'y', and of y y; one pass over the rows.

    The products of a row's own few terms are made inside the row, so rows are never joined to each other.
    """
    y = F.array(F.struct(F.lit("y").alias("term"), F.col("y").alias("value")))
    every = rows.select("grp", F.concat("terms", y).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: F.struct(a["term"].alias("i"), b["term"].alias("j"), (a["value"] * b["value"]).alias("v")))))
    products = every.select("grp", F.explode(pairs).alias("p")).select("grp", "p.*").filter((F.col("j") == "y") | ((F.col("i") != "y") & (F.col("i") <= F.col("j"))))
    return products.groupBy("grp", "i", "j").agg(F.sum("v").alias("value"))


class _Group:
    """Dense moments of one group."""

    def __init__(self, pdf: pd.DataFrame, place: dict[str, int]):
        p = len(place)
        self.gram, self.moment, self.square = np.zeros((p, p)), np.zeros(p), 0.0
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["value"], strict=True):
            if j != "y":
                self.gram[place[i], place[j]] = self.gram[place[j], place[i]] = v
            elif i != "y":
                self.moment[place[i]] = v
            else:
                self.square = v
        level = place[LEVEL]
        self.n, self.sums, self.total = self.gram[level, level], self.gram[level], self.moment[level]

    def at(self, ratio: float) -> np.ndarray:
        """Its share of the weighted system at a ratio of the intercepts' variance to the residual one:
        gram, moment, square, rows and log determinant in one flat array."""
        shrink = ratio / (1 + ratio * self.n)
        gram = self.gram - shrink * np.outer(self.sums, self.sums)
        moment = self.moment - shrink * self.sums * self.total
        square = self.square - shrink * self.total * self.total
        return np.concatenate((gram.ravel(), moment, [square, self.n, math.log1p(ratio * self.n)]))


def _groups(pdf: pd.DataFrame, place: dict[str, int]) -> Iterator[_Group]:
    for i, j, v in zip(pdf["i"], pdf["j"], pdf["value"], strict=True):
        yield _Group(pd.DataFrame({"i": i, "j": j, "value": v}), place)


def solve_system(flat: np.ndarray, p: int, ridge: float, level: int) -> tuple[np.ndarray, float, float]:
    """(coefficients, residual variance, twice the profiled log likelihood up to a constant)."""
    gram, moment = flat[: p * p].reshape(p, p), flat[p * p : p * p + p]
    square, n, logs = flat[p * p + p :]
    penalty = np.full(p, ridge)
    penalty[level] = 1e-9
    beta = np.linalg.solve(gram + np.diag(penalty), moment)
    rest = max(1e-300, square - 2 * beta @ moment + beta @ gram @ beta + float(penalty @ (beta * beta)))
    variance = rest / max(1.0, n)
    return beta, variance, -n * math.log(variance) - logs


def _summed(groups: DataFrame, place: dict[str, int], ratios: list[float]) -> np.ndarray:
    """The systems at each ratio, summed over groups; the square of the media per ratio reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for g in _groups(pdf, place):
                part = np.stack([g.at(r) for r in ratios])
                total = part if total is None else total + part
        if total is not None:
            k, at = np.indices(total.shape)
            yield pd.DataFrame({"k": k.ravel(), "at": at.ravel(), "v": total.ravel()})

    summed = groups.mapInPandas(run, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(ratios), len(place) ** 2 + len(place) + 3))
    out[summed["k"], summed["at"]] = summed["v"]
    return out


def best_ratio(groups: DataFrame, place: dict[str, int], ridge: float, closeness: float = 1e-4) -> tuple[float, np.ndarray]:
    """The ratio of variances with the largest likelihood, to a relative closeness, and the system there."""
    p, level = len(place), place[LEVEL]
    lo, hi, points = math.log(1e-8), math.log(1e6), 25
    while True:
        grid = np.linspace(lo, hi, points)
        systems = _summed(groups, place, [math.exp(x) for x in grid])
        best = int(np.argmax([solve_system(f, p, ridge, level)[2] for f in systems]))
        lo, hi = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
        if hi - lo <= closeness:
            return math.exp(grid[best]), systems[best]


def _poisson(names: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights of groups x replicates that depend on the group's name and the seed alone."""
    out = np.empty((len(names), replicates))
    for k, name in enumerate(names):
        out[k] = np.random.default_rng([seed, *str(name).encode()]).poisson(1.0, replicates)
    return out


def media_effects(results: DataFrame, group: str = "test_group", ridge: float = 1.0, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """term, estimate, lo, hi: effect of each medium (test minus control presence), with a 94 % interval.

    Groups have random intercepts. Each replicate weighs whole groups with Poisson(1) numbers made of the
    group's name; their systems are sums of the groups' systems at the fitted ratio of variances. A task
    holds the square of the media for every replicate. Without rows the result is empty.
    """
    spark = results.sparkSession
    moments = cut_lineage(group_moments(media_rows(results, group)))
    shape = "term string, estimate double, lo double, hi double"
    terms = [r[0] for r in moments.filter("i <> 'y'").select("i").distinct().orderBy("i").collect()]  # the media's names
    if not terms:
        return spark.createDataFrame([], shape)
    place = {t: k for k, t in enumerate(terms)}
    p, level = len(terms), place[LEVEL]
    # a group's moments are at most the square of the media
    groups = cut_lineage(moments.groupBy("grp").agg(*[F.collect_list(c).alias(c) for c in ("i", "j", "value")]))
    ratio, system = best_ratio(groups, place, ridge)
    beta, _, _ = solve_system(system, p, ridge, level)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, p * p + p + 3))
        for pdf in batches:
            own = [g.at(ratio) for g in _groups(pdf, place)]
            if own:
                total += _poisson(pdf["grp"].to_numpy(), replicates, seed).T @ np.stack(own)
        yield pd.DataFrame({"rep": range(replicates), "v": list(total)})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.sum(np.stack(pdf["v"].to_list()), axis=0)
        found = solve_system(flat, p, ridge, level)[0] if flat[-2] > 0 else np.full(p, np.nan)
        return pd.DataFrame({"term": terms, "estimate": found})

    boot = groups.mapInPandas(weigh, "rep int, v array<double>").groupBy("rep").applyInPandas(solved, "term string, estimate double")
    interval = boot.filter(~F.isnan("estimate")).groupBy("term").agg(F.percentile("estimate", [0.03, 0.97]).alias("q"))  # one value per replicate
    point = spark.createDataFrame([(t, float(b)) for t, b in zip(terms, beta, strict=True)], "term string, estimate double")
    return point.join(interval, "term", "left").select("term", "estimate", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
