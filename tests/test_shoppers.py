"""Sampling and shopper matching against brute force."""

import numpy as np
import pytest

from counterlift.operators import shoppers as P

SCHEMA = "booking_id string, cohort string, crn string, " + ", ".join(f"{f} double" for f in P.FEATURES)


def frame(spark, n_exposed=15, n_control=25, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_exposed + n_control):
        cohort = "Exposed" if i < n_exposed else "Not Exposed"
        rows.append(("A", cohort, f"{i:03d}", *[float(v) for v in rng.integers(0, 6, 8)]))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    exposed = [r for r in rows if r[1] == "Exposed"]
    control = [r for r in rows if r[1] != "Exposed"]
    out = {}
    for e in exposed:
        total = {c[2]: 0 for c in control}
        for j in range(3, 11):
            for rank, c in enumerate(sorted(control, key=lambda c: (abs(c[j] - e[j]), c[2])), 1):
                total[c[2]] += rank
        best = min(total, key=lambda c: (total[c], c))
        out[e[2]] = (best, total[best])
    return out


@pytest.mark.parametrize("chunk_rows", [4, 500])
def test_rank_match_equals_brute_force(spark, chunk_rows):
    rows, feats = frame(spark)
    people = feats.selectExpr("booking_id", "1L AS cluster", "cohort", "crn")
    got = P.rank_match(people, feats, chunk_rows=chunk_rows).collect()
    assert {r.crn: (r.candidate, r.sum_of_diff_ranks) for r in got} == brute(rows)


def test_a_shopper_of_both_cohorts_is_not_its_own_partner(spark):
    rows, _ = frame(spark, 6, 12)
    rows += [("A", "Exposed", r[2], *r[3:]) for r in rows if r[1] != "Exposed"][:4]
    feats = spark.createDataFrame(rows, SCHEMA)
    got = P.rank_match(feats.selectExpr("booking_id", "1L AS cluster", "cohort", "crn"), feats).collect()
    want = {}
    for e in (r for r in rows if r[1] == "Exposed"):
        want |= brute([e, *[r for r in rows if r[1] != "Exposed" and r[2] != e[2]]])
    assert {r.crn: (r.candidate, r.sum_of_diff_ranks) for r in got} == want


def test_clusters_without_candidates_or_shoppers(spark):
    rows, _ = frame(spark, 5, 0)
    feats = spark.createDataFrame(rows, SCHEMA)
    people = feats.selectExpr("booking_id", "1L AS cluster", "cohort", "crn")
    assert P.rank_match(people, feats).collect() == []
    assert P.rank_match(people.limit(0), feats.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["spread", "ties", "close"])
def test_twenty_thousand_candidates_are_ranked_exactly(kind):
    rng = np.random.default_rng(8)
    n = 20_000
    values = {
        "spread": lambda: rng.random((n, 8)),
        "ties": lambda: np.where(rng.random((n, 8)) < 0.6, 0.0, rng.integers(0, 5, (n, 8)).astype(float)),
        "close": lambda: rng.random((n, 1)) + 0.01 * rng.random((n, 8)),
    }[kind]()
    pool = P.RankedCandidates(np.arange(n).astype(str).astype(object), values)
    for point in [*values[:3], values[5:8].mean(0), np.zeros(8), np.full(8, 9.0)]:
        total = np.zeros(n, np.int64)
        for j in range(8):
            order = np.argsort(np.abs(values[:, j] - point[j]), kind="stable")
            total[order] += np.arange(1, n + 1)
        assert pool.best(point) == (int(total.argmin()), int(total.min()))


def test_sample_size(spark):
    big = spark.range(6001).selectExpr("'A' AS booking_id", "1L AS cluster", "'Exposed' AS cohort", "cast(id AS string) AS crn")
    rest = spark.range(18003).selectExpr("'A' AS booking_id", "2L AS cluster", "'Exposed' AS cohort", "concat('x', id) AS crn")
    got = {r.cluster: r["count"] for r in P.cap_sample(big.union(rest)).groupBy("cluster").count().collect()}
    assert got == {1: 1500, 2: 4500}
