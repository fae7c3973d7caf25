"""Campaign-wide matching against a sequential scan over all pairs."""

import datetime
import random

import numpy as np
import pytest

from counterlift.operators import campaign_matching as C

FEATS = "campaign_id string, site long, mean double, std double, test_or_control string"
SALES = "campaign_id string, site long, sales_week date, sales_amount double"


def stores(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for k, scale in (("A", 1.0), ("B", 1e4), ("C", 1.0)):
        for i in range(n):
            kind = rng.random()
            if kind < 0.5:
                m, s = rng.uniform(1, 3) * scale, rng.uniform(1, 3)
            elif kind < 0.7:
                m, s = rng.choice([1.0, 2.0]) * scale, rng.choice([1.0, 1.5])  # copies and ties
            elif kind < 0.8:
                m, s = rng.uniform(100, 1e6), rng.uniform(1e-6, 1e-3)  # far from all others
            elif kind < 0.9:
                m, s = -rng.uniform(0.1, 5), rng.choice([0.0, 1.0])
            else:
                m, s = rng.choice([None, 0.0, 5.0]), rng.choice([None, 0.0, 2.0])
            rows.append((k, i, m, s, "Test" if rng.random() < {"A": 0.5, "B": 0.2, "C": 0.8}[k] else "Control"))
    return rows


def all_pairs(rows):
    out = []
    for k, t, tm, ts, a in rows:
        for q, c, cm, cs, b in rows:
            if (k, a, b) == (q, "Test", "Control") and None not in (tm, ts, cm, cs) and cm and cs:
                out.append((k, t, c, abs(tm / cm - 1) + abs(ts / cs - 1)))
    return out


def scan(pairs):
    taken, used = {}, set()
    for w, t, c, k in sorted((w, t, c, k) for k, t, c, w in pairs):
        if (k, "t", t) not in used and (k, "c", c) not in used:
            taken[k, t, c] = w
            used |= {(k, "t", t), (k, "c", c)}
    return taken


@pytest.mark.parametrize("finish_pairs", [C.FINISH_PAIRS, 60, 0])
def test_campaign_matching_equals_a_scan_of_all_pairs(spark, finish_pairs):
    rows = stores(finish_pairs % 7 + 1)
    got = C.match_campaigns(spark.createDataFrame(rows, FEATS), finish_pairs).collect()
    assert {(r.campaign_id, r.test_store, r.control_store): r.abs_perc_diff for r in got} == scan(all_pairs(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_control_of_all_equals_all_pairs(spark, seed):
    rows = stores(seed, 70)
    best = {}
    for k, t, c, w in all_pairs(rows):
        best[k, t] = min(best.get((k, t), (np.inf, 0)), (w, c))
    got = C.nearest_control_of_all(spark.createDataFrame(rows, FEATS)).collect()
    assert {(r.campaign_id, r.test_store): (r.abs_perc_diff, r.control_store) for r in got} == best


def test_many_copies_are_paired_at_once(spark):
    rows = [("A", i, 2.0, 3.0, "Test") for i in range(300)] + [("A", 1000 + i, 2.0, 3.0, "Control") for i in range(250)] + [("A", 5000, 9.0, 9.0, "Control")]
    got = C.match_campaigns(spark.createDataFrame(rows, FEATS), 0).collect()
    assert {(r.test_store, r.control_store) for r in got} == {(i, 1000 + i) for i in range(250)} | {(250, 5000)}


def test_empty_and_one_sided_campaigns(spark):
    assert C.match_campaigns(spark.createDataFrame([], FEATS)).collect() == []
    assert C.match_campaigns(spark.createDataFrame([("A", 1, 1.0, 1.0, "Test")], FEATS), 0).collect() == []


@pytest.mark.parametrize("finish_pairs", [C.FINISH_PAIRS, 0])
def test_matching_on_correlation_equals_a_scan(spark, finish_pairs):
    rng = np.random.default_rng(5)
    weeks = [datetime.date(2024, 1, 7) + datetime.timedelta(7 * w) for w in range(10)]
    rows, series = [], {}
    for k in "AB":
        shape = rng.standard_normal((4, 10))
        for site in range(24):
            v = np.round(shape[site % 4] + 0.4 * rng.standard_normal(10) + 5, 3)
            if site == 7:
                v[:] = 4.0  # never changes
            for w in range(10):
                if site != 5 or w % 3:
                    rows.append((k, site, weeks[w], float(v[w])))
                else:
                    v[w] = 0.0
            c = v - v.mean()
            series[k, site] = c / np.linalg.norm(c) if np.linalg.norm(c) > 0 else None
    tests = [(k, s) for k in "AB" for s in range(0, 24, 3)]
    pairs = [(k, t, c, round(1 - float(series[k, t] @ series[k, c]), 9)) for k, t in tests for c in range(24)
             if (k, c) not in tests and series[k, t] is not None and series[k, c] is not None]
    got = C.match_on_correlation(spark.createDataFrame(rows, SALES), spark.createDataFrame(tests, "campaign_id string, site long"), finish_pairs).collect()
    assert {(r.campaign_id, r.test_store, r.control_store) for r in got} == set(scan(pairs))
    assert all(abs(r.corr - float(series[r.campaign_id, r.test_store] @ series[r.campaign_id, r.control_store])) < 1e-8 for r in got)


def test_a_query_meets_the_parts_of_a_cell_in_one_row(spark):
    """Every query met every part of its cells as a row of its own, and all of them were shuffled."""
    points = spark.createDataFrame([("A", i, 1.0 + i % 40 / 7, 2.0 + i // 40 / 9) for i in range(1600)], "campaign_id string, id long, m double, s double")
    found = C.nearest_by_moments(points, points, True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(parts") >= 4 and found.count() == 1600
    assert {(r.d, r.id, r.n_places) for r in found.join(points, ["campaign_id", "m", "s", "id"]).collect()} == {(0.0, i, 1) for i in range(1600)}


@pytest.mark.parametrize("seed", [5, 6])
def test_queries_look_only_into_cells_that_may_hold_a_nearer_point(spark, monkeypatch, seed):
    """Queries of all campaigns met every cell within reach, in one task where they were few bytes."""
    monkeypatch.setattr(C, "CELL_POINTS", 6)
    rows = stores(seed, 70)
    best = {}
    for k, t, c, w in all_pairs(rows):
        best[k, t] = min(best.get((k, t), (np.inf, 0)), (w, c))
    got = C.nearest_control_of_all(spark.createDataFrame(rows, FEATS)).collect()
    assert {(r.campaign_id, r.test_store): (r.abs_perc_diff, r.control_store) for r in got} == best


def test_blocks_of_series_give_the_nearest_of_all(spark):
    """A series met every pivot and every series of near cells as a row of its own."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((120, 6))
    v[60:80] = v[40:60] + 1e-13 * rng.standard_normal((20, 6))  # as near as their originals to nine digits
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    schema = "campaign_id string, id long, v array<double>"
    tests = spark.createDataFrame([("A", i, v[i].tolist()) for i in range(40)], schema)
    controls = spark.createDataFrame([("A", i, v[i].tolist()) for i in range(40, 120)], schema)
    found = C.nearest_by_correlation(tests, controls, True, block=9).collect()
    got = {tuple(r.v): (r.d, r.id, r.n_places) for r in found}
    d = np.round(1 - v[:40] @ v[40:].T, 9)
    assert got == {tuple(v[i].tolist()): (d[i].min(), 40 + int(d[i].argmin()), int((d[i] == d[i].min()).sum())) for i in range(40)}
