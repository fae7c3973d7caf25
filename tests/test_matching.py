"""Matching against sequential brute force."""

import random

import pytest

from counterlift.operators import matching as M
from counterlift.operators.campaign_matching import nearest_control_of_all

PAIRS = "campaign_id string, test_store long, control_store long, abs_perc_diff double"
FEATS = "campaign_id string, site long, mean double, std double, test_or_control string, weeks_count long"


def sequential(rows, key):
    taken, used_t, used_c = set(), set(), set()
    for k, t, c, w in sorted(rows, key=key):
        if (k, t) not in used_t and (k, c) not in used_c:
            taken.add((k, t, c))
            used_t.add((k, t))
            used_c.add((k, c))
    return taken


def graph(seed):
    rnd = random.Random(seed)
    rows = []
    for k in ("A", "B", "C"):
        for t in range(rnd.randint(1, 12)):
            for c in range(100, 100 + rnd.randint(1, 12)):
                if rnd.random() < 0.7:
                    rows.append((k, t, c, rnd.randint(0, 6) / 4))  # few values: many ties
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_global_equals_sequential_scan(spark, seed):
    rows = graph(seed)
    got = M.global_match(spark.createDataFrame(rows, PAIRS)).collect()
    found = {(r.campaign_id, r.test_store, r.control_store) for r in got}
    assert found == sequential(rows, key=lambda r: (r[3], r[1], r[2]))
    # maximal: no pair with both stores free is left
    used_t = {(k, t) for k, t, _ in found}
    used_c = {(k, c) for k, _, c in found}
    assert all((k, t) in used_t or (k, c) in used_c for k, t, c, _ in rows)


def test_greedy_follows_input_order(spark):
    rows = graph(3)
    ordered = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(ordered, PAIRS + ", ordinal long")
    got = {(r.campaign_id, r.test_store, r.control_store) for r in M.greedy_match(df, "ordinal").collect()}
    at = {r: i for i, r in enumerate(rows)}
    assert got == sequential(rows, key=lambda r: at[r])


def test_a_long_chain_of_choices_ends(spark):
    rows = [("A", i, 100 + j, float(i + j)) for i in range(25) for j in (i, i + 1)]
    got = {(r.campaign_id, r.test_store, r.control_store) for r in M.global_match(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == sequential(rows, key=lambda r: (r[3], r[1], r[2]))
    assert M.global_match(spark.createDataFrame([], PAIRS)).collect() == []


def test_grid_equals_all_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for k, n in (("A", 60), ("B", 8)):
        for s in range(n):
            mean, std = rnd.lognormvariate(4, 1), rnd.lognormvariate(2, 1)
            if s % 7 == 0:
                mean, std = 50.0, 9.0  # a hot cell of equal stores
            if s in (1, 2):
                std = 0.0
            if s == 3:
                mean = -mean
            if s == 4:
                std = None
            if s == 5:
                mean = mean * 1e6  # an outlier
            rows.append((k, s, mean, std, "Test" if s % 3 == 0 or s in (1, 5) else "Control", 12))
    feats = spark.createDataFrame(rows, FEATS)
    key = ["campaign_id", "test_store", "control_store"]
    brute = M.nearest_control(M.pair_distance(M.candidate_pairs(feats)).select(*key, "abs_perc_diff"))
    want = {tuple(r[c] for c in key) for r in brute.collect()}
    got = nearest_control_of_all(feats).collect()
    assert {tuple(r[c] for c in key) for r in got} == want
    assert len(got) == len(want)


def test_two_pass_keeps_one_test_per_control(spark):
    rows = [("A", 1, 10, 0.2), ("A", 2, 10, 0.1), ("A", 3, 11, 0.4)]
    got = M.two_pass_unique(spark.createDataFrame(rows, PAIRS)).collect()
    assert {(r.test_store, r.control_store) for r in got} == {(2, 10), (3, 11)}
