"""Exact quantiles, category codes and label numbers against plain Python."""

import math
import random

import numpy as np
import pytest

from counterlift.operators import quantiles as Q


@pytest.mark.parametrize("few", [Q.FEW, 50, 1])
def test_quantiles_equal_numpy(spark, few):
    rng = random.Random(2)
    values = {
        "spread": [rng.gauss(0, 1) * 10 ** rng.randint(-200, 200) for _ in range(3000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(2000)],
        "one": [5.0] * 700,
        "tiny": [1.5],
        "two": [1.0, 2.0],
        "mostly": [0.0] * 1500 + [rng.random() for _ in range(400)],
    }
    rows = [(g, v) for g, x in values.items() for v in x] + [("spread", None), ("none", None)]
    ps = [0.0, 0.05, 0.5, 0.61, 0.999, 1.0]
    got = {r.g: r.q for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", ps, few).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        x = sorted(x)
        for p, v in zip(ps, got[g], strict=True):
            at = p * (len(x) - 1)
            lo, hi = x[math.floor(at)], x[math.ceil(at)]
            assert v == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12, abs=0)


def test_whole_frame_and_empty_frame(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert [list(r.q) for r in Q.exact_quantiles(df, [], "x", [0.25], few=10).collect()] == [[25.0]]
    assert Q.exact_quantiles(df.limit(0), [], "x", [0.5], few=10).collect() == []


def test_category_codes_equal_sorted_places(spark):
    rng = random.Random(1)
    values = [rng.choice([None, "", "a", "B", "é", "z" * 50, *map(str, range(60))]) for _ in range(400)]
    got = Q.category_codes(spark.createDataFrame(list(enumerate(values)), "i long, v string"), "v").collect()
    order = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert len(got) == len(values)
    assert all(r.code == (-1 if r.v is None else order.index(r.v)) for r in got)
    assert Q.category_codes(spark.createDataFrame([], "i long, v string"), "v").collect() == []


def test_two_numbers_of_a_label(spark):
    df = spark.createDataFrame([("101.0_202.0",), ("7_8",), ("mu_pop",), (None,), ("x12_3.5y",)], "label string")
    test, control = Q.number_pair("label")
    assert [tuple(r) for r in df.select(test, control).collect()] == [(101, 202), (7, 8), (None, None), (None, None), (12, 3)]


def test_numpy_agrees_on_the_definition():
    assert np.quantile([1.0, 2.0, 4.0], 0.75) == 3.0
