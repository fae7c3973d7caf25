"""The search by summed ranks: few candidates are ranked, and rows are not repeated with the square of a cluster."""

import numpy as np
import pytest

from counterlift.operators import shoppers as P


def brute(ids, values, point, own):
    rows = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
    total = np.zeros(len(rows), np.int64)
    for j in range(8):
        total[np.argsort(np.abs(values[rows, j] - point[j]), kind="stable")] += np.arange(1, len(rows) + 1)
    return (int(rows[total.argmin()]), int(total.min())) if len(rows) else (-1, None)


VALUES = {
    "ties": lambda rng, n: rng.integers(0, 4, (n, 8)).astype(float),
    "zeros": lambda rng, n: np.where(rng.random((n, 8)) < 0.7, 0.0, rng.integers(0, 5, (n, 8)).astype(float)),
    "spread": lambda rng, n: rng.random((n, 8)) * 1000,
    # different values whose differences to a far point round to one
    "rounded": lambda rng, n: rng.integers(0, 3, (n, 8)) * 0.1 + rng.integers(0, 4, (n, 8)) * 1e-13,
}


@pytest.mark.parametrize("kind", VALUES)
def test_points_searched_at_once_equal_brute_force(kind):
    rng = np.random.default_rng(5)
    for n in (1, 2, 33, 150, 400):
        values = VALUES[kind](rng, n)
        ids = np.sort(rng.integers(0, 2 * n, n).astype(str).astype(object))  # some come twice
        points = np.concatenate([values[:8], values[:8] + 0.1, np.full((1, 8), 3000.7), np.full((1, 8), -5.0)])
        names = [ids[rng.integers(0, n)] if i % 2 else None for i in range(len(points))]
        own = np.array([(0, 0) if o is None else (np.searchsorted(ids, o, "left"), np.searchsorted(ids, o, "right")) for o in names])
        found, least = P.RankedCandidates(ids, values).best_of(points, own)
        for i, name in enumerate(names):
            best, total = brute(ids, values, points[i], name)
            assert found[i] == best and (best < 0 or least[i] == total)


def test_few_candidates_are_ranked_for_a_point(monkeypatch):
    rng = np.random.default_rng(3)
    n = 20_000
    values = np.zeros((n, 8))
    values[:, 0] = 3
    values[:, 1] = np.round(rng.gamma(3, 900, n), 2)
    values[:, 2] = rng.integers(1, 120, n) / 2
    values[:, 3] = values[:, 1] / 3
    ranked, rank = [], P._RankedFeature.rank
    monkeypatch.setattr(P._RankedFeature, "rank", lambda self, row, x, at: ranked.append(len(row)) or rank(self, row, x, at))
    points = values[rng.integers(0, n, 200)] + rng.random((200, 1))
    P.RankedCandidates(np.arange(n).astype(str).astype(object), values).best_of(points)
    assert sum(ranked) / len(points) < n / 20  # over all features


def test_candidates_are_repeated_no_more_than_the_places_allow(spark):
    places = spark.range(8000).selectExpr("'A' AS booking_id", "id % 2 AS cluster")
    candidates = spark.range(20_000).selectExpr("'A' AS booking_id", "0L AS cluster")
    chunks = {r.cluster: r.chunks for r in P.place_chunks(places, candidates, chunk_rows=10).collect()}
    assert chunks == {0: 1}  # 400 chunks of 10 would meet 8 million candidates
    few = {r.cluster: r.chunks for r in P.place_chunks(places, candidates.limit(7), chunk_rows=10).collect()}
    assert few == {0: 400}
