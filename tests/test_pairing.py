"""Warping partners and neighbours over blocks against all pairs in plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from framelake.operators import information as N
from framelake.operators import pairing as P
from framelake.sources.scratch import steps

ROWS = "g string, k long, x array<double>, other string"


def path_cost(a: np.ndarray, b: np.ndarray, band: int) -> float:
    n = len(a)
    best = {(-1, -1): 0.0}
    for i in range(n):
        for j in range(max(0, i - band), min(n, i + band + 1)):
            before = min(best.get(c, np.inf) for c in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
            best[i, j] = before + float(((a[i] - b[j]) ** 2).sum())
    return best[n - 1, n - 1]


def walks(n: int, seed: int) -> list[tuple]:
    rnd = np.random.default_rng(seed)
    kinds = rnd.standard_normal((6, 20)).cumsum(1)
    return [(("a", "b")[k % 4 == 0], k, (kinds[k % 6] + rnd.standard_normal(20) * 0.3).tolist(), "x") for k in range(n)]


@pytest.mark.parametrize("block", [4096, 16])
def test_warping_by_all_pairs(spark, block):
    left, right = walks(90, 1), [(g, 1000 + k, x, o) for g, k, x, o in walks(70, 2)]
    right += [("a", 5000, left[1][2], "x"), ("a", 5001, left[1][2], "x"), (None, 1, left[0][2], "x"), ("a", 6000, None, "x")]
    left += [("c", 900, left[0][2], "x"), (None, 901, left[0][2], "x")]
    got = P.nearest_by_warping(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), "g", "k", "x", 3, block).collect()
    want = {}
    for g, k, x, _ in left:
        pairs = [(path_cost(np.array(x)[:, None], np.array(y)[:, None], 3), j) for h, j, y, _ in right if h == g and y is not None and g]
        if pairs:
            want[k] = min(pairs)
    assert {r["k"]: r["other"] for r in got} == {k: j for k, (_, j) in want.items()}
    assert all(r["distance"] == pytest.approx(want[r["k"]][0]) for r in got)
    assert want[1] == (0.0, 5000)
    sizes = {g: sum(h == g and y is not None for h, _, y, _ in right) for g in "ab"}
    assert all(r["n_pairs"] == sizes[r["g"]] for r in got)
    # similar sequences are a sixth of all: the envelopes keep most of the others from being warped
    assert sum(r["n_warped"] for r in got) < 0.5 * sum(r["n_pairs"] for r in got)


def test_no_pair_above_its_bound_is_warped(spark):
    rows = walks(60, 3)
    left, right = rows[:30], rows[30:]
    got = {r["k"]: r for r in P.nearest_by_warping(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), "g", "k", "x", 2).collect()}
    for g, k, x, _ in left:
        own = [np.array(y)[None, :, None] for h, _, y, _ in right if h == g]
        direct = min(float(((np.array(x) - y[0, :, 0]) ** 2).sum()) for y in own)
        below = sum(P.lower_bound(np.array(x)[None, :, None], *P.envelope(y, 2))[0, 0] <= direct * (1 + 1e-9) for y in own)
        assert 1 <= got[k]["n_warped"] <= below


def test_bounds_hold_for_points_in_space():
    rnd = np.random.default_rng(0)
    a, b = rnd.standard_normal((12, 9, 3)), rnd.standard_normal((12, 9, 3))
    low, high = P.envelope(b, 2)
    bound, cost = P.lower_bound(a, low, high), P.warped(a, b, 2)
    assert np.allclose(cost, [path_cost(x, y, 2) for x, y in zip(a, b, strict=True)])
    assert (np.diag(bound) <= cost).all() and (cost <= ((a - b) ** 2).sum((1, 2)) + 1e-12).all()


def test_no_rows_give_no_partners(spark):
    none = spark.createDataFrame([], ROWS)
    assert P.nearest_by_warping(none, none, "g", "k", "x", 2).collect() == []


POINTS = "g string, k long, x array<double>, y array<double>"


def test_blocks_visited_are_few_and_counts_exact(spark):
    rnd = np.random.default_rng(4)
    p = np.concatenate([rnd.standard_normal((1500, 2)), rnd.uniform(-40, 40, (500, 2)), np.zeros((64, 2))])
    rows = [("a", k, [float(x)], [float(y)]) for k, (x, y) in enumerate(p)] + [("b", 9000 + k, [0.5], [k * 1.0]) for k in range(5)] + [(None, 1, [0.0], [0.0]), ("c", 2, None, [1.0])]
    df = spark.createDataFrame(rows, POINTS)
    with steps(spark) as own:
        visits = {r["g"]: (r["visited"], r["pairs"]) for r in N.block_visits(N.neighbours(own, df, "g", "k", "x", "y", 4, block=64), "g").collect()}
    assert visits["a"][0] < 0.2 * visits["a"][1] and visits["b"] == (5, 5)
    got = {r["k"]: (r["eps"], r["nx"], r["ny"]) for r in N.reach_counts(df, "g", "k", "x", "y", 3, block=64).collect()}
    d = np.abs(p[:, None] - p[None])
    eps = np.sort(d.max(-1), axis=1)[:, 3]
    near = (d < eps[:, None, None] * (1 - 1e-10)).sum(1)
    for k in range(len(p)):
        assert got[k] == (pytest.approx(eps[k]), max(near[k, 0] - 1, 0), max(near[k, 1] - 1, 0))
    assert got[9000] == (pytest.approx(3.0), 4, 2)
    assert set(got) == set(range(len(p))) | set(range(9000, 9005))
