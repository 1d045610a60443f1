"""Paths, neighbours and leaves whose work grew too fast, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from framelake.functions import nested as L
from framelake.operators import information as N
from framelake.operators import pairing as P


@pytest.mark.parametrize("band", [0, 1, 3, 4])
def test_few_paths_are_followed_in_double(band):
    """Noise, whose envelopes bound nothing: nearly each pair gets a path, but the nearest and hardly any other is kept."""
    rnd = np.random.default_rng(1)
    for x, y in ((rnd.standard_normal((70, 24, 1)), rnd.standard_normal((600, 24, 1))), (1e6 + rnd.standard_normal((40, 9, 3)), 1e6 + rnd.standard_normal((300, 9, 3)))):
        all_of = P.warped(np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1, 1)), band).reshape(len(x), len(y))
        for best in (np.full(len(x), np.inf), all_of.min(1), all_of[:, :16].min(1)):
            found = [(i, j) for i, j, _ in P._candidates(x, y, best, band)]
            i, j = (np.concatenate(v) for v in zip(*found, strict=True))
            assert len(i) < 2 * len(x) and set(zip(range(len(x)), all_of.argmin(1).tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_a_value_that_is_not_a_number_spoils_no_other_pair(spark):
    nan, kind = float("nan"), "g int, k int, x array<double>"
    left = spark.createDataFrame([(0, 1, [0.0, 1.0, 2.0]), (0, 2, [5.0, nan, 5.0]), (1, 3, [1.0, 1.0, 1.0])], kind)
    right = spark.createDataFrame([(0, 10, [0.0, nan, 2.0]), (0, 11, [0.0, 0.0, 1.0]), (0, 12, [0.0, 0.0, 1.0]), (1, 14, [nan, 1.0, 1.0]), (1, 13, [nan, 0.0, 0.0])], kind)
    got = {r["k"]: (r["other"], r["distance"], r["n_pairs"]) for r in P.nearest_by_warping(left, right, "g", "k", "x", 1).collect()}
    assert got[1] == (11, 1.0, 3)
    assert [got[k][0] for k in (2, 3)] == [10, 13] and all(np.isnan(got[k][1]) for k in (2, 3))


def test_wide_rows_are_sifted_and_counted_exactly(monkeypatch):
    """Distances in double are taken of hardly more pairs than are near, whatever the range; ties are counted as by all pairs."""
    rnd = np.random.default_rng(2)
    for a, b in ((rnd.standard_normal((300, 20)), rnd.standard_normal((700, 20))), (1e9 + rnd.integers(0, 4, (150, 12)) * 1.0, 1e9 + rnd.integers(0, 4, (600, 12)) * 1.0), (np.ones((5, 9)), np.ones((6, 9)))):
        d = np.abs(a[:, None] - b[None]).max(-1)
        reach = np.sort(d, axis=1)[:, 2:5]
        assert (N._nearer(a, b, reach) == (d[:, :, None] < reach[:, None]).sum(1)).all()
        firsts = N._firsts(a, b, reach[:, 2], 4)
        assert all((got == want).all() for got, want in zip(firsts, np.sort(d, axis=1)[:, :4], strict=True))
        taken = sum(len(i) for i, _, _ in N._close(a, b, reach[:, 2]))
        assert taken <= 1.1 * (d <= reach[:, 2:]).sum() + 10


def test_information_of_wide_rows_in_small_blocks(spark):
    rnd = np.random.default_rng(5)
    v = np.concatenate([rnd.standard_normal((160, 10)), np.repeat(rnd.standard_normal((1, 10)), 9, axis=0)])
    rows = [("a", k, x[:4].tolist(), x[4:].tolist(), k % 3 > 0) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, k int, x array<double>, y array<double>, ref boolean")
    h = lambda n: sum(1.0 / i for i in range(1, n + 1))
    dx, dy = (np.abs(v[:, None, s] - v[None, :, s]).max(-1) for s in (slice(0, 4), slice(4, 10)))
    for reference, ref in ((None, np.ones(len(v), bool)), ("ref", np.arange(len(v)) % 3 > 0)):
        got = {r["k"]: r["mi"] for r in N.ksg(df, "g", "k", "x", "y", [3, 5], reference, block=32).collect()}
        for i in range(len(v)):
            near = np.sort(np.maximum(dx, dy)[i, ref])
            of = lambda k: [max(int((d[i, ref] < near[k] * (1 - 1e-10)).sum()) - 1, 0) for d in (dx, dy)]  # noqa: E731, B023
            want = np.mean([h(k - 1) - sum(map(h, of(k))) + h(int(ref.sum()) - 1) for k in (3, 5)])
            assert got[i] == pytest.approx(want)


def test_leaves_of_lists_follow_the_schema(spark):
    kind = "k int, a struct<s: string, l: array<struct<v: double, w: array<array<int>>>>>, b array<string>"
    rows = [(1, ("x", [(1.5, [[1, 2], [], None, [3]]), (None, []), None]), ["p", None]), (2, None, None), (3, (None, []), [])]
    df = L.flattened_lists(spark.createDataFrame(rows, kind), ["k"], ["a", "b"])
    got = {(r["k"], r["path"]): r["value"] for r in df.collect()}
    assert got == {
        (1, "a.s"): "x", (1, "a.l.0.v"): "1.5", (1, "a.l.0.w.0.0"): "1", (1, "a.l.0.w.0.1"): "2", (1, "a.l.0.w.3.0"): "3", (1, "a.l.1.v"): None, (1, "a.l.2.v"): None,
        (1, "b.0"): "p", (1, "b.1"): None, (2, "a.s"): None, (3, "a.s"): None,
    }
    assert "variant" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
