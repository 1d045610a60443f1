"""Mutual information against all pairs in numpy, shapes of arrays on odd input, required keys."""

from __future__ import annotations

import numpy as np
import pytest
from framelake.functions import arrays as A
from framelake.operators import information as N
from framelake.operators import registry as R
from framelake.operators import statistics as S
from pyspark.sql import functions as F

SCHEMA = "g string, id long, x array<double>, y array<double>, ref boolean, extra string"


def h(n: int) -> float:
    return sum(1.0 / i for i in range(1, n + 1))


def by_pairs(rows: list[tuple], ks: list[int], sampled: bool) -> dict[tuple, float | None]:
    out = {}
    for g, i, x, y, *_ in rows:
        refs = [r for r in rows if r[0] == g and (r[4] or not sampled)]
        dx = np.array([np.abs(np.subtract(x, r[2])).max() for r in refs])
        dy = np.array([np.abs(np.subtract(y, r[3])).max() for r in refs])
        near = np.sort(np.maximum(dx, dy))
        if len(refs) <= max(ks):
            out[g, i] = None
            continue
        eps = [near[k] * (1 - 1e-10) for k in ks]
        out[g, i] = float(np.mean([h(k - 1) - h(max((dx < e).sum() - 1, 0)) - h(max((dy < e).sum() - 1, 0)) + h(len(refs) - 1) for k, e in zip(ks, eps)]))
    return out


@pytest.mark.parametrize("sampled", [False, True])
def test_information_by_pairs(spark, monkeypatch, sampled):
    monkeypatch.setattr(N, "STRIPE", 5)
    rng = np.random.default_rng(3)
    rows = [("hot" if k < 90 else f"g{k % 3}", k, rng.standard_normal(2).round(1).tolist(), rng.standard_normal(3).round(1).tolist(), k % 3 != 0, "e") for k in range(120)]
    rows += [("hot", 1000 + k, [0.5, 0.5], [0.0, 0.0, 0.0], True, "copy") for k in range(8)] + [("few", 2000, [0.0, 0.0], [0.0, 0.0, 0.0], True, None)]
    odd = [(None, 3000, [0.0, 0.0], [0.0, 0.0, 0.0], True, None), ("hot", None, [0.0, 0.0], [0.0, 0.0, 0.0], True, None), ("hot", 3001, None, [0.0, 0.0, 0.0], True, None)]
    got = N.ksg(spark.createDataFrame(rows + odd, SCHEMA), "g", "id", "x", "y", [2, 4], "ref" if sampled else None, block=16).collect()
    want = by_pairs(rows, [2, 4], sampled)
    assert len(got) == len(want)
    for r in got:
        expected = want[r["g"], r["id"]]
        assert (r["mi"] is None) == (expected is None)
        assert expected is None or abs(r["mi"] - expected) < 1e-9


def test_information_of_an_empty_table(spark):
    assert N.ksg(spark.createDataFrame([], SCHEMA), "g", "id", "x", "y", [3]).count() == 0


def test_harmonic_series_goes_on_from_the_sum(spark):
    rows = spark.range(0, 40).select("id", N.harmonic(F.col("id")).alias("h")).collect()
    assert all(abs(r["h"] - h(r["id"])) < 1e-11 for r in rows)


def test_shapes_of_odd_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), (None,)], "a array<double>")
    a = F.col("a")
    rows = df.select(A.reshaped(a, 2).alias("r"), A.gathered(A.reshaped(a, 2), 1).alias("g"), A.repeated(a, 2).alias("t"), A.steps(a).alias("s")).collect()
    assert [tuple(r) for r in rows] == [([[1.0, 2.0], [3.0]], [2.0, None], [1.0, 1.0, 2.0, 2.0, 3.0, 3.0], [1.0, 1.0, 0.0]), ([], [], [], []), (None, None, None, None)]
    codes = spark.createDataFrame([(1,), (7,), (None,)], "i int").select(A.one_hot(F.col("i"), 3)).collect()
    assert [r[0] for r in codes] == [[0, 1, 0], [0, 0, 0], [0, 0, 0]]


def test_attributes(spark):
    pair = "array<struct<name:string,values:array<string>>>"
    given = [[("Action", ["Move"]), ("Action", ["Pick", "x"]), (None, ["n"])], [("Mistake", ["Yes"]), ("Action", ["Move"])], [("Action", ["Adjust"])], [("Action", [])], []]
    df = spark.createDataFrame([(g,) for g in given], f"a {pair}").select(A.attribute_map(F.col("a")).alias("m"))
    rows = df.select("m", A.is_instruction(F.col("m")).alias("ok")).collect()
    assert rows[0]["m"] == {"Action": "Pick"} and rows[4]["m"] == {}
    assert [r["ok"] for r in rows] == [True, False, False, False, False]


def test_required_keys(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x",)], "k string")
    assert R.require(b, a, "k").count() == 1
    with pytest.raises(LookupError, match="y"):
        R.require(a, b, "k")
    assert R.has_keys(a, ["k", "z"]) == {"k": True, "z": False}


def test_batches_of_groups_with_nulls(spark):
    rows = [("a", 1, 5.0), ("a", 2, 9.0), ("a", 3, None), ("a", 4, 1.0), ("a", 5, 20.0), (None, 1, 6.0), (None, 2, 6.0), ("b", None, 3.0), ("b", 1, 8.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "g string, i long, n double, batch string")
    got = {(r["g"], r["i"]): r["batch"] for r in S.size_batches(df, "g", ["i"], "n", 10.0).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 1, ("a", 5): 2, (None, 1): 0, (None, 2): 1, ("b", None): 0, ("b", 1): 1}
    assert S.size_batches(df.limit(0), "g", ["i"], "n", 10.0).count() == 0
