"""Ties, large episodes and folders that were wrong, or were compared pair by pair."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from framelake.operators import blocks as B
from framelake.operators import embodiments as E
from framelake.operators import information as N
from framelake.operators import statistics as S
from framelake.plans import registry
from framelake.sources import folders as D

registry.load()


def test_the_nearest_of_equal_values_has_the_smallest_key(spark):
    left = spark.createDataFrame([(0, 2, 1.0), (0, 4, 0.5), (0, 6, 2.0), (0, 8, 1.5), (0, 10, None)], "g int, k int, x double")
    right = spark.createDataFrame([(0, 9, 1.0), (0, 1, 1.0), (0, 5, 1.0), (0, 3, 2.0), (0, 11, 2.0), (0, 7, None)], "g int, k int, x double")
    assert {r["k"]: r["other"] for r in S.nearest_value(left, right, "g", "k", "x").collect()} == {2: 1, 4: 1, 6: 3, 8: 1, 10: None}


def test_validated_episodes_of_more_than_a_thousand_frames(spark, tmp_path):
    n = 2600
    vectors = [[((k * 31 + i * 17) % 97 + 1) / 97.0 for i in range(64)] for k in range(n)]
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "label": pa.array([1 + k % 2 for k in range(n)], pa.int32()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = duck.sql(registry.ORACLES["validated_episodes"])
    got = registry.QUERIES["validated_episodes"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_file_groups_match_by_starts_of_names(spark):
    names = ["/d/_meta.csv", "/d/a_meta.csv", "/d/ab_meta.csv", "/d/abc.vrs", "/d/ab-1.VRS", "/d/ab-1.VRS.json", "/d/a.Vrs", "/e/abc_meta.csv", "/e/ab.vrs", "/e/abc.VRS", "/e/abc.vrs", "/e/abc.vrs"]
    found = D.groups(spark.createDataFrame([(n,) for n in names], "path string"))
    assert sorted(map(tuple, found.collect())) == [("/d/_meta.csv", "", "/d/a.Vrs", None), ("/d/a_meta.csv", "a", "/d/a.Vrs", None), ("/d/ab_meta.csv", "ab", "/d/ab-1.VRS", "/d/ab-1.VRS.json"), ("/e/abc_meta.csv", "abc", "/e/abc.vrs", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and "startswith" not in plan.lower()


def test_counts_by_rank_are_those_of_all_pairs(spark):
    """Single numbers with ties, copies, a constant and numbers so large that a distance is rounded; no block is compared twice."""
    rng = np.random.default_rng(3)
    n = 600
    x = np.concatenate([np.round(rng.exponential(50, n), 1), np.repeat(7.0, n), rng.integers(0, 40, n) / 3.0])
    y = np.concatenate([2.8e7 + rng.integers(0, 4000, n) / 60.0, rng.normal(size=n), np.repeat(rng.normal(size=n // 3), 3)])
    g = np.repeat([0, 1, 2], n)
    df = spark.createDataFrame([(int(a), k, [float(b)], [float(c)]) for k, (a, b, c) in enumerate(zip(g, x, y, strict=True))], "g int, k int, x array<double>, y array<double>")
    got = {r["k"]: (r["eps"], r["nx"], r["ny"]) for r in N.reach_counts(df, "g", "k", "x", "y", 3, block=64).collect()}
    assert len(got) == 3 * n
    for k in range(3 * n):
        own = g == g[k]
        dx, dy = np.abs(x[own] - x[k]), np.abs(y[own] - y[k])
        eps = np.sort(np.maximum(dx, dy))[3]
        near = eps * (1 - 1e-10)
        assert got[k][0] == pytest.approx(eps, rel=1e-12) and got[k][1:] == (max((dx < near).sum() - 1, 0), max((dy < near).sum() - 1, 0))


def test_single_numbers_are_counted_without_pairs_of_blocks(spark, monkeypatch):
    runs = []
    whole = B.on_pairs
    monkeypatch.setattr(B, "on_pairs", lambda *a: runs.append(1) or whole(*a))
    df = spark.createDataFrame([(0, k, [float(k)], [float(k % 7)]) for k in range(50)], "g int, k int, x array<double>, y array<double>")
    assert N.reach_counts(df, "g", "k", "x", "y", 3).count() == 50 and len(runs) == 1


def test_chunks_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        query = registry.QUERIES["robot_chunk_ends"](spark, DATA)
        assert int(spark.conf.get(name)) <= E.PIECE and query.count() > 0
    finally:
        spark.conf.set(name, before)
