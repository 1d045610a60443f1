from __future__ import annotations

import pytest
from framelake import schema
from framelake.operators import registry as R
from pyspark.sql import functions as F

ROWS = "episode_hash string, robot_name string, embodiment string, is_deleted boolean, path string"


@pytest.fixture
def episodes(spark):
    return spark.createDataFrame(
        [("match", "aria", "aria", False, "s3://a"), ("fallback", None, "aria", None, "s3://b"), ("deleted", "aria", "aria", True, "s3://c"), ("blank", "aria", "aria", False, "  ")], ROWS
    )


def hashes(df):
    return sorted(r[0] for r in df.select("episode_hash").collect())


def test_filter_keeps_match_and_fallback(episodes):
    kept = R.where_all(R.normalize(episodes), ["robot_name = 'aria'", "trim(coalesce(path, '')) <> ''"])
    assert hashes(kept) == ["fallback", "match"]


def test_empty_filter_drops_deleted_only(episodes):
    assert hashes(R.where_all(episodes, [])) == ["blank", "fallback", "match"]


def test_condition_must_be_boolean(episodes):
    with pytest.raises(TypeError):
        R.where_all(episodes, ["1 + 1"])
    with pytest.raises(Exception):
        R.where_all(episodes, ["robot_name ="])


def test_missing_column(episodes):
    with pytest.raises(Exception):
        R.where_all(episodes, ["nowhere = 1"])
    assert len(hashes(R.where_all(episodes, ["nowhere = 1"], missing_column="pass"))) == 3


def test_unknown_preset():
    with pytest.raises(ValueError, match="aria-all"):
        R.preset("nothing")


def test_upsert_keeps_one_row_for_each_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", None)], "k string, v int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", None)]
    assert sorted(map(tuple, R.update(old, new, ["k"]).collect())) == [("a", 1), ("b", 3)]
    assert R.conflicts(old, new, ["k"]).count() == 1


def test_layouts_partition_channels():
    for width in (12, 14, 18, 20):
        parts = schema.layout(width)
        assert sorted(sum(parts.values(), [])) == list(range(width))
    assert schema.layout(13) is None


def test_large_groups_by_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, g string")
    assert [r["i"] for r in R.where_group_larger(df, "g", 1).orderBy("i").collect()] == [1, 2]
    assert R.choose(df, "i", exclude=[df.filter(F.col("g") == "a")]).count() == 1


def test_short_companions_match(spark):
    from framelake.operators import joins

    left = spark.createDataFrame([("ab",), ("abcdef",), ("x",), ("zz",), ("",)], "a string")
    right = spark.createDataFrame([("abc",), ("abcd",), ("xylo",), ("q",)], "b string")
    want = {}
    for a in ("ab", "abcdef", "x", "zz", ""):
        hits = [b for b in ("abc", "abcd", "xylo", "q") if a.startswith(b) or b.startswith(a)]
        if hits:
            want[a] = min(hits)
    assert dict(map(tuple, joins.first_prefix_match(left, right, "a", "b", 4).collect())) == want


def test_repeated_new_keys_give_one_row(spark):
    from framelake.operators import registry

    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, None)], "k int, v string")
    assert sorted(map(tuple, registry.update(old, new, ["k"]).collect())) == [(1, "y"), (2, "b")]
    assert sorted(map(tuple, registry.upsert(old, new, ["k"]).collect())) == [(1, "y"), (2, "b"), (3, None)]


def test_modes_and_projections(spark):
    import numpy as np
    import pytest
    from framelake.operators import selection

    ranked = selection.permuted(spark.range(7).withColumnRenamed("id", "k"), "k")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(7))
    assert selection.by_mode(ranked, "valid", 0.01).count() == 1 and selection.by_mode(ranked, "train", 0.01).count() == 6
    assert selection.sample(ranked, 0.0, 5).count() == 1 and selection.sample(ranked, 2.0, 5).count() == 5
    assert selection.window_of(ranked, 5, 20).count() == 7
    with pytest.raises(ValueError):
        selection.by_mode(ranked, "other")
    rows = np.array(selection.projection(64, 8, 3))
    np.testing.assert_allclose(rows @ rows.T, np.eye(8), atol=1e-12)
    x = np.arange(64.0)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(selection.projected("x", rows.tolist()).alias("y")).first()["y"]
    np.testing.assert_allclose(got, rows @ x)
