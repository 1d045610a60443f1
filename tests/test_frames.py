from __future__ import annotations

import pytest
from framelake.operators import joins as J
from framelake.operators import statistics as S
from framelake.operators import windows as W
from pyspark.sql import functions as F


@pytest.mark.parametrize(("spans", "dropped"), [([], 0), ([(3, 8)], 4), ([(0, 5)], 3), ([(2, 4), (6, 9)], 3)])
def test_pauses(spark, spans, dropped):
    x, rows = 0.0, []
    for t in range(10):
        still = t > 0 and any(a <= t < b for a, b in spans)
        x += 0.0 if still else 0.1
        rows.append((1, t, x))
    df = W.pause_keep(spark.createDataFrame(rows, "episode int, t int, x double"), W.moved_less(["x"], 0.005))
    # reference loop
    keep, paused, last = [], False, None
    for _, _, v in rows:
        still = last is not None and abs(v - last) < 0.005
        keep.append(not (still and paused))
        paused, last = still, v
    assert [r["keep"] for r in df.orderBy("t").collect()] == keep
    assert keep.count(False) == dropped


def test_one_frame_is_kept(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "episode int, t int, x double")
    assert W.pause_keep(df, W.moved_less(["x"], 1.0)).first()["keep"]


def test_chunk_pads_and_stops(spark):
    df = spark.createDataFrame([(1, t, float(t), 3) for t in range(5)], "episode int, t int, x double, stop int")
    got = {r["t"]: r["chunk"] for r in W.chunk(df, "x", 3).collect()}
    assert got[0] == [0, 1, 2] and got[3] == [3, 4, 4] and got[4] == [4, 4, 4]
    got = {r["t"]: r["chunk"] for r in W.chunk(df, "x", 3, limit="stop", zero=F.lit(0.0)).collect()}
    assert got[1] == [1, 2, 0] and got[2] == [2, 0, 0]


def test_strict_window(spark):
    rows = [(1, t, True) for t in range(4)] + [(2, t, 0 < t < 3) for t in range(4)] + [(3, t, t != 2) for t in range(4)] + [(4, 0, False)]
    got = {r["episode"]: r["reject_reason"] for r in W.strict_window(spark.createDataFrame(rows, "episode int, t int, ok boolean"), F.col("ok")).collect()}
    assert got == {1: None, 2: None, 3: "gap", 4: "no valid frame"}


def test_interval_conventions(spark):
    frames = spark.createDataFrame([(1, t) for t in range(6)], "episode int, t int")
    spans = spark.createDataFrame([(1, 0, 0, 2, "a"), (1, 1, 2, 4, "b"), (1, 2, 3, 3, "zero")], "episode int, ordinal int, start_idx int, end_idx int, text string")
    texts = {r["t"]: r["texts"] for r in J.interval_join(frames, spans, width=2).collect()}
    assert texts == {0: ["a"], 1: ["a"], 2: ["b"], 3: ["b"], 4: [], 5: []}
    last = {r["t"]: r["text"] for r in J.interval_join(frames, spans, closed="both", pick="last", width=2).collect()}
    assert last == {0: "a", 1: "a", 2: "b", 3: "zero", 4: "b", 5: None}
    filled = {r["t"]: r["text"] for r in J.with_previous(J.interval_join(frames, spans, pick="first")).collect()}
    assert filled[5] == "b"


def test_asof_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([("a", 5), ("a", 20)], "k string, at int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 7, "y")], "k string, at int, v string")
    got = {r["at"]: r["v"] for r in J.asof_nearest(left, right, ["k"], "at", "v").collect()}
    assert got == {5: "x", 20: "y"}
    near = {r["at"]: r["v"] for r in J.asof_nearest(left, right, ["k"], "at", "v", F.lit(4)).collect()}
    assert near == {5: "x", 20: None}


def test_running_offset_over_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = [r["o"] for r in S.running_offset(df, "k", "n", "o", blocks=5).orderBy("k").collect()]
    assert got == [sum(i % 7 for i in range(k)) for k in range(100)]


def test_splits_are_nested(spark):
    df = S.hash_rank(spark.range(2000), ["id"], 3)
    a, b = df.filter("u < 0.1"), df.filter("u < 0.3")
    assert a.join(b, "id", "left_anti").count() == 0
    assert 500 < b.count() < 700


def test_top_share_keeps_unscored_groups(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 1, 1.0), ("b", 2, float("nan"))], "g string, i int, s double")
    got = S.top_share(df, "g", "s", "i", 0.25)
    assert sorted(r["i"] for r in got.filter("g = 'a'").collect()) == [7, 8, 9]
    assert got.filter("g = 'b'").count() == 2
