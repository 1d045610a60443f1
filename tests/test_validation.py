"""Checks of episodes on odd input, bounds, saved statistics, resampled poses and pooled states against plain Python."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from framelake.functions import interp as I
from framelake.operators import evaluation as E
from framelake.operators import statistics as S
from framelake.operators import validation as V
from pyspark.sql import functions as F

GOOD = {"embodiment": 8, "total_frames": 3, "fps": 60, "task_name": "t", "features": {}}
POSE = [0.0, 1.0, 2.0, 0.5, 0.5, 0.5, 0.5]


def problems(spark, metadata, arrays, notes):
    e = spark.createDataFrame([(k, m if isinstance(m, str) else json.dumps(m)) for k, m in metadata.items()], "episode_hash string, metadata string")
    rows = [(k, name, t, v) for k, name, values in arrays for t, v in enumerate(values)]
    a = spark.createDataFrame(rows, "episode_hash string, name string, t int, value array<double>")
    n = spark.createDataFrame(notes, "episode_hash string, name string, ordinal int, record string")
    got: dict = {}
    for r in V.episode_problems(e, a, n).collect():
        got.setdefault(r["episode_hash"], set()).add((r["family"], r["key"], r["problem"]))
    return got


def whole(key):
    return [(key, "images.front_1", [None] * 3), (key, "left.obs_ee_pose", [POSE] * 3), (key, "right.obs_ee_pose", [POSE] * 3)]


def test_a_valid_episode_has_no_problems(spark):
    note = json.dumps({"text": "x", "start_idx": 0, "end_idx": 3})
    more = [("a", "left.obs_gripper", [[0.5]] * 4), ("a", "right.obs_keypoints", [[0.0] * 63] * 3), ("a", "something", [[1.0, 2.0]] * 3)]
    assert problems(spark, {"a": GOOD}, whole("a") + more, [("a", "annotations", 0, note)]) == {}


def test_each_family_tells_its_problem(spark):
    far = [*POSE[:3], 0.0, 0.0, 0.0, 1.01]
    notes = [("f", "notes", k, r) for k, r in enumerate(['{"text": "a", "start_idx": 0, "end_idx": 2}', '{"text": "a", "start_idx": 2, "end_idx": 1}', '{"text": 3, "start_idx": 0, "end_idx": 1}', "no", None, '{"text": "a", "start_idx": 0.5, "end_idx": 1}', '{"text": "a", "start_idx": 0, "end_idx": 4}', "[]"])]
    got = problems(
        spark,
        {"a": {k: v for k, v in GOOD.items() if k not in ("fps", "features")}, "b": GOOD | {"total_frames": 4}, "c": GOOD, "d": GOOD, "e": GOOD, "f": GOOD, "g": "{", "h": GOOD | {"fps": 29.97}},
        whole("a") + whole("b") + whole("c")[:2] + [("c", "obs_head_pose", [POSE, far, far, far])] + whole("d") + [("d", "left.gripper", [[1.0, 2.0]] * 3), ("d", "left.obs_keypoints", [[0.0] * 63, [0.0] * 62, [0.0] * 63])] + whole("e")[:2] + [("e", "right.obs_ee_pose", [POSE[:6]] * 3)] + whole("f") + whole("h"),
        notes,
    )
    assert got["a"] == {("metadata", "fps", "missing field"), ("metadata", "features", "missing field"), ("fps", "fps", "unexpected none")}
    assert got["b"] == {("frame count", k, "3 of 4 frames") for k in V.REQUIRED}
    assert got["c"] == {("required key", "right.obs_ee_pose", "missing"), ("pose", "obs_head_pose", "2 quaternions not of length 1, the first at 1")}
    assert got["d"] == {("gripper", "left.gripper", "width 1 expected, not 2"), ("keypoints", "left.obs_keypoints", "width 63 expected, not 62 to 63")}
    assert got["e"] == {("pose", "right.obs_ee_pose", "width 7 expected, not 6")}
    assert got["f"] == {("annotation", "notes", "7 of 8 malformed, the first by its range")}
    assert {p[0] for p in got["g"]} == {"metadata", "fps", "required key"} and len(got["g"]) == 9
    assert got["h"] == {("fps", "fps", "unexpected 29.97")}


def test_embodiments_in_metadata(spark):
    docs = ['{"embodiment": 8}', '{"robot_name": " eva_bimanual "}', '{"embodiment": "", "attributes": {"robot_type": "09"}}', '{"embodiment": 999, "metadata": {"embodiment_name": "aria"}}', '{"metadata": {"embodiment": null}}', "{", '{"attributes": {"embodiment": "x"}, "robot_type": "y"}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").withColumn("d", F.try_parse_json("j"))
    assert [r[0] for r in df.select(V.embodiment_of("d")).collect()] == ["EVA_BIMANUAL", "EVA_BIMANUAL", "MECKA_BIMANUAL", "ARIA", None, None, "Y"]


def test_valid_poses(spark):
    rows = [POSE, [1e8, *POSE[1:]], [*POSE[:3], 0.0, 0.0, 0.0, 1e-7], POSE[:6], None, [-1e9, *POSE[1:]], [math.nan, *POSE[1:]]]
    df = spark.createDataFrame([(r,) for r in rows], "p array<double>")
    assert [r[0] for r in df.select(V.valid_pose(F.col("p"))).collect()] == [True, False, False, False, False, False, False]


def test_bounds(spark):
    low, high = [0.0] * 3, [1.0] * 3
    rows = [([0.5, 0.5, 0.5],), ([0.5, -0.1, 0.5],), ([0.5, 0.5, 1.1],), ([0.5, math.nan, 2.0],), ([0.5, None, 0.5],), ([0.5, math.inf, 0.5],), ([0.5, 0.5],), (None,), ([0.0, 1.0, 1.0],)]
    df = spark.createDataFrame(rows, "v array<double>").withColumn("l", F.lit(low)).withColumn("h", F.lit(high))
    why = V.bounds_reason(F.col("v"), F.col("l"), F.col("h"))
    some = V.bounds_reason(F.col("v"), F.col("l"), F.col("h"), [0, 1])
    got = [tuple(r) for r in df.select(why, some).collect()]
    assert got == [(None, None), ("bounds", "bounds"), ("bounds", None), ("not finite",) * 2, ("not finite",) * 2, ("not finite",) * 2, (None, None), (None, None), (None, None)]
    assert V.guarded_channels("actions_cartesian", 14) == [0, 1, 2, 6, 7, 8, 9, 13]
    assert V.guarded_channels("x.ee_pose", 18) == [0, 1, 2, 9, 10, 11] and V.guarded_channels("ee_pose", 5) is None and V.guarded_channels("gaze", 14) is None
    one = spark.createDataFrame([(1.0, 9.0, 2.0, 8.0)], "q0_1 double, q99_9 double, q1 double, q99 double")
    assert one.select(*V.quantile_bounds(one, 0.5)).first()[:] == (0.5, 9.5)
    first = df.select(V.first_violation([("a", F.lit(None).cast("string")), ("b", why), ("c", F.lit("last"))]).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in first[:2]] == [("c", "last"), ("b", "bounds")]


def test_statistics_come_back_as_they_went(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(e, k, d, float(x)) for e in (1, 7) for k in ("pose", "grip") for d in range(3 if k == "pose" else 1) for x in rng.normal(size=40)]
    stats = S.norm_stats(spark.createDataFrame(rows, "e int, k string, d int, v double"), ["e", "k", "d"], "v")
    S.save_stats(stats, "e", "k", "d", str(tmp_path / "s"))
    got = S.load_stats(spark, str(tmp_path / "s"), "e int, k string").select("e", "k", F.col("dim").alias("d"), *S.STATS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.select("e", "k", "d", *S.STATS).collect()))
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "s").glob("part-*")).splitlines()[0])
    assert set(doc["stats"]) == {"pose", "grip"} and len(doc["stats"]["pose"]["mean"]) == 3


def test_pose_chunks_by_numpy(spark):
    rng = np.random.default_rng(3)
    chunks = [np.cumsum(rng.normal(size=(9, 7)), 0) for _ in range(6)]
    chunks[2][4, 1] = 1e8
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(chunks)], "k int, c array<array<double>>")
    got = {r["k"]: np.array(r["o"]) for r in I.with_resampled(df, "c", "o", 30, 7, angle=(3, 4, 5)).collect()}
    for k, c in enumerate(chunks):
        if k == 2:
            assert (got[k] == 1e9).all()
            continue
        old, new = np.linspace(0, 1, 9), np.linspace(0, 1, 30)
        for j in range(7):
            series = np.unwrap(c[:, j]) if 3 <= j < 6 else c[:, j]
            want = np.interp(new, old, series)
            diff = got[k][:, j] - want
            if 3 <= j < 6:
                assert (np.abs(got[k][:, j]) <= np.pi + 1e-9).all()
                diff = (diff + np.pi) % (2 * np.pi) - np.pi
            np.testing.assert_allclose(diff, 0, atol=1e-9)


def test_masks_and_last_tokens(spark):
    masks = [([1, 1, 0, 0], 3, [1] * 2 + [0] * 2), ([1, 0], 6, [1, 1, 1, 0, 0, 0]), ([1, 0, 1], 7, [1, 1, 0, 0, 1, 1])]
    for mask, n, want in masks[1:]:
        assert spark.createDataFrame([(mask,)], "m array<int>").select(I.repeated_mask(F.col("m"), n)).first()[0] == want
    rows = [([1, 1, 0],), ([0, 1, 1],), ([1, 1, 1],), ([0, 0, 0],), ([1, 0, 0],)]
    df = spark.createDataFrame(rows, "m array<int>").withColumn("s", F.lit([10, 20, 30]))
    assert [r[0] for r in df.select(I.last_token(F.col("s"), F.col("m"))).collect()] == [20, 30, 30, None, 10]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(I.unit_length(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, None]


def test_metric_suite(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 4, 3)), rng.normal(size=(20, 4, 3))
    df = spark.createDataFrame([(int(k % 2), a[k].tolist(), b[k].tolist()) for k in range(20)], "g int, t array<array<double>>, p array<array<double>>")
    for r in E.suite(df, ["g"], "t", "p", 2.0).collect():
        e = (a - b)[r["g"] :: 2]
        want = (10, (e**2).mean(), np.abs(e).mean(), (e[:, -1] ** 2).mean(), np.abs(e).max(), (np.abs(e).max((1, 2)) > 2.0).mean())
        assert tuple(r)[1:] == pytest.approx(want)
