from __future__ import annotations

import numpy as np
import pytest
from framelake.functions import interp as I
from framelake.functions import rotations as R
from framelake.operators import embodiments as E
from pyspark.sql import functions as F


def poses(*shape: int, seed: int = 0) -> np.ndarray:
    a = np.random.default_rng(seed).normal(size=(*shape, 7))
    a[..., 3:] = R.unit(a[..., 3:])
    return a


def same(a: np.ndarray, b: np.ndarray) -> None:
    """Poses are compared as matrices: q and -q are one rotation."""
    np.testing.assert_allclose(a[..., :3], b[..., :3], atol=1e-9)
    np.testing.assert_allclose(R.to_matrix(a[..., 3:]), R.to_matrix(b[..., 3:]), atol=1e-9)


@pytest.mark.parametrize("mode", ["quat", "ypr", "6d"])
def test_encodings_round_trip(mode):
    p = poses(50)
    same(R.decode(R.encode(p, mode), mode), p)


def test_sixd_ignores_column_scale_and_is_orthonormal():
    e = R.encode(poses(20), "6d")
    scaled = e * np.array([1, 1, 1, 3, 3, 3, 0.2, 0.2, 0.2])
    same(R.decode(scaled, "6d"), R.decode(e, "6d"))
    m = R.to_matrix(R.decode(e + np.random.default_rng(1).normal(size=e.shape) * 0.1, "6d")[..., 3:])
    np.testing.assert_allclose(m @ np.swapaxes(m, -1, -2), np.broadcast_to(np.eye(3), m.shape), atol=1e-9)


def test_yaw():
    half = np.sqrt(0.5)
    np.testing.assert_allclose(R.encode(np.array([1, 2, 3, half, 0, 0, half]), "ypr"), [1, 2, 3, np.pi / 2, 0, 0], atol=1e-9)


def test_reframe_inverse():
    frame, chunk = poses(6), poses(6, 9, seed=2)
    same(R.reframe(frame, R.reframe(frame, chunk), inverse=False), chunk)
    identity = np.tile([0, 0, 0, 1.0, 0, 0, 0], (6, 1))
    same(R.reframe(identity, chunk), chunk)
    points = chunk[..., :3]
    np.testing.assert_allclose(R.reframe(frame, R.reframe(frame, points), inverse=False), points, atol=1e-9)


def test_slerp_ends_norms_and_order():
    half = np.sqrt(0.5)
    out = R.resample_pose(np.array([[[0, 0, 0, 1.0, 0, 0, 0], [1, 0, 0, half, 0, 0, half]]]), 5)
    np.testing.assert_allclose(np.linalg.norm(out[..., 3:], axis=-1), 1)
    yaw = R.encode(out, "ypr")[0, :, 3]
    assert (np.diff(yaw) > 0).all()
    np.testing.assert_allclose(yaw[[0, -1]], [0, np.pi / 2], atol=1e-9)


def test_invalid_pose_makes_an_invalid_chunk():
    p = poses(2, 4)
    p[0, 1, 0] = 1e8
    out = R.resample_pose(p, 3)
    assert (out[0] == 1e9).all() and (np.abs(out[1]) < 1e3).all()
    with pytest.raises(ValueError):
        R.unit(np.zeros(4))


@pytest.mark.parametrize("encoding", ["quat", "ypr", "6d"])
def test_revert_undoes_the_wrist_frame(encoding):
    state, path = poses(3, 2), poses(3, 10, 2, seed=5)
    seen = np.concatenate([R.encode(R.reframe(state[:, k], path[:, :, k]), encoding) for k in range(2)], -1)
    now = np.concatenate([R.encode(state[:, k], encoding) for k in range(2)], -1)
    back = E.revert(seen, now, encoding, grip=False)
    same(R.decode(back[..., :6], "ypr"), path[:, :, 0])
    same(R.decode(back[..., 6:], "ypr"), path[:, :, 1])


@pytest.mark.parametrize(
    ("who", "mode", "width", "state"), [("eva", "cartesian", 14, 14), ("eva", "cartesian_6d", 20, 20), ("eva", "cartesian_wristframe_quat", 16, 16), ("aria", "cartesian", 12, 12), ("mecka", "cartesian_wristframe_6d", 18, 18), ("scale", "keypoints_headframe_ypr", 138, 138), ("aria", "keypoints_wristframe_quat", 140, 140)]
)
def test_pipeline_widths(spark, who, mode, width, state):
    p, n = E.pipeline(who, mode), 6
    a = poses(n, 5, seed=3)
    rows = [(1, t, *[a[t, k].tolist() for k in range(5)], [0.1 * i for i in range(63)], [0.2 * i for i in range(63)], 0.5, 0.25) for t in range(n)]
    arrays = ", ".join(f"{c} array<double>" for c in ("left_obs", "right_obs", "left_cmd", "right_cmd", "head", "left_keys", "right_keys"))
    df = spark.createDataFrame(rows, f"episode int, t int, {arrays}, left_grip double, right_grip double")
    got = E.action_chunks(df, p).collect()
    assert len(got) == n
    assert {(len(r["actions"]), len(r["actions"][0]), len(r["state"])) for r in got} == {(100, width, state)}


def test_unknown_mode():
    with pytest.raises(ValueError):
        E.pipeline("eva", "keypoints_headframe_ypr")


def test_interp_matches_numpy(spark):
    a = np.random.default_rng(4).normal(size=9)
    df = spark.createDataFrame([(a.tolist(), [2.0])], "a array<double>, b array<double>")
    r = df.select(I.linear(F.col("a"), 20).alias("x"), I.linear(F.col("b"), 3).alias("y"), I.angles(F.lit([3.0, -3.0]), 3).alias("z")).first()
    np.testing.assert_allclose(r["x"], np.interp(np.linspace(0, 8, 20), range(9), a), atol=1e-12)
    assert r["y"] == [2, 2, 2]
    np.testing.assert_allclose(np.cos(r["z"]), np.cos([3.0, np.pi, -3.0]), atol=1e-9)
