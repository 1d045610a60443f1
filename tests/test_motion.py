"""Chunk pipelines, layouts, pauses and hands against versions with plain matrices."""

from __future__ import annotations

import numpy as np
import pytest
from framelake.functions import packing as P
from framelake.operators import embodiments as E
from framelake.operators import landmarks as L
from framelake.operators import windows as W
from pyspark.sql import functions as F

RNG = np.random.default_rng(11)


def turned(q: np.ndarray) -> np.ndarray:
    """Rotation matrix of a quaternion w x y z, term by term."""
    w, x, y, z = np.asarray(q) / np.linalg.norm(q)
    return np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])


def matrix(pose: np.ndarray) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = turned(pose[3:]), pose[:3]
    return m


def between(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The turn from a to b by a share of its angle, through axis and angle."""
    r = a[:3, :3].T @ b[:3, :3]
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    out = np.eye(4)
    out[:3, 3] = a[:3, 3] + (b[:3, 3] - a[:3, 3]) * share
    k = (r - r.T) / (2 * np.sin(angle)) if angle > 1e-9 else np.zeros((3, 3))
    out[:3, :3] = a[:3, :3] @ (np.eye(3) + np.sin(share * angle) * k + (1 - np.cos(share * angle)) * k @ k)
    return out


def encoded(m: np.ndarray, kind: str) -> list[float]:
    if kind == "6d":
        return [*m[:3, 3], *m[:3, 0], *m[:3, 1]]
    return [*m[:3, 3], np.arctan2(m[1, 0], m[0, 0]), np.arcsin(-m[2, 0]), np.arctan2(m[2, 1], m[2, 2])]


COLUMNS = ("left_obs", "right_obs", "left_cmd", "right_cmd", "head")
N_FRAMES = 70


@pytest.fixture(scope="module")
def body():
    out = {}
    for k, c in enumerate(COLUMNS):
        q = np.array([1.0, 0.2 * k, -0.1, 0.3]) + np.cumsum(RNG.normal(size=(N_FRAMES, 4)) * 0.05, 0)
        out[c] = np.concatenate([np.cumsum(RNG.normal(size=(N_FRAMES, 3)) * 0.1, 0), q / np.linalg.norm(q, axis=1, keepdims=True)], 1)
    out |= {c: np.cumsum(RNG.normal(size=(N_FRAMES, 63)) * 0.1, 0) for c in ("left_keys", "right_keys")}
    return out | {c: RNG.uniform(size=N_FRAMES) for c in ("left_grip", "right_grip")}


@pytest.fixture(scope="module")
def frames(spark, body):
    arrays = ", ".join(f"{c} array<double>" for c in (*COLUMNS, "left_keys", "right_keys"))
    rows = [(1, t, *[body[c][t].tolist() for c in (*COLUMNS, "left_keys", "right_keys")], float(body["left_grip"][t]), float(body["right_grip"][t])) for t in range(N_FRAMES)]
    return spark.createDataFrame(rows, f"episode int, t int, {arrays}, left_grip double, right_grip double").repartition(3)


def plain_chunk(body: dict, who: str, mode: str, t: int) -> tuple[np.ndarray, list[float]]:
    """Actions and state of one frame, step by step with 4x4 matrices."""
    robot, wrist, keys = who == "eva", "wristframe" in mode, mode.startswith("keypoints")
    kind = "6d" if "6d" in mode else "ypr"
    horizon, stride = (45, 1) if robot else (30, 3 if who == "aria" else 1)
    rows = [min(t + k, N_FRAMES - 1) for k in range(horizon)][::stride]
    at = np.linspace(0, len(rows) - 1, 100)
    actions, state = [[] for _ in at], []
    for side, arm in ((0, "left"), (1, "right")):
        frame = np.array(E.EXTRINSICS["x5Dec13_2"][side]) if robot else matrix(body["head"][t])
        if robot:  # the fixed values are rounded, so the nearest rotation stands for them
            u, _, v = np.linalg.svd(frame[:3, :3])
            frame[:3, :3] = u @ v
        now = np.linalg.inv(frame) @ matrix(body[f"{arm}_obs"][t])
        seen = np.linalg.inv(frame)
        path = [seen @ matrix(body[f"{arm}_{'cmd' if robot else 'obs'}"][r]) for r in rows]
        back = np.linalg.inv(now) if wrist else np.eye(4)
        state += encoded(now, kind)
        points = [(back @ seen @ np.vstack([body[f"{arm}_keys"][r].reshape(21, 3).T, np.ones(21)]))[:3].T.reshape(-1) for r in rows] if keys else []
        if keys:
            state += points[0].tolist()
        if robot:
            state.append(body[f"{arm}_grip"][t])
        for k, a in enumerate(at):
            low, share = int(np.floor(a)), a - np.floor(a)
            high = min(low + 1, len(rows) - 1)
            actions[k] += encoded(back @ between(path[low], path[high], share), kind)
            if keys:
                actions[k] += (points[low] + (points[high] - points[low]) * share).tolist()
            if robot:
                g = body[f"{arm}_grip"]
                actions[k].append(g[rows[low]] + (g[rows[high]] - g[rows[low]]) * share)
    return np.array(actions), state


@pytest.mark.parametrize(
    ("who", "mode"), [("eva", "cartesian"), ("eva", "cartesian_6d"), ("eva", "cartesian_wristframe_6d"), ("aria", "cartesian"), ("mecka", "cartesian_wristframe_6d"), ("aria", "keypoints_headframe_ypr"), ("scale", "keypoints_wristframe_ypr")]
)
def test_chunks_by_matrices(frames, body, who, mode):
    got = {r["t"]: r for r in E.action_chunks(frames, E.pipeline(who, mode)).collect()}
    assert len(got) == N_FRAMES
    for t in (0, 13, N_FRAMES - 20, N_FRAMES - 1):
        actions, state = plain_chunk(body, who, mode, t)
        np.testing.assert_allclose(np.array(got[t]["actions"]), actions, atol=2e-6)
        np.testing.assert_allclose(got[t]["state"], state, atol=2e-6)


def test_other_extrinsics(frames, body):
    one = tuple(tuple(r) for r in np.eye(4).tolist())
    r = E.action_chunks(frames, E.pipeline("eva", "cartesian", (one, one))).filter("t = 0").first()
    np.testing.assert_allclose(r["actions"][0][:3], body["left_cmd"][0][:3], atol=1e-9)


@pytest.mark.parametrize("encoding", ["ypr", "quat"])
def test_keypoints_go_back_to_the_head(frames, encoding):
    head = {r["t"]: r for r in E.action_chunks(frames, E.pipeline("mecka", f"keypoints_headframe_{encoding}")).collect()}
    wrist = E.revert_keypoint_chunks(E.action_chunks(frames, E.pipeline("mecka", f"keypoints_wristframe_{encoding}")), encoding)
    n = E.WIDTHS[encoding]
    for r in wrist.collect():
        want = np.array(head[r["t"]]["actions"])
        np.testing.assert_allclose(np.array(r["reverted"]), np.concatenate([want[:, n : n + 63], want[:, 2 * n + 63 :]], 1), atol=1e-9)


@pytest.mark.parametrize(("encoding", "out"), [("6d", "ypr"), ("quat", "quat"), ("ypr", "ypr")])
def test_human_chunks_go_back_to_the_head(frames, encoding, out):
    plain = E.action_chunks(frames, E.pipeline("aria", "cartesian_6d"))
    head = {r["t"]: np.array(r["actions"]) for r in plain.collect()}
    wrist = E.revert_chunks(E.action_chunks(frames, E.pipeline("aria", f"cartesian_wristframe_{encoding}")), encoding, grip=False, out=out)
    from framelake.functions import rotations as R

    for r in wrist.collect():
        got, w = np.array(r["reverted"]), E.WIDTHS[out]
        for k in range(2):
            np.testing.assert_allclose(R.encode(R.decode(got[:, k * w : (k + 1) * w], out), "6d"), head[r["t"]][:, 9 * k : 9 * k + 9], atol=1e-7)


# ---- layouts


def test_layouts_go_there_and_back(spark):
    for name, layout in P.LAYOUTS.items():
        a = RNG.uniform(-1.4, 1.4, size=layout.width)
        if layout.sixd:
            a = a.round(6)
        df = spark.createDataFrame([(a.tolist(), [a.tolist()] * 3), (None, None)], "a array<double>, c array<array<double>>")
        packed = df.withColumn("p", P.pack(F.col("a"), layout)).withColumn("pc", P.pack_chunk(F.col("c"), layout))
        one, none = packed.select("p", "pc", P.unpack(F.col("p"), layout).alias("b"), P.unpack_chunk(F.col("pc"), layout).alias("bc")).collect()
        assert none["p"] is None and none["b"] is None and len(one["p"]) == 32 and one["pc"] == [one["p"]] * 3
        np.testing.assert_allclose(one["b"], a, atol=1e-9)
        np.testing.assert_allclose(one["bc"], [a] * 3, atol=1e-9)
        for side in (0, 1):
            block = one["p"][10 * side : 10 * side + 10]
            if side not in layout.arms:
                assert block == [0.0] * 10, name
                continue
            own = a[layout.arms.index(side) * layout.arm :][: layout.arm]
            if not layout.sixd:
                y, p, r = own[3:6]
                z = np.array([[np.cos(y), -np.sin(y), 0], [np.sin(y), np.cos(y), 0], [0, 0, 1]])
                m = z @ np.array([[np.cos(p), 0, np.sin(p)], [0, 1, 0], [-np.sin(p), 0, np.cos(p)]]) @ np.array([[1, 0, 0], [0, np.cos(r), -np.sin(r)], [0, np.sin(r), np.cos(r)]])
                np.testing.assert_allclose(block[3:9], [*m[:, 0], *m[:, 1]], atol=1e-12)
            assert block[9] == (pytest.approx(own[-1]) if layout.gripper else 0.0)
        assert one["p"][20:] == [0.0] * 12
        with pytest.raises(Exception, match=f"width {layout.width} expected, not 2"):
            spark.createDataFrame([([1.0, 2.0],)], "a array<double>").select(P.pack(F.col("a"), layout)).collect()


def test_rules_prefer_the_special_one(spark):
    rules = P.Rules({("*", "*"): "human_both", ("*", "k"): "robot_left", ("e", "*"): "robot_right", ("e", "k"): "robot_both"})
    pairs = [("e", "k"), ("e", "z"), ("x", "k"), ("x", "z")]
    want = ["robot_both", "robot_right", "robot_left", "human_both"]
    assert [rules.layout(*p) for p in pairs] == [P.LAYOUTS[w] for w in want]
    df = spark.createDataFrame([*pairs, (None, "k"), ("e", None)], "e string, k string")
    assert [r[0] for r in df.select(rules.compiled(F.col("e"), F.col("k"), F.lit)).collect()] == [*want, "robot_left", "robot_right"]
    few = P.Rules({("e", "k"): "robot_both"})
    assert few.layout("x", "k") is None
    with pytest.raises(Exception, match="no layout for x and k"):
        df.filter("e = 'x' AND k = 'k'").select(few.compiled(F.col("e"), F.col("k"), F.lit)).collect()
    with pytest.raises(ValueError, match="nothing"):
        P.Rules({("*", "*"): "nothing"})


# ---- pauses


def keep_mask(left, right, points, eps):
    """Frame by frame; points are arrays or None where a hand has none."""
    keep, paused = [True] * len(left), False
    for t in range(1, len(left)):
        still = all(np.linalg.norm(a[t] - a[t - 1]) < eps for a in (left, right))
        for p in points:
            if p[t] is not None and p[t - 1] is not None and len(p[t]) == len(p[t - 1]) and len(p[t]) and len(p[t]) % 3 == 0:
                d = (np.array(p[t]) - np.array(p[t - 1])).reshape(-1, 3)
                still = still and np.linalg.norm(d, axis=1).max() < eps
        keep[t] = not (still and paused)
        paused = still
    return keep


def test_pauses_of_wrists_and_fingers(spark):
    n, moves = 120, np.random.default_rng(2)
    go = lambda share: np.cumsum((moves.uniform(size=(n, 1)) < share) * 0.5 * np.ones((n, 7)), 0)
    left, right = go(0.15), go(0.15)
    fingers = np.repeat(go(0.1), 9, axis=1)[:, :63]
    fingers[:, :60] = 0  # one finger tip alone moves
    points = [fingers[t].tolist() if t % 11 else None for t in range(n)]
    odd = [[[0.0, 1.0], [], [1.0 * t] * 3][t % 3] for t in range(n)]
    rows = [(1, t, left[t].tolist(), right[t].tolist(), points[t], odd[t]) for t in range(n)] + [(2, 0, left[0].tolist(), right[0].tolist(), None, None)]
    df = spark.createDataFrame(rows, "episode int, t int, l array<double>, r array<double>, p array<double>, o array<double>")
    still = W.moved_less_in_space({"l": 0.1, "r": 0.1}, {"p": 0.1, "o": 0.1})
    got = {(r["episode"], r["t"]): r["keep"] for r in W.pause_keep(df, still).collect()}
    want = keep_mask(left, right, [points, odd], 0.1)
    assert [got[1, t] for t in range(n)] == want and got[2, 0]
    assert 10 < sum(want) < n - 10
    wrists = W.pause_keep(df, W.moved_less_in_space({"l": 0.1, "r": 0.1}, {})).filter("episode = 1").orderBy("t").collect()
    assert [r["keep"] for r in wrists] == keep_mask(left, right, [], 0.1) != want


# ---- hands


def test_poses_of_odd_hands(spark):
    hand = np.zeros((21, 3))
    hand[5], hand[9], hand[13], hand[17] = (0.3, 1, 0), (0, 1, 0), (-0.2, 1, 0), (-0.4, 1, 0)
    flat = hand.copy()
    flat[5] = flat[17] = (0, 2, 0)
    rows = [(0, hand), (1, hand), (0, hand * 0), (1, hand * 0 + 2), (0, flat), (1, hand[:20])]
    df = spark.createDataFrame([(s, h.reshape(-1).tolist()) for s, h in rows], "s int, k array<double>")
    got = [r["p"] for r in L.with_hand_pose(df, "k", "s", "p").collect()]
    # fingers along y, the palm's normal along z: x is the hand's right for the left one and its left for the right one
    for pose, x, y in ((got[0], (1, 0, 0), (0, 0, -1)), (got[1], (-1, 0, 0), (0, 0, 1))):
        m = turned(np.array(pose[3:]))
        np.testing.assert_allclose(pose[:3], hand[[0, 5, 9, 13, 17]].mean(0), atol=1e-12)
        np.testing.assert_allclose(m[:, 2], (0, 1, 0), atol=1e-9)
        np.testing.assert_allclose(np.abs(m[:, 0]), np.abs(x), atol=1e-9)
        np.testing.assert_allclose(np.abs(m[:, 1]), np.abs(y), atol=1e-9)
        assert np.linalg.det(m) == pytest.approx(1)
    assert got[2] == [0, 0, 0, 1, 0, 0, 0]
    assert got[3] == [2, 2, 2, 1, 0, 0, 0]
    np.testing.assert_allclose(got[4], [*flat[[0, 5, 9, 13, 17]].mean(0), 1, 0, 0, 0], atol=1e-12)
    assert got[5] is None
    wrist = L.with_hand_pose(df.limit(1), "k", "s", "p", at="wrist").first()["p"]
    assert wrist == [0, 0, 0, *got[0][3:]]


def test_rotations_to_quaternions(spark):
    qs = RNG.normal(size=(200, 4))
    qs = np.concatenate([qs, np.eye(4), [[0, 1, 1, 0], [0, 0, 1, -1], [1e-9, 1, 0, 0]]])
    df = spark.createDataFrame([(turned(q).reshape(-1).tolist(),) for q in qs], "m array<double>")
    for q, r in zip(qs, df.select(L.matrix_to_quaternion([F.col("m")[k] for k in range(9)]).alias("q")).collect(), strict=True):
        assert r["q"][0] >= 0
        np.testing.assert_allclose(turned(np.array(r["q"])), turned(q), atol=1e-9)


def test_landmarks_of_odd_documents(spark):
    hands = '{"frames": {"7": {"hands": [{"hand_type": "LEFT", "landmarks": [{"landmark_index": 3, "x": 1, "y": 2, "z": 3}]}, {"hand_type": "FOOT", "landmarks": [{"landmark_index": 0}]}, {"hand_type": "RIGHT", "landmarks": []}]}, "8": {"hands": null}, "x": {"hands": [{"hand_type": "LEFT", "landmarks": [{"landmark_index": 1}]}]}, "9": {"hands": [{"hand_type": "RIGHT", "landmarks": [{"landmark_index": 0, "x": 0, "y": 0, "z": 0}]}]}}}'
    pose = lambda f, x, q: f'{{"frame": {f}, "camera_transform": {{"position": {{"x": {x}, "y": 0, "z": 0}}, "orientation": {q}}}}}'
    one, half, none = '{"x": 0, "y": 0, "z": 0, "w": 2}', '{"x": 0, "y": 0, "z": 1, "w": 1}', '{"x": 0, "y": 0, "z": 0, "w": 0}'
    body = f'{{"poses": [{pose(5, 1, one)}, {pose(7, 9, one)}, {pose(7, 1, half)}, {pose(9, 4, one)}, {pose(8, 1, none)}, {{"frame": 3}}]}}'
    df = spark.createDataFrame([("a", hands, body), ("b", "nope", None), ("c", hands, None)], "k string, hands string, body string")
    rows = L.in_camera(L.tidy(df, "k", "hands"), L.camera_poses(df, "k", "body"), "k").collect()
    got = {(r["k"], r["frame"], r["hand_index"], r["landmark_index"]): [round(r[c], 9) for c in "xyz"] for r in rows}
    # the camera of frame 7 is turned by a quarter about z: (1, 2, 3) - (1, 0, 0) = (0, 2, 3) is seen as (2, 0, 3)
    assert got == {("a", 2, 0, 3): [2.0, 0.0, 3.0], ("a", 4, 1, 0): [-4.0, 0.0, 0.0]}
