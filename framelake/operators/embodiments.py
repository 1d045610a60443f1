"""Named pipelines from frames with poses to action chunks: window, re-framing, resampling, encoding, joining of channels.

Windows and joins are Spark operators; the chain of rigid-body steps between them runs once over Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import rotations as R
from framelake.operators.windows import chunk

LENGTH = 100
Batch = dict[str, np.ndarray]


@dataclass(frozen=True)
class Pipeline:
    """arms: pose columns, left first. frame: the pose column that chunks are seen from, or a fixed pose for each arm. wrist:
    whether they are then seen from each arm's own pose at the anchor. encoding: 'ypr', '6d' or 'quat'. grippers: columns."""

    horizon: int
    stride: int
    arms: tuple[str, ...]
    state: tuple[str, ...]
    encoding: str
    frame: str | tuple[tuple[float, ...], ...]
    wrist: bool = False
    grippers: tuple[str, ...] = ()
    keypoints: tuple[str, ...] = ()


# Where the camera stands in the frame of each arm's base, as rows of a 4x4 matrix.
EXTRINSICS = {
    "x5Dec13_2": (
        (
            (0.01329544, -0.71757193, 0.69635749, -0.04409191),
            (-0.99959782, -0.02698416, -0.00872107, -0.23221381),
            (0.02504862, -0.69596148, -0.7176421, 0.57323278),
            (0.0, 0.0, 0.0, 1.0),
        ),
        (
            (-0.04733948, -0.76631195, 0.64072222, -0.01998031),
            (-0.9983006, 0.05811952, -0.00424732, 0.32539554),
            (-0.0339837, -0.63983444, -0.76776103, 0.64809634),
            (0.0, 0.0, 0.0, 1.0),
        ),
    ),
}
Matrix = tuple[tuple[float, ...], ...]


def pose_of(matrix: Matrix) -> tuple[float, ...]:
    """xyz + quaternion of a 4x4 matrix."""
    m = np.array(matrix, dtype=float)
    return (*m[:3, 3].tolist(), *R.from_matrix(m[:3, :3]).tolist())


_CAMERA = tuple(map(pose_of, EXTRINSICS["x5Dec13_2"]))
_ROBOT = {"horizon": 45, "stride": 1, "arms": ("left_cmd", "right_cmd"), "state": ("left_obs", "right_obs"), "grippers": ("left_grip", "right_grip"), "frame": _CAMERA}
_HUMAN = {"horizon": 30, "stride": 1, "arms": ("left_obs", "right_obs"), "state": ("left_obs", "right_obs"), "frame": "head"}
PIPELINES: dict[tuple[str, str], Pipeline] = {}
for _mode, _more in {
    "cartesian": {"encoding": "ypr"}, "cartesian_6d": {"encoding": "6d"},
    "cartesian_wristframe_ypr": {"encoding": "ypr", "wrist": True}, "cartesian_wristframe_6d": {"encoding": "6d", "wrist": True}, "cartesian_wristframe_quat": {"encoding": "quat", "wrist": True},
}.items():
    PIPELINES["eva", _mode] = Pipeline(**_ROBOT | _more)
    for _who, _stride in (("aria", 3), ("mecka", 1), ("scale", 1)):
        PIPELINES[_who, _mode] = Pipeline(**_HUMAN | _more | {"stride": _stride})
for _frame in ("head", "wrist"):
    for _enc in ("ypr", "quat"):
        for _who, _stride in (("aria", 3), ("mecka", 1), ("scale", 1)):
            PIPELINES[_who, f"keypoints_{_frame}frame_{_enc}"] = Pipeline(**_HUMAN | {"stride": _stride, "encoding": _enc, "wrist": _frame == "wrist", "keypoints": ("left_keys", "right_keys")})


def pipeline(embodiment: str, mode: str, extrinsics: tuple[Matrix, ...] | None = None) -> Pipeline:
    """A named pipeline. extrinsics: other camera matrices for a robot's arms, left first."""
    if (embodiment, mode) not in PIPELINES:
        raise ValueError(f"no mode {mode!r} for {embodiment!r}; there are {sorted(m for e, m in PIPELINES if e == embodiment)}")
    p = PIPELINES[embodiment, mode]
    return p if extrinsics is None else replace(p, frame=tuple(map(pose_of, extrinsics)))


def _stack(a: pa.Array) -> np.ndarray:
    """A column of numbers, arrays or arrays of arrays of one size as one array, read from its flat values."""
    shape = [len(a)]
    while pa.types.is_list(a.type):
        if a.null_count:
            raise ValueError("a null inside a chunk")
        sizes = np.diff(a.offsets.to_numpy())
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("arrays of different sizes in one column")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        a = a.flatten()
    return a.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape)


def _lists(x: np.ndarray) -> pa.Array:
    """An array of any rank as a column of nested arrays."""
    out, inside = pa.array(np.ascontiguousarray(x).reshape(-1)), x.size
    for n in reversed(x.shape[1:]):
        inside //= n
        out = pa.ListArray.from_arrays(pa.array(np.arange(inside + 1, dtype=np.int32) * n), out)
    return out


def _actions(b: Batch, p: Pipeline) -> tuple[np.ndarray, np.ndarray]:
    n = len(b[p.state[0]])
    actions, state = [], []
    for k, arm in enumerate(p.arms):
        frame = b[p.frame] if isinstance(p.frame, str) else np.tile(np.array(p.frame[k]), (n, 1))
        now = R.reframe(frame, b[p.state[k]][:, None])
        path = R.resample_pose(R.reframe(frame, b[arm][:, :: p.stride]), LENGTH)
        keys = R.reframe(frame, b[p.keypoints[k]][:, :: p.stride].reshape(n, -1, 3)).reshape(n, -1, 63) if p.keypoints else None
        if p.wrist:
            path = R.reframe(now[:, 0], path)
            keys = R.reframe(now[:, 0], keys.reshape(n, -1, 3)).reshape(n, -1, 63) if keys is not None else None
        actions.append(R.encode(path, p.encoding))
        state.append(R.encode(now, p.encoding)[:, 0])
        if keys is not None:
            actions.append(R.resample(keys, LENGTH))
            state.append(keys[:, 0])
        if p.grippers:
            actions.append(R.resample(b[p.grippers[k]][:, :: p.stride, None], LENGTH))
            state.append(b[p.grippers[k]][:, :1])
    return np.concatenate(actions, -1), np.concatenate(state, -1)


PIECE = 64  # rows that pass numpy at once, and an Arrow batch


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most PIECE rows; a batch of Spark's 10,000 rows would be more than a gigabyte in each worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= PIECE:
        spark.conf.set(name, str(PIECE))


def _pieces(columns: tuple[pa.Array, ...], run: Callable[..., pa.Array]) -> pa.Array:
    parts = [run(*[_stack(c.slice(at, PIECE)) for c in columns]) for at in range(0, max(1, len(columns[0])), PIECE)]
    return pa.concat_arrays(parts)


_CHUNKS = "struct<actions: array<array<double>>, state: array<double>>"
_CHUNKS_ARROW = pa.struct([("actions", pa.list_(pa.list_(pa.float64()))), ("state", pa.list_(pa.float64()))])


def action_chunks(frames: DataFrame, p: Pipeline) -> DataFrame:
    """frames (episode, t, poses...): episode, t, actions array<array<double>> (LENGTH rows) and state array<double>. A row
    comes out more than a hundred kilobytes wide, so Arrow batches are kept as small as the pieces, whatever the table's size."""
    bounded(frames.sparkSession)
    df = frames
    for c in dict.fromkeys([*p.arms, *p.grippers, *p.keypoints]):
        df = chunk(df, c, p.horizon, f"{c}_chunk")
    fixed = [*p.state, *([p.frame] if isinstance(p.frame, str) else [])]
    names = list(dict.fromkeys(fixed))
    chunks = list(dict.fromkeys([*p.arms, *p.grippers, *p.keypoints]))
    at = replace(p, arms=tuple(f"{c}@" for c in p.arms), grippers=tuple(f"{c}@" for c in p.grippers), keypoints=tuple(f"{c}@" for c in p.keypoints))

    def run(*columns: np.ndarray) -> pa.Array:
        if not len(columns[0]):
            return pa.array([], _CHUNKS_ARROW)
        actions, state = _actions(dict(zip([*names, *(f"{c}@" for c in chunks)], columns, strict=True)), at)
        return pa.StructArray.from_arrays([_lists(actions), _lists(state)], ["actions", "state"])

    step = F.arrow_udf(lambda *columns: _pieces(columns, run), _CHUNKS)
    return df.select("episode", "t", step(*names, *[f"{c}_chunk" for c in chunks]).alias("o")).select("episode", "t", "o.*")


WIDTHS = {"ypr": 6, "6d": 9, "quat": 7}


def _arms(actions: np.ndarray, state: np.ndarray, width: int):  # noqa: ANN202
    for k in range(2):
        yield actions[..., k * width : (k + 1) * width], state[..., k * width : (k + 1) * width]


def revert(actions: np.ndarray, state: np.ndarray, encoding: str, grip: bool, out: str = "ypr") -> np.ndarray:
    """Chunks seen from each arm's own pose, (n, T, D), back to the frame of the state; rotations in the encoding `out`."""
    end, back = WIDTHS[encoding], []
    for a, s in _arms(actions, state, end + grip):
        pose = R.reframe(R.decode(s[..., :end], encoding), R.decode(a[..., :end], encoding), inverse=False)
        back += [R.encode(pose, out), *([a[..., end:]] if grip else [])]
    return np.concatenate(back, -1)


def revert_keypoints(actions: np.ndarray, state: np.ndarray, encoding: str) -> np.ndarray:
    """The landmarks of chunks whose arms are a pose and 63 numbers, seen from each wrist, back to the frame of the state:
    (n, T, 126). State and actions have the same layout; chunks may be of any length."""
    end, back = WIDTHS[encoding], []
    for a, s in _arms(actions, state, end + 63):
        points = a[..., end:].reshape(len(a), -1, 3)
        back.append(R.reframe(R.decode(s[..., :end], encoding), points, inverse=False).reshape(*a.shape[:2], 63))
    return np.concatenate(back, -1)


def _reverted(chunks: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    bounded(chunks.sparkSession)

    def piece(actions: np.ndarray, state: np.ndarray) -> pa.Array:
        return _lists(run(actions, state)) if len(actions) else pa.array([], pa.list_(pa.list_(pa.float64())))

    return chunks.withColumn("reverted", F.arrow_udf(lambda *columns: _pieces(columns, piece), "array<array<double>>")("actions", "state"))


def revert_chunks(chunks: DataFrame, encoding: str, grip: bool, out: str = "ypr") -> DataFrame:
    """action_chunks() of a wrist-frame pipeline with a column reverted: array<array<double>>."""
    return _reverted(chunks, lambda a, s: revert(a, s, encoding, grip, out))


def revert_keypoint_chunks(chunks: DataFrame, encoding: str) -> DataFrame:
    """The same for a wrist-frame pipeline with keypoints: their 126 numbers a step, back in the head's frame."""
    return _reverted(chunks, lambda a, s: revert_keypoints(a, s, encoding))
