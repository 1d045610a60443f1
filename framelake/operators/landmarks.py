"""Hand recordings: nested documents to rows of landmarks, rigid transforms on rows, and poses of hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import geometry as G

# Fixed values of the document format.
HANDS = {"LEFT": 0, "RIGHT": 1}
HANDS_JSON = "frames map<string, struct<hands: array<struct<hand_type: string, landmarks: array<struct<landmark_index: int, x: double, y: double, z: double>>>>>>"
BODY_JSON = "poses array<struct<frame: long, camera_transform: struct<position: struct<x: double, y: double, z: double>, orientation: struct<x: double, y: double, z: double, w: double>>>>"


def rigid(q: Column, p: Column) -> Column:
    """The 4x4 matrix of a unit quaternion (w x y z) and a position, as four arrays of four."""
    m, at = G.quaternion_to_matrix(q), G.parts(p, 0, 3)
    rows = [F.concat(F.slice(m, 3 * k + 1, 3), F.array(at[k])) for k in range(3)]
    return F.array(*rows, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def _entry(m: Column, row: int, column: int) -> Column:
    return F.get(F.get(m, F.lit(row)), F.lit(column))


def inverse_rigid(m: Column) -> Column:
    """Inverse of a rigid 4x4 matrix: the rotation transposed, and the position turned back."""
    back = lambda k: -sum((_entry(m, r, k) * _entry(m, r, 3) for r in (1, 2)), _entry(m, 0, k) * _entry(m, 0, 3))
    rows = [F.array(*[_entry(m, c, k) for c in range(3)], back(k)) for k in range(3)]
    return F.array(*rows, F.get(m, F.lit(3)))


def times_point(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The three coordinates of a 4x4 matrix applied to a point."""
    return [_entry(m, k, 0) * x + _entry(m, k, 1) * y + _entry(m, k, 2) * z + _entry(m, k, 3) for k in range(3)]


def tidy(recordings: DataFrame, key: str, hands: str) -> DataFrame:
    """A row for each landmark of each known hand of each frame: key, frame, hand_index, landmark_index, x, y, z. hands is a
    column of JSON; frames whose names aren't numbers and hands of other types are left out."""
    frames = recordings.select(key, F.explode(F.from_json(hands, HANDS_JSON)["frames"]).alias("frame", "_f"))
    hand = frames.select(key, F.col("frame").try_cast("long").alias("frame"), F.explode("_f.hands").alias("_h"))
    index = F.create_map(*[F.lit(x) for pair in HANDS.items() for x in pair])
    rows = hand.select(key, "frame", F.try_element_at(index, F.col("_h.hand_type")).alias("hand_index"), F.explode("_h.landmarks").alias("_l"))
    return rows.filter("frame IS NOT NULL AND hand_index IS NOT NULL").select(key, "frame", "hand_index", "_l.landmark_index", "_l.x", "_l.y", "_l.z")


def camera_poses(recordings: DataFrame, key: str, body: str) -> DataFrame:
    """key, frame, base (the recording's first frame), into_camera (4x4). A frame that repeats keeps its last pose; frames
    without a whole pose or with a zero quaternion are left out."""
    rows = recordings.select(key, F.posexplode(F.from_json(body, BODY_JSON)["poses"]).alias("_n", "_p"))
    p = F.array(*[F.col(f"_p.camera_transform.position.{c}") for c in "xyz"])
    q = F.array(*[F.col(f"_p.camera_transform.orientation.{c}") for c in "wxyz"])
    rows = rows.select(key, "_n", F.col("_p.frame").alias("frame"), p.alias("p"), q.alias("q")).groupBy(key, "frame").agg(F.max_by(F.struct("p", "q"), "_n").alias("_t"))
    rows = rows.withColumn("_q", G.unit_quaternion(F.col("_t.q"), 0)).withColumn("_m", rigid(F.col("_q"), F.col("_t.p")))
    rows = rows.filter(F.forall(F.flatten("_m"), lambda x: x.isNotNull()))
    return rows.select(key, "frame", F.min("frame").over(Window.partitionBy(key)).alias("base"), inverse_rigid(F.col("_m")).alias("into_camera"))


def in_camera(landmarks: DataFrame, poses: DataFrame, key: str) -> DataFrame:
    """Landmarks of frames that have a pose, in the camera's frame, with frames counted from the recording's first pose."""
    df = landmarks.join(poses, [key, "frame"])
    x, y, z = times_point(F.col("into_camera"), F.col("x"), F.col("y"), F.col("z"))
    return df.select(key, (F.col("frame") - F.col("base")).alias("frame"), "hand_index", "landmark_index", x.alias("x"), y.alias("y"), z.alias("z"))


def matrix_to_quaternion(m: list[Column]) -> Column:
    """Unit quaternion with w >= 0 of a rotation's nine numbers, row by row: the largest of its four parts comes from the
    diagonal, the others from sums and differences across it."""
    a, b, c, d, e, f, g, h, i = m
    squares = [1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i]
    parts = [(squares[0], h - f, c - g, d - b), (h - f, squares[1], d + b, c + g), (c - g, d + b, squares[2], h + f), (d - b, c + g, h + f, squares[3])]
    most = F.greatest(*squares)
    arrays = [F.array(*p) for p in parts]
    q = F.when(squares[0] == most, arrays[0]).when(squares[1] == most, arrays[1]).when(squares[2] == most, arrays[2]).otherwise(arrays[3])
    size = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x)) * F.when(q[0] < 0, -1.0).otherwise(1.0)
    return F.transform(q, lambda x: x / size)


def _unit(v: list[Column]) -> list[Column]:
    size = F.nullif(G.norm(v), F.lit(0.0))
    return [x / size for x in v]


def with_hand_pose(df: DataFrame, points: str, side: str, out: str, at: str = "palm") -> DataFrame:
    """out: the pose (xyz + quaternion) of a hand of 21 landmarks, 63 numbers; side is a column, 0 for left. The axes are the
    hand's right, up and forward, mirrored for a left hand. at: 'palm', the mean of the wrist and four knuckles, or 'wrist'.
    All points zero give a zero position, and a hand without a direction keeps its position, both with the identity."""
    k = F.col(points)
    from_wrist = lambda i: [a - b for a, b in zip(G.landmark(k, i), G.landmark(k, 0), strict=True)]
    long, up = from_wrist(9), G.cross(from_wrist(5), from_wrist(17))
    df = df.withColumn("_long", F.array(*long)).withColumn("_up", F.array(*up))
    size = lambda c: G.norm(G.parts(F.col(c), 0, 3))
    df = df.withColumn("_f", F.array(*_unit(G.parts(F.col("_long"), 0, 3)))).withColumn("_u", F.array(*_unit(G.parts(F.col("_up"), 0, 3))))
    df = df.withColumn("_r", F.array(*_unit(G.cross(G.parts(F.col("_f"), 0, 3), G.parts(F.col("_u"), 0, 3)))))
    df = df.withColumn("_v", F.array(*G.cross(G.parts(F.col("_r"), 0, 3), G.parts(F.col("_f"), 0, 3))))
    f, r, v = (G.parts(F.col(c), 0, 3) for c in ("_f", "_r", "_v"))
    sign = F.when(F.col(side) == 0, 1.0).otherwise(-1.0)
    df = df.withColumn("_m", F.array(*[x for k in range(3) for x in (sign * r[k], -sign * v[k], f[k])]))
    q = matrix_to_quaternion([F.col("_m")[k] for k in range(9)])
    none = F.forall(k, lambda x: F.abs(x) <= 1e-8)
    place = F.slice(k, 1, 3) if at == "wrist" else G.hand_centre(k)
    zero, one = F.array(*[F.lit(0.0)] * 3), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))
    pose = F.when(none, F.concat(zero, one)).when((size("_long") < 1e-6) | (size("_up") < 1e-6), F.concat(place, one)).otherwise(F.concat(place, q))
    return df.withColumn(out, F.when(F.size(k) == 63, pose)).drop("_long", "_up", "_f", "_u", "_r", "_v", "_m")


def palm_axes(palm: Column, wrist: Column, normal: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Unit axes of a palm: z along its normal, y across the line from the palm to the wrist, x across both, away from the
    wrist. Null where the normal is zero or lies along that line."""
    line = [a - b for a, b in zip(G.parts(wrist, 0, 3), G.parts(palm, 0, 3), strict=True)]
    z = _unit(G.parts(normal, 0, 3))
    y = _unit(G.cross(line, z))
    return G.cross(y, z), y, z
