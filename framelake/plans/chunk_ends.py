"""Values of action chunks where no interpolation stands between them and SQL: at their first and last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import embodiments as E
from framelake.plans.arrays import _poses
from framelake.plans.registry import query

#: first number of each pose in a vector
_AT = {"lo": 1, "ro": 8, "lc": 15, "rc": 22, "head": 29}


def _sql(last: int) -> str:
    """Poses of the anchor frame, and as columns ending in 9 those of the frame `last` later or of the episode's end."""
    cols = []
    for name, k in _AT.items():
        q = [f"v[{k + 3 + i}]" for i in range(4)]
        size = "sqrt(" + "+".join(f"{x}*{x}" for x in q) + ")"
        cols += [f"v[{k + i}] AS {name}_{c}" for i, c in enumerate("xyz")] + [f"{x}/{size} AS {name}_{c}" for x, c in zip(q, ("qw", "qx", "qy", "qz"), strict=True)]
    names = [f"{n}_{c}" for n in _AT for c in ("x", "y", "z", "qw", "qx", "qy", "qz")]
    return f"""e AS (
  SELECT label AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT episode, t, n, v, {", ".join(cols)} FROM e),
b AS (SELECT a.*, {", ".join(f"z.{c} AS {c}9" for c in names)}, z.v AS v9 FROM p a JOIN p z ON z.episode = a.episode AND z.t = least(a.t + {last}, a.n - 1))"""


def _into(q: list[str], origin: list[str], x: list[str]) -> list[str]:
    """A point seen from a frame with this unit quaternion and origin."""
    w, i, j, k = q
    d = [f"({a} - {b})" for a, b in zip(x, origin, strict=True)]
    rows = [
        (f"1-2*({j}*{j}+{k}*{k})", f"2*({i}*{j}+{w}*{k})", f"2*({i}*{k}-{w}*{j})"),
        (f"2*({i}*{j}-{w}*{k})", f"1-2*({i}*{i}+{k}*{k})", f"2*({j}*{k}+{w}*{i})"),
        (f"2*({i}*{k}+{w}*{j})", f"2*({j}*{k}-{w}*{i})", f"1-2*({i}*{i}+{j}*{j})"),
    ]
    return ["(" + " + ".join(f"({m})*{y}" for m, y in zip(r, d, strict=True)) + ")" for r in rows]


def _pose(name: str, end: str = "") -> tuple[list[str], list[str]]:
    return [f"{name}_q{c}{end}" for c in "wxyz"], [f"{name}_{c}{end}" for c in "xyz"]


def _by_matrix(m: E.Matrix, x: list[str]) -> list[str]:
    """A point seen from a camera that stands by a 4x4 matrix: its columns, turned, of the point without the origin."""
    d = [f"({a} - ({r[3]}))" for a, r in zip(x, m, strict=False)]
    return ["(" + " + ".join(f"({m[r][c]})*{d[r]}" for r in range(3)) + ")" for c in range(3)]


def _columns(parts: dict[str, list[str]]) -> str:
    return ", ".join(f"round({e}, 4) AS {name}_{c}" for name, xyz in parts.items() for c, e in zip("xyz", xyz, strict=True))


def _three(name: str, a: Column, first: int = 0) -> list[Column]:
    return [F.round(a[first + k], 4).alias(f"{name}_{c}") for k, c in enumerate("xyz")]


_LEFT, _RIGHT = E.EXTRINSICS["x5Dec13_2"]
_ENDS = {"left0": _by_matrix(_LEFT, _pose("lc")[1]), "left9": _by_matrix(_LEFT, _pose("lc", "9")[1]), "right9": _by_matrix(_RIGHT, _pose("rc", "9")[1]), "state": _by_matrix(_RIGHT, _pose("ro")[1])}


@query("B1 B10 B11 P1 P4 P5 G10", f"WITH {_sql(44)} SELECT episode, t, {_columns(_ENDS)}, round(abs(v9[41]), 4) AS left_grip, round(abs(v[42]), 4) AS right_grip FROM b")
def robot_chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    """Commands in each arm's camera frame, by the extrinsics."""
    df = E.action_chunks(_poses(spark, d), E.pipeline("eva", "cartesian_6d"))
    first, last = F.col("actions")[0], F.col("actions")[99]
    return df.select("episode", "t", *_three("left0", first), *_three("left9", last), *_three("right9", last, 10), *_three("state", F.col("state"), 10), F.round(last[9], 4).alias("left_grip"), F.round(F.col("state")[19], 4).alias("right_grip"))


_HEAD = _pose("head")
_OWN = {"last": _into(*_HEAD, _pose("lo", "9")[1]), "wrist": _into(*_pose("lo"), _pose("lo", "9")[1])}


@query("B4 B5 B6 B11 P1 P5", f"WITH {_sql(27)} SELECT episode, t, {_columns({'head': _OWN['last'], 'wrist': _OWN['wrist'], 'back': _OWN['last'], 'right': _into(*_HEAD, _pose('ro', '9')[1])})} FROM b")
def human_chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    """Last steps of the head's frame, of the wrist's frame, and reverted from there to the head's frame."""
    poses = _poses(spark, d)
    head = E.action_chunks(poses, E.pipeline("aria", "cartesian")).select("episode", "t", *_three("head", F.col("actions")[99]))
    wrist = E.revert_chunks(E.action_chunks(poses, E.pipeline("aria", "cartesian_wristframe_6d")), "6d", grip=False)
    last = F.col("reverted")[99]
    return head.join(wrist.select("episode", "t", *_three("wrist", F.col("actions")[99]), *_three("back", last), *_three("right", last, 6)), ["episode", "t"])


_TIP = [f"v9[{k}]" for k in (13, 14, 15)]


@query("B7 B8 B9 B11 P5", f"""WITH {_sql(29)} SELECT episode, t, {_columns({'wrist': _into(*_pose('lo'), _TIP), 'back': _into(*_HEAD, _TIP), 'head': _into(*_HEAD, _TIP), 'state': _into(*_pose('ro'), ['v[2]', 'v[3]', 'v[4]'])})} FROM b""")
def keypoint_chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    """A landmark of the last step seen from the wrist, reverted to the head's frame, and as the head's own pipeline has it."""
    poses = _poses(spark, d)
    wrist = E.revert_keypoint_chunks(E.action_chunks(poses, E.pipeline("mecka", "keypoints_wristframe_quat")), "quat")
    own = wrist.select("episode", "t", *_three("wrist", F.col("actions")[99], 7 + 12), *_three("back", F.col("reverted")[99], 12), *_three("state", F.col("state"), 70 + 7))
    head = E.action_chunks(poses, E.pipeline("mecka", "keypoints_headframe_ypr")).select("episode", "t", *_three("head", F.col("actions")[99], 6 + 12))
    return own.join(head, ["episode", "t"])
