"""Rigid-body geometry as column expressions. Poses are arrays of doubles: xyz + quaternion (w x y z), 7 wide; xyz + yaw,
pitch, roll (intrinsic ZYX), 6; xyz + the first two columns of the rotation, 9. Arguments should be plain columns: a
column is used many times in a formula, so compute it in a step of its own first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def parts(a: Column, start: int, n: int) -> list[Column]:
    return [F.get(a, F.lit(start + k)) for k in range(n)]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit_quaternion(q: Column, start: int = 3) -> Column:
    """Normalised, with w >= 0; null for a zero quaternion."""
    v = parts(q, start, 4)
    size = F.nullif(norm(v), F.lit(0.0)) * F.when(v[0] < 0, -1.0).otherwise(1.0)
    return F.array(*[x / size for x in v])


def xyzw_to_wxyz(q: Column) -> Column:
    return F.array(*[F.get(q, F.lit(k)) for k in (3, 0, 1, 2)])


def wxyz_to_xyzw(q: Column) -> Column:
    return F.array(*[F.get(q, F.lit(k)) for k in (1, 2, 3, 0)])


def quaternion_to_ypr(q: Column) -> Column:
    """Of a unit quaternion."""
    w, x, y, z = parts(q, 0, 4)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.array(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), F.asin(sine), F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))


def ypr_to_quaternion(a: Column) -> Column:
    (cy, cp, cr), (sy, sp, sr) = ([f(v / 2) for v in parts(a, 0, 3)] for f in (F.cos, F.sin))
    return F.array(cy * cp * cr + sy * sp * sr, cy * cp * sr - sy * sp * cr, cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr)


def quaternion_to_matrix(q: Column) -> Column:
    """Nine numbers, row by row, of a unit quaternion."""
    w, x, y, z = parts(q, 0, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    )


def matrix_to_sixd(m: Column) -> Column:
    """The first two columns."""
    return F.array(*[F.get(m, F.lit(k)) for k in (0, 3, 6, 1, 4, 7)])


def first_axis(c: Column) -> Column:
    """First axis of the Gram-Schmidt frame of six numbers."""
    a = parts(c, 0, 3)
    return F.array(*[x / F.greatest(norm(a), F.lit(1e-8)) for x in a])


def second_axis(c: Column, first: Column) -> Column:
    a, b = parts(first, 0, 3), parts(c, 3, 3)
    rest = [y - dot(a, b) * x for x, y in zip(a, b, strict=True)]
    return F.array(*[x / F.greatest(norm(rest), F.lit(1e-8)) for x in rest])


def third_axis(first: Column, second: Column) -> Column:
    return F.array(*cross(parts(first, 0, 3), parts(second, 0, 3)))


def multiply(a: Column, b: Column) -> Column:
    """Product of two quaternions."""
    (w, x, y, z), (p, q, r, s) = parts(a, 0, 4), parts(b, 0, 4)
    return F.array(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def conjugate(q: Column) -> Column:
    w, x, y, z = parts(q, 0, 4)
    return F.array(w, -x, -y, -z)


def rotated(m: Column, v: Column, inverse: bool = False) -> Column:
    """A vector turned by a matrix of nine numbers, or by its transpose."""
    rows = [parts(m, 3 * k, 3) for k in range(3)]
    if inverse:
        rows = [list(r) for r in zip(*rows, strict=True)]
    return F.array(*[dot(r, parts(v, 0, 3)) for r in rows])


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def pixel(p: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel of a point in the camera's frame; null behind the camera."""
    x, y, z = parts(p, 0, 3)
    return F.when(z > 0, F.array(fx * x / z + cx, fy * y / z + cy))


def wrapped(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def gaze(yaw: Column, pitch: Column, depth: Column) -> Column:
    """Where a gaze of that depth ends."""
    v = [F.tan(yaw), F.tan(pitch), F.lit(1.0)]
    return F.array(*[depth * x / norm(v) for x in v])


def head_axes(p: Column) -> Column:
    x, y, z = parts(p, 0, 3)
    return F.array(-y, -z, x)


def landmark(k: Column, i: int) -> list[Column]:
    return parts(k, 3 * i, 3)


def hand_centre(k: Column) -> Column:
    """Mean of the wrist and the four knuckles of 21 landmarks."""
    points = [landmark(k, i) for i in (0, 5, 9, 13, 17)]
    return F.array(*[sum((p[c] for p in points[1:]), points[0][c]) / 5 for c in range(3)])


def hand_axis(k: Column, which: str) -> Column:
    """Unit axis of a hand, null where it is degenerate: forward from the wrist to the middle knuckle, or up from the palm."""
    from_wrist = lambda i: [a - b for a, b in zip(landmark(k, i), landmark(k, 0), strict=True)]
    v = from_wrist(9) if which == "forward" else cross(from_wrist(5), from_wrist(17))
    return F.when(norm(v) >= 1e-6, F.array(*[x / norm(v) for x in v]))


def packed(values: Sequence[Column], width: int = 32) -> Column:
    """Arrays joined and filled up with zeros."""
    joined = F.concat(*values)
    return F.concat(joined, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(joined)))


def unpacked(a: Column, widths: Sequence[int]) -> list[Column]:
    at = [sum(widths[:k]) + 1 for k in range(len(widths))]
    return [F.slice(a, i, n) for i, n in zip(at, widths, strict=True)]
