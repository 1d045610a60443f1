"""Batched SE(3) helpers in numpy for the chunk pipelines: arrays (..., 7) of xyz + quaternion (w x y z)."""

from __future__ import annotations

import numpy as np

from framelake.schema import INVALID, INVALID_FROM


def unit(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=-1, keepdims=True)
    if (n == 0).any():
        raise ValueError("zero quaternion")
    return q / n


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v, w = a[..., 1:], b[..., 1:]
    s, t = a[..., :1], b[..., :1]
    return np.concatenate([s * t - (v * w).sum(-1, keepdims=True), s * w + t * v + np.cross(v, w)], -1)


def turn(q: np.ndarray, x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Vectors turned by unit quaternions."""
    v = -q[..., 1:] if inverse else q[..., 1:]
    t = 2 * np.cross(np.broadcast_to(v, np.broadcast_shapes(v.shape, x.shape)), x)
    return x + q[..., :1] * t + np.cross(np.broadcast_to(v, t.shape), t)


def reframe(frame: np.ndarray, chunk: np.ndarray, inverse: bool = True) -> np.ndarray:
    """inverse(frame) @ chunk, or frame @ chunk. frame is (n, 7); chunk is (n, T, 7) of poses or (n, T, 3) of points."""
    q, x = unit(frame[:, None, 3:]), frame[:, None, :3]
    if chunk.shape[-1] == 3:
        return turn(q, chunk - x, True) if inverse else turn(q, chunk) + x
    p, r = chunk[..., :3], unit(chunk[..., 3:])
    if inverse:
        back = np.concatenate([q[..., :1], -q[..., 1:]], -1)
        return np.concatenate([turn(q, p - x, True), multiply(np.broadcast_to(back, r.shape), r)], -1)
    return np.concatenate([turn(q, p) + x, multiply(np.broadcast_to(q, r.shape), r)], -1)


def resample(a: np.ndarray, length: int) -> np.ndarray:
    """(n, T, D) to (n, length, D), linear."""
    at = np.linspace(0, a.shape[1] - 1, length)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, a.shape[1] - 1)
    return a[:, low] + (a[:, high] - a[:, low]) * (at - low)[:, None]


def resample_pose(a: np.ndarray, length: int) -> np.ndarray:
    """(n, T, 7): positions linear, rotations by SLERP the short way; a chunk with an invalid coordinate becomes INVALID."""
    at = np.linspace(0, a.shape[1] - 1, length)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, a.shape[1] - 1)
    share = (at - low)[:, None]
    bad = (np.abs(a) >= INVALID_FROM).any(axis=(1, 2))
    safe = np.where(bad[:, None, None], np.array([0, 0, 0, 1, 0, 0, 0.0]), a)
    q, r = unit(safe[:, low, 3:]), unit(safe[:, high, 3:])
    d = (q * r).sum(-1, keepdims=True)
    angle = np.arccos(np.clip(np.abs(d), 0, 1))
    s = np.sin(angle)
    near = s < 1e-9
    one = np.where(near, 1 - share, np.sin((1 - share) * angle) / np.where(near, 1, s))
    two = np.where(near, share, np.sin(share * angle) / np.where(near, 1, s)) * np.where(d < 0, -1, 1)
    out = np.concatenate([resample(safe[..., :3], length), unit(one * q + two * r)], -1)
    out[bad] = INVALID
    return out


def to_matrix(q: np.ndarray) -> np.ndarray:
    return np.stack([turn(q, np.broadcast_to(e, (*q.shape[:-1], 3))) for e in np.eye(3)], -1)


def encode(pose: np.ndarray, mode: str) -> np.ndarray:
    """xyz + quaternion as it is ('quat'), with yaw, pitch and roll ('ypr') or with two matrix columns ('6d')."""
    if mode == "quat":
        return pose
    m = to_matrix(unit(pose[..., 3:]))
    if mode == "6d":
        return np.concatenate([pose[..., :3], m[..., 0], m[..., 1]], -1)
    if mode != "ypr":
        raise ValueError(f"unknown rotation mode {mode!r}")
    ypr = np.stack([np.arctan2(m[..., 1, 0], m[..., 0, 0]), np.arcsin(np.clip(-m[..., 2, 0], -1, 1)), np.arctan2(m[..., 2, 1], m[..., 2, 2])], -1)
    return np.concatenate([pose[..., :3], ypr], -1)


def decode(a: np.ndarray, mode: str) -> np.ndarray:
    """Back from encode() to xyz + quaternion with w >= 0."""
    if mode == "quat":
        return a
    if mode == "ypr":
        c, s = np.cos(a[..., 3:6] / 2), np.sin(a[..., 3:6] / 2)
        (cy, cp, cr), (sy, sp, sr) = np.moveaxis(c, -1, 0), np.moveaxis(s, -1, 0)
        q = np.stack([cy * cp * cr + sy * sp * sr, cy * cp * sr - sy * sp * cr, cy * sp * cr + sy * cp * sr, sy * cp * cr - cy * sp * sr], -1)
    else:
        x = a[..., 3:6] / np.maximum(np.linalg.norm(a[..., 3:6], axis=-1, keepdims=True), 1e-8)
        y = a[..., 6:9] - (x * a[..., 6:9]).sum(-1, keepdims=True) * x
        y = y / np.maximum(np.linalg.norm(y, axis=-1, keepdims=True), 1e-8)
        q = from_matrix(np.stack([x, y, np.cross(x, y)], -1))
    return np.concatenate([a[..., :3], np.where(q[..., :1] < 0, -q, q)], -1)


def from_matrix(m: np.ndarray) -> np.ndarray:
    """Unit quaternions: the largest of the four magnitudes first, the signs from the off-diagonal sums and differences."""
    d = np.stack([m[..., 0, 0], m[..., 1, 1], m[..., 2, 2]], -1)
    t = d.sum(-1, keepdims=True)
    square = np.concatenate([1 + t, 1 + 2 * d - t], -1)
    k = square.argmax(-1)
    low = np.stack([m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1]], -1)
    high = np.stack([m[..., 1, 0] + m[..., 0, 1], m[..., 0, 2] + m[..., 2, 0], m[..., 2, 1] + m[..., 1, 2]], -1)
    a, b, c = (high[..., i] for i in range(3))
    s = [square[..., i] for i in range(4)]
    w = np.stack([s[0], low[..., 0], low[..., 1], low[..., 2]], -1)
    x = np.stack([low[..., 0], s[1], a, b], -1)
    y = np.stack([low[..., 1], a, s[2], c], -1)
    z = np.stack([low[..., 2], b, c, s[3]], -1)
    all_four = np.stack([w, x, y, z], -2)
    return unit(np.take_along_axis(all_four, k[..., None, None], -2)[..., 0, :])
