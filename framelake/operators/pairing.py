"""Nearest partners of whole sequences by dynamic time warping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import blocks as B
from framelake.sources.scratch import steps

BLOCK = 2048  # rows on each side of a task's product
STRIPE = 64  # left rows whose nearest right rows step by step are looked up at once
FIRST = 16  # right rows, the nearest step by step, whose paths give a left row its first bound
TILE = 32, 256  # left and right rows whose paths are followed at once
CHUNK = 2048  # single pairs whose paths are followed at once
STOPS = 0.6, 0.8  # shares of the way at which paths that are too long already are given up


class _Paths:
    """Best paths of many pairs at once, one step along the diagonal after the other: the cells of a step depend only on those
    of the two steps before, and are one operation. a and b are (rows, D, ...) from _rows(); their last axes broadcast to the
    pairs. Steps whose number is even like the band hold band + 1 cells (wide), the others band (narrow)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length: int, band: int) -> None:
        self.a, self.b, self.length, self.band, self.at = a, b, length, band, -1
        shape = np.broadcast_shapes(a.shape[2:], b.shape[2:])
        self.wide, self.narrow = np.full((band + 1, *shape), np.inf, a.dtype), np.full((band + 2, *shape), np.inf, a.dtype)
        self._middle(-2)[...] = 0.0
        self._room()

    def _room(self) -> None:
        self.cell, self.least = np.empty_like(self.wide), np.empty_like(self.wide)

    def _middle(self, step: int) -> np.ndarray:
        """The cell on the diagonal in an even step."""
        return self.narrow[(self.band + 1) // 2] if (step + self.band) % 2 else self.wide[self.band // 2]

    def to(self, stop: int) -> None:
        """Follows the paths up to a step."""
        for s in range(self.at + 1, stop + 1):
            wide = (s + self.band) % 2 == 0
            n = self.band + 1 if wide else self.band
            i = (s - n + 1) // 2  # the first row of a; the first one of b, whose rows go backwards, is s - i
            a, b = self.a[self.band + 1 + i :][:n], self.b[self.band + self.length - s + i :][:n]
            cell, least = self.cell[:n], self.least[:n]
            np.subtract(a[:, 0], b[:, 0], out=cell)
            np.multiply(cell, cell, out=cell)
            for d in range(1, a.shape[1]):
                np.subtract(a[:, d], b[:, d], out=least)
                np.multiply(least, least, out=least)
                np.add(cell, least, out=cell)
            before, own = (self.narrow, self.wide) if wide else (self.wide, self.narrow[1:-1])
            np.minimum(before[:-1], before[1:], out=least)
            np.minimum(least, own, out=least)
            np.add(cell, least, out=own)
        self.at = stop

    def bound(self) -> np.ndarray:
        """What no path can be below, given the steps so far."""
        return np.minimum(self.wide.min(0), self.narrow.min(0))

    def kept(self, a: np.ndarray, b: np.ndarray, flat: np.ndarray) -> None:
        """Goes on with some pairs only: their rows, and their places among all."""
        self.a, self.b = a, b
        self.wide, self.narrow = (np.take(v.reshape(len(v), -1), flat, axis=1, mode="clip") for v in (self.wide, self.narrow))
        self._room()

    def ends(self) -> np.ndarray:
        self.to(2 * self.length - 2)
        return self._middle(self.at)


def _rows(x: np.ndarray, band: int, side: int) -> np.ndarray:
    """Sequences (n, T, D) as (rows, D, n) between rows that no path enters; those of the right side backwards."""
    out = np.full((x.shape[1] + 2 * band + 2, x.shape[2], len(x)), side * np.inf, x.dtype)
    out[band + 1 : band + 1 + x.shape[1]] = x.transpose(1, 2, 0)[::side]
    return out


def warped(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Squared distance of each pair of sequences (n, T, D) along the best warping path within `band` steps of the diagonal."""
    if not a.shape[1]:
        return np.zeros(len(a))
    cut = [slice(k, k + CHUNK) for k in range(0, len(a), CHUNK)]
    return np.concatenate([_Paths(_rows(a[c], band, 1), _rows(b[c], band, -1), a.shape[1], band).ends() for c in cut] or [np.zeros(0)])


def envelope(b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest values of sequences (n, T, D) within `band` steps of each step."""
    low, high = b.copy(), b.copy()
    for s in range(1, min(band, b.shape[1] - 1) + 1):
        for own, other in ((slice(s, None), slice(None, -s)), (slice(None, -s), slice(s, None))):
            np.minimum(low[:, own], b[:, other], out=low[:, own])
            np.maximum(high[:, own], b[:, other], out=high[:, own])
    return low, high


def lower_bound(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(n, m): what no warping path of a[i] with the sequence inside envelope j can be below."""
    out = np.zeros((len(a), len(low)))
    for t in range(a.shape[1]):
        over = np.maximum(a[:, None, t] - high[None, :, t], low[None, :, t] - a[:, None, t])
        out += (np.maximum(over, 0.0) ** 2).sum(-1)
    return out


def _outside(a: np.ndarray, low: np.ndarray, high: np.ndarray, later: int) -> tuple[np.ndarray, np.ndarray]:
    """lower_bound() of rows of all pairs, and its part from row `later` on."""
    total = np.zeros((a.shape[2], low.shape[2]), a.dtype)
    part, room = total, np.empty_like(total)
    for t in reversed(range(len(a))):
        for d in range(a.shape[1]):
            at = a[t, d][:, None]
            np.maximum(at, low[t, d], out=room)
            np.minimum(room, high[t, d], out=room)
            np.subtract(at, room, out=room)
            np.multiply(room, room, out=room)
            np.add(total, room, out=total)
        if t == later:
            part = total.copy()
    return total, part if later < len(a) else np.zeros_like(total)


def _single(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Both sides in single precision, moved and scaled alike, with the scale and `off`: a root of a distance is wrong by
    less than off and a share of off, since the roots along one path keep the triangle inequality."""
    middle = (x.mean((0, 1)) + y.mean((0, 1))) / 2
    x, y = x - middle, y - middle
    most = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    scale = 2.0 ** np.ceil(np.log2(most)) if most > 0 else 1.0
    return (x / scale).astype(np.float32), (y / scale).astype(np.float32), scale, 2.0**-20 * np.sqrt(x.shape[1] * x.shape[2]) * max(1.0, np.sqrt(x.shape[1] / 64))


def _candidates(x: np.ndarray, y: np.ndarray, best: np.ndarray, band: int):  # noqa: ANN202
    """For stripes of rows of x: pairs (i, j), all those among them that can be nearest, and how many paths were begun for
    each row of the stripe. best holds what each row has reached elsewhere."""
    length = x.shape[1]
    x, y, scale, off = _single(x, y)
    slack = lambda v: (np.sqrt(v) * (1 + off) + off) ** 2
    best = best / scale**2
    a, b = _rows(x, band, 1), _rows(y, band, -1)
    ends = [v.transpose(1, 2, 0).copy() for v in envelope(y, band)]
    stops = [int(share * (2 * length - 2)) for share in STOPS]
    later = (stops[0] + band) // 2 + 1  # rows that no path has entered at the first stop
    for at in range(0, len(x), TILE[0]):
        left = slice(at, min(at + TILE[0], len(x)))
        own, near, begun = slack(best[left]), [], np.zeros(left.stop - at, np.int64)
        for to in range(0, len(y), TILE[1]):
            right = slice(to, min(to + TILE[1], len(y)))
            shape = left.stop - at, right.stop - to
            least, rest = _outside(a[band + 1 : band + 1 + length, :, left], *(v[..., right] for v in ends), later)
            some = least <= own[:, None]
            begun += some.sum(1)
            flat = np.flatnonzero(some)
            if 2 * len(flat) > some.size:
                paths = _Paths(a[..., left, None], b[..., None, right], length, band)
                paths.to(stops[0])
                flat = np.flatnonzero(some & (paths.bound() + rest <= own[:, None]))
            else:
                paths = None
            for one in range(0, len(flat), CHUNK if paths is None else max(len(flat), 1)):
                flats = flat[one : one + CHUNK] if paths is None else flat
                i, j = np.divmod(flats, shape[1])
                ai, bj = (np.take(v, k, axis=2, mode="clip") for v, k in ((a[..., left], i), (b[..., right], j)))
                if paths is None:
                    now = _Paths(ai, bj, length, band)
                    now.to(stops[0])
                else:
                    now = paths
                    now.kept(ai, bj, flats)
                for stop in stops[1:]:
                    now.to(stop)
                    go = np.flatnonzero(now.bound() <= own[i])
                    i, j = i[go], j[go]
                    now.kept(*(np.take(v, go, axis=2, mode="clip") for v in (now.a, now.b)), go)
                d = now.ends().astype(float)
                np.minimum.at(own, i, slack(slack(d)))
                near.append((i, j + to, d))
        i, j, d = (np.concatenate(v) for v in zip(*near, strict=True))
        go = d <= own[i]
        yield i[go] + at, j[go], begun


def _sequences(s: pd.Series) -> np.ndarray:
    x = B.stacked(s)
    return x if x.ndim == 3 else x[..., None]


def nearest_by_warping(left: DataFrame, right: DataFrame, by: str, key: str, seq: str, band: int, block: int = BLOCK) -> DataFrame:
    """For each left row the right row of its group with the smallest warping distance, of equal ones the smallest key:
    by, key, other, distance, n_pairs (rows it was compared with) and n_warped (those of them for which a path was begun).

    seq is array<double> or array<array<double>>, all of one length within a group. The paths to the rows that are nearest
    step by step give each left row a first bound; envelopes give each pair a lower bound, and only pairs whose lower bound
    isn't above the best distance known get a path. Paths are followed in single precision and given up where they pass that
    distance by more than the error; those that remain are computed in double. Equal right sequences are compared once. All
    pairs of a group may need a path, so time grows with its square; a task holds two blocks. Sequences with values that
    aren't finite are further than all others. Null groups, keys and sequences take no part; a left row whose group has no
    right row has no partner and gives no row."""

    def sides(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(seq).alias("_x"))
        return B.hashed(rows.filter("_by IS NOT NULL AND _key IS NOT NULL AND _x IS NOT NULL"), block)

    a, b = sides(left), sides(right).select("_by", "_i", F.col("_key").alias("_other"), F.col("_x").alias("_y"))
    kinds = dict(a.dtypes)
    head = f"_by {kinds['_by']}, _key {kinds['_key']}"

    def direct(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(p), np.inf)
        if len(p) and len(q):
            x, y = _sequences(p["_x"]), _sequences(q["_y"])
            y = y[np.isfinite(y).all((1, 2))]
            finite = np.flatnonzero(np.isfinite(x).all((1, 2))) if len(y) else np.zeros(0, int)
            for at in range(0, len(finite), STRIPE):
                rows = finite[at : at + STRIPE]
                u, v = x[rows].reshape(len(rows), -1), y.reshape(len(y), -1)
                few = min(FIRST, len(y))
                near = np.argpartition((v * v).sum(1)[None] - 2 * (u @ v.T), few - 1, axis=1)[:, :few]
                out[rows] = warped(np.repeat(x[rows], few, axis=0), y[near.ravel()], band).reshape(near.shape).min(1)
        return pd.DataFrame({"_by": p["_by"], "_key": p["_key"], "bound": out}).iloc[: len(p) if len(q) else 0]

    def nearest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=["_by", "_key", "distance", "other", "n_pairs", "n_warped"])
        q = q.sort_values("_other", ignore_index=True)
        x, y = _sequences(p["_x"]), _sequences(q["_y"])
        reached, other, warps = np.full(len(p), np.nan), np.full(len(p), -1), np.zeros(len(p), np.int64)
        some, those = np.isfinite(x).all((1, 2)), np.sort(np.unique(y.reshape(len(y), -1), axis=0, return_index=True)[1])
        those = those[np.isfinite(y[those]).all((1, 2))]
        rows = np.flatnonzero(some) if len(those) else np.zeros(0, int)
        other[np.setdiff1d(np.arange(len(p)), rows)] = 0
        if len(rows):
            done = 0
            for i, j, begun in _candidates(x[rows], y[those], p["bound"].to_numpy()[rows], band):
                warps[rows[done : done + len(begun)]] = begun
                done += len(begun)
                d = warped(x[rows[i]], y[those[j]], band)
                order = np.lexsort((j, d, i))
                i, first = np.unique(i[order], return_index=True)
                reached[rows[i]], other[rows[i]] = d[order][first], those[j[order][first]]
        found = other >= 0
        keys = q["_other"].to_numpy()[np.maximum(other, 0)]
        out = pd.DataFrame({"_by": p["_by"], "_key": p["_key"], "distance": reached, "other": pd.Series(keys, index=p.index).where(found, None), "n_pairs": len(q), "n_warped": warps})
        return out.astype({"other": object})

    with steps(left.sparkSession) as own:
        a, b = own.written(a), own.written(b)
        visits = B.all_pairs(a, b)
        bounds = B.on_pairs(a, b, visits, direct, f"{head}, bound double").groupBy("_by", "_key").agg(F.min("bound").alias("bound"))
        found = B.on_pairs(a.join(bounds, ["_by", "_key"]), b, visits, nearest, f"{head}, distance double, other {kinds['_key']}, n_pairs long, n_warped long")
        first = F.min(F.when(F.col("other").isNotNull(), F.struct(F.coalesce("distance", F.lit(float("nan"))).alias("distance"), "other")))
        out = found.groupBy("_by", "_key").agg(first.alias("_f"), F.sum("n_pairs").alias("n_pairs"), F.sum("n_warped").alias("n_warped"))
        return own.result(out.select(F.col("_by").alias(by), F.col("_key").alias(key), F.col("_f.other").alias("other"), F.col("_f.distance").alias("distance"), "n_pairs", "n_warped"))
