"""Seeded permutations with exact counts, samples, cycles of loaders, key maps and incremental syncs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permuted(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with rank (from 0) in a seeded permutation of its keys, and n rows in all. Rows go to 65,536 bins by the head of their
    digest; bins are ranked inside and begin where the counts of those before end, so nothing is sorted as a whole."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_bin", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy(F.lit(0)).orderBy("_bin")  # at most a row for each bin
    counts = counts.select("_bin", (F.sum("_k").over(order) - F.col("_k")).alias("_start"), F.sum("_k").over(Window.partitionBy(F.lit(0))).alias("n"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key)))
    out = ranked.join(F.broadcast(counts), "_bin").withColumn("rank", F.col("_start") + F.col("_r") - 1)
    return out.drop("_h", "_bin", "_r", "_start")


def share_of(n: Column, share: float) -> Column:
    """max(1, int(n * share)): a share is never empty."""
    return F.greatest(F.lit(1), F.floor(n * share).cast("long"))


def by_mode(ranked: DataFrame, mode: str, valid: float = 0.2, percent: float | None = None) -> DataFrame:
    """Rows of a permutation for one use: valid, train (the rest), total, or percent. Other modes are errors."""
    if mode == "total":
        return ranked
    if mode == "percent":
        if percent is None:
            raise ValueError("percent needs a share")
        return ranked.filter(F.col("rank") < share_of(F.col("n"), percent))
    if mode not in ("train", "valid"):
        raise ValueError(f"unknown mode {mode}")
    inside = F.col("rank") < share_of(F.col("n"), valid)
    return ranked.filter(inside if mode == "valid" else ~inside)


def sample(ranked: DataFrame, share: float, most: int) -> DataFrame:
    """ceil(n * share) rows, at least one, at most all and `most`, without replacement."""
    want = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") * share)), F.col("n"), F.lit(most))
    return ranked.filter(F.col("rank") < want)


def window_of(ranked: DataFrame, start: int, size: int) -> DataFrame:
    """size rows of the permutation from start on, wrapping around; each at most once."""
    return ranked.filter(F.pmod(F.col("rank") - F.lit(start), F.col("n")) < F.least(F.lit(size), F.col("n")))


def cycled(loaders: Sequence[DataFrame], index: str = "rank") -> DataFrame:
    """A row for each step of the longest loader: columns of all loaders side by side, the shorter ones again from their start.
    Each loader has `index` from 0 and its length n; its other columns must be distinct."""
    longest = max(range(len(loaders)), key=lambda k: loaders[k].agg(F.max("n")).first()[0] or 0)
    out = loaders[longest].withColumn("step", F.col(index)).drop(index, "n")
    for k, other in enumerate(loaders):
        if k != longest:
            n = other.agg(F.max("n").alias("_n"))
            out = out.crossJoin(F.broadcast(n)).withColumn(index, F.pmod("step", F.col("_n"))).join(other.drop("n"), index).drop(index, "_n")
    return out


def in_order(column: Column, names: Sequence[str]) -> Column:
    """Place of a value in a list of categories; values that aren't listed come after all."""
    at = F.array_position(F.array(*map(F.lit, names)), column)
    return F.when(column.isNull() | (at == 0), len(names)).otherwise(at - 1).cast("int")


def by_key_map(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Columns under the names of a key map (name to storage key), in its order; all others go."""
    return df.select(*[F.col(old).alias(new) for new, old in keys.items()])


# The keys of alignment training, each with its kind and where it is stored.
ALIGNMENT = {
    "actions_cartesian": ("action_keys", "actions_cartesian"),
    "dino_front_1": ("proprio_keys", "dino.front_img_1"),
    "annotations": ("annotation_keys", "annotations"),
}
#: kinds that a view of actions alone leaves out
SEEN_OR_SAID = ("camera_keys", "annotation_keys")


def by_kinds(df: DataFrame, keys: dict[str, tuple[str, str]], index: Sequence[str], leave_out: Sequence[str] = ()) -> DataFrame:
    """index and the columns of a key map (name to kind and storage key) under their names, but for kinds that are left out."""
    return df.select(*index, *[F.col(f"`{at}`").alias(name) for name, (kind, at) in keys.items() if kind not in leave_out])


def without(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.drop(*keys)


def keys_of(schematic: DataFrame, kind: str | None = None, embodiment: str | None = None) -> DataFrame:
    """Rows of a schematic (embodiment, key, storage_key, kind, shape) of one kind, one embodiment, or both."""
    tests = [F.col(c) == v for c, v in (("kind", kind), ("embodiment", embodiment)) if v is not None]
    return schematic.filter(reduce(Column.__and__, tests, F.lit(True)))


def to_names(rows: DataFrame, schematic: DataFrame) -> DataFrame:
    """rows (embodiment, storage_key) with their key; null where the schematic has none."""
    return rows.join(schematic.select("embodiment", "storage_key", "key"), ["embodiment", "storage_key"], "left")


def to_sync(remote: DataFrame, local: DataFrame, key: str, size: str) -> DataFrame:
    """Remote objects that aren't there locally with the same size."""
    return remote.join(local.select(key, size), [key, size], "left_anti")


def stale(path: Column, age_days: Column, most: float) -> Column:
    """The path, blank where its age is unknown or over `most` days."""
    return F.when(age_days.isNull() | (age_days > most), "").otherwise(path)


def projection(width: int, out: int, seed: int) -> list[list[float]]:
    """Orthonormal columns of a seeded Gaussian matrix (rows: `out` directions), the identity where width <= out."""
    import numpy as np

    if width <= out:
        return np.eye(width).tolist()
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, out)))
    return (q * np.sign(np.diag(r))).T.tolist()


def projected(x: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Products of an array with each row of a bounded matrix."""
    matrix = F.from_json(F.lit(json.dumps([list(r) for r in rows])), "array<array<double>>")
    return F.transform(matrix, lambda r: F.aggregate(F.zip_with(r, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
