"""Rows of a group against rows of the same group in pairs of blocks: a task gets two blocks, whatever the group's size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows on each side of a task's product
GRID = 256  # cells along each of the two coordinates that a group is cut by


def hashed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (_by, _key, ...) with _i, the number of a block of about `block` rows of the group."""
    sizes = rows.groupBy("_by").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    return rows.join(sizes, "_by").withColumn("_i", F.pmod(F.xxhash64("_key"), F.col("_blocks"))).drop("_blocks")


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_by, _i, _j) for all blocks of two sides."""
    a = left.groupBy("_by", "_i").agg(F.count(F.lit(1)).alias("_n")).select("_by", "_i")
    b = right.groupBy("_by", "_i").agg(F.count(F.lit(1)).alias("_n")).select("_by", F.col("_i").alias("_j"))
    return a.join(b, "_by")


def on_pairs(left: DataFrame, right: DataFrame, visits: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, keep: Column | None = None) -> DataFrame:
    """run on the left rows of block _i and the right rows of block _j of a group, for each row (_by, _i, _j) of visits. keep
    tells of a left row beside a row of visits whether the row is needed there. The pairs of blocks are dealt over all shuffle
    partitions: they are small and their work isn't, so they aren't coalesced by size."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.join(visits, ["_by", "_i"])
    a = (a if keep is None else a.filter(keep)).select(*left.columns, "_j")
    b = right.withColumnRenamed("_i", "_j").join(visits.select("_by", "_i", "_j"), ["_by", "_j"])
    b = b.select(F.col("_by").alias("_g"), F.col("_i").alias("_to"), F.col("_j").alias("_from"), *[c for c in right.columns if c not in ("_by", "_i")])
    a, b = a.repartition(parts, "_by", "_i", "_j"), b.repartition(parts, "_g", "_to", "_from")
    return a.groupBy("_by", "_i", "_j").cogroup(b.groupBy("_g", "_to", "_from")).applyInPandas(run, schema)


def stacked(s: pd.Series) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.array(s.tolist(), dtype=float)


def _widest(rows: DataFrame, vector: str) -> Column:
    """The index of the coordinate in which a group is widest."""
    n = rows.select(F.size(vector).alias("n")).head()
    spread = [F.max(F.col(vector)[k]) - F.min(F.col(vector)[k]) for k in range(n["n"] if n else 1)]
    spread = F.array(*spread)
    return F.greatest(F.array_position(spread, F.array_max(spread)).cast("int"), F.lit(1))


def spatial(rows: DataFrame, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """rows (_by, _key, x, y, ...) with _i: a group is cut by quantiles of the widest coordinate of x and of y into as many
    cells as it has blocks, up to GRID x GRID; a cell with more rows than a block is cut by hash, so no block grows."""
    axes = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_rows"), _widest(rows, x).alias("_ax"), _widest(rows, y).alias("_ay"))
    df = rows.join(axes, "_by").withColumn("_u", F.element_at(x, F.col("_ax"))).withColumn("_v", F.element_at(y, F.col("_ay")))
    shares = F.array(*[F.lit(k / GRID) for k in range(1, GRID)])
    edges = df.groupBy("_by").agg(F.percentile_approx("_u", shares, 10_000).alias("_eu"), F.percentile_approx("_v", shares, 10_000).alias("_ev"))
    side = F.least(F.lit(GRID), F.ceil(F.sqrt(F.col("_rows") / block))).cast("long")
    # of the edges a group keeps one less than it has cells on a side
    few = lambda e: F.expr(f"transform(filter(sequence(0L, _side), k -> k BETWEEN 1 AND _side - 1), k -> element_at({e}, CAST(ceil(k * {GRID} / _side) AS INT)))").alias(e)
    edges = edges.join(axes.select("_by", side.alias("_side")), "_by").select("_by", few("_eu"), few("_ev"))
    cell = lambda c, e: F.expr(f"CAST(size(filter({e}, q -> q <= {c})) AS BIGINT)")
    df = df.join(edges, "_by")
    df = df.withColumn("_cell", cell("_u", "_eu") * GRID + cell("_v", "_ev"))
    full = df.groupBy("_by", "_cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    df = df.join(full, ["_by", "_cell"])
    number = F.shiftleft(F.col("_cell"), 32) + F.pmod(F.xxhash64("_key"), F.col("_parts"))
    return df.select(*rows.columns, number.alias("_i"))


def gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Least distance of two boxes in the maximum norm, from the arrays of their lower and upper ends."""
    apart = F.zip_with(F.zip_with(low_b, high_a, lambda p, q: p - q), F.zip_with(low_a, high_b, lambda p, q: p - q), lambda p, q: F.greatest(p, q))
    return F.greatest(F.array_max(apart), F.lit(0.0))
