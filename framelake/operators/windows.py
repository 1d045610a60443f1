"""Sequence operators on frame tables (episode, t, ...). Each needs one sort by (episode, t), which they share when chained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(by: str = "episode", order: str = "t") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def padded(chunk: Column, h: int, zero: Column | None = None) -> Column:
    """The array repeated at its end to h entries, or filled with zero."""
    return F.concat(chunk, F.array_repeat(F.element_at(chunk, -1) if zero is None else zero, h - F.size(chunk)))


def chunk(df: DataFrame, value: str, h: int, out: str = "chunk", limit: str | None = None, zero: Column | None = None) -> DataFrame:
    """The h values from each frame on; past the end the last one repeats. limit names a column with a frame that ends the
    chunk before it (null: none)."""
    got = F.collect_list(value).over(over().rowsBetween(0, h - 1))
    if limit:
        got = F.slice(got, 1, F.greatest(F.lit(1), F.least(F.lit(h), F.coalesce(F.col(limit) - F.col("t"), F.lit(h))).cast("int")))
    return df.withColumn("_c", got).withColumn(out, padded(F.col("_c"), h, zero)).drop("_c")


def strided(chunk: Column, stride: int, length: int) -> Column:
    """Every stride-th value, the last one repeated."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(chunk, F.least(i * stride, F.size(chunk) - 1)))


def pause_keep(df: DataFrame, still: Column) -> DataFrame:
    """keep: false from the second frame of each pause on. still tells for a frame whether all its signals moved less than
    epsilon since the frame before; null (the first frame) counts as moved."""
    df = df.withColumn("_p", F.coalesce(still, F.lit(False)))
    return df.withColumn("keep", ~(F.col("_p") & F.coalesce(F.lag("_p").over(over()), F.lit(False)))).drop("_p")


def moved_less(values: list[str], epsilon: float) -> Column:
    """Whether the L2 distance to the frame before is below epsilon."""
    square = sum(((F.col(v) - F.lag(v).over(over())) ** 2 for v in values), F.lit(0.0))
    return F.sqrt(square) < epsilon


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _point_step(now: Column, last: Column) -> Callable[[Column], Column]:
    """How far the point of a number moved."""
    return lambda i: _apart(F.slice(now, 3 * i + 1, 3), F.slice(last, 3 * i + 1, 3))


def moved_less_in_space(poses: dict[str, float], points: dict[str, float]) -> Column:
    """Whether all signals (column to epsilon) moved less than that since the frame before: each of the poses, arrays of
    numbers, by its L2 distance, and of each array of points (x y z x y z ...) the point that moved furthest, which sees
    fingers bend at a wrist at rest. Points that are null now or before, or aren't whole, are left out. Null in the first
    frame."""
    still = [_apart(F.col(c), F.lag(c).over(over())) < e for c, e in poses.items()]
    for c, epsilon in points.items():
        now, last = F.col(c), F.lag(c).over(over())
        whole = (F.size(now) % 3 == 0) & (F.size(now) > 0) & (F.size(now) == F.size(last))
        furthest = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(now) / 3) - 1, F.lit(0)).cast("int")), _point_step(now, last)))
        still.append(F.when(F.coalesce(whole, F.lit(False)), furthest < epsilon).otherwise(True))
    out = still[0]
    for s in still[1:]:
        out = out & s
    return out


def renumber(df: DataFrame, out: str = "kept_idx") -> DataFrame:
    return df.withColumn(out, (F.row_number().over(over()) - 1).cast("long"))


def fill(df: DataFrame, value: str, missing: Column) -> DataFrame:
    """Missing values from the last one before, else the first one after."""
    v = F.when(~missing, F.col(value))
    back = F.last(v, True).over(over().rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(v, True).over(over().rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(back, ahead))


def strict_window(df: DataFrame, valid: Column) -> DataFrame:
    """Each episode's first and last valid frame, and why it can't be used: no valid frame, or a gap inside."""
    df = df.withColumn("_v", valid)
    out = df.groupBy("episode").agg(F.min(F.when(F.col("_v"), F.col("t"))).alias("first"), F.max(F.when(F.col("_v"), F.col("t"))).alias("last"), F.count_if("_v").alias("n_valid"))
    why = F.when(F.col("n_valid") == 0, "no valid frame").when(F.col("n_valid") < F.col("last") - F.col("first") + 1, "gap")
    return out.withColumn("reject_reason", why)


def runs(df: DataFrame, value: str, least: int) -> DataFrame:
    """Stretches of at least `least` frames with one non-null value."""
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(over())) | F.col(value).isNull()
    df = df.withColumn("run", F.sum(changed.cast("long")).over(over().rowsBetween(Window.unboundedPreceding, 0)))
    out = df.filter(F.col(value).isNotNull()).groupBy("episode", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least)


def close_gaps(spans: DataFrame, most: float) -> DataFrame:
    """A span's end moves to the next one's start when that is less than `most` later."""
    after = F.lead("start_idx").over(over(order="start_idx"))
    gap = after - F.col("end_idx")
    return spans.withColumn("end_idx", F.when((gap > 0) & (gap < most), after).otherwise(F.col("end_idx")))


def valid_ahead(df: DataFrame, valid: Column, h: int) -> DataFrame:
    """Whether all of the h frames from here on are there and valid."""
    w = over().rowsBetween(0, h - 1)
    return df.withColumn("ok", F.every(valid).over(w) & (F.count(F.lit(1)).over(w) == h))


def stalls(df: DataFrame, at: str, least: float) -> DataFrame:
    """Time since the row before; stalled where it is at least `least`."""
    gap = F.col(at) - F.lag(at).over(over())
    return df.withColumn("gap", gap).withColumn("stalled", F.coalesce(gap >= least, F.lit(False)))
