"""Resampling of arrays to another length on the same time span."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schema import INVALID, INVALID_FROM


def linear(a: Column, length: int) -> Column:
    """length values on a uniform grid over the array; an array of one value repeats it."""
    last = (F.size(a) - 1).cast("double")

    def at(i: Column) -> Column:
        p = i * last / max(1, length - 1)
        low = F.floor(p).cast("int")
        return F.get(a, low) + (F.get(a, F.least(low + 1, F.size(a) - 1)) - F.get(a, low)) * (p - low)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def unwrapped(a: Column) -> Column:
    """Angles with jumps of more than half a turn taken out."""
    turn = lambda d: F.floor((d + math.pi) / (2 * math.pi)) * (2 * math.pi)
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.array(F.when(s["last"].isNull(), x).otherwise(x - turn(x - s["last"])))).alias("out"),
        F.when(s["last"].isNull(), x).otherwise(x - turn(x - s["last"])).alias("last"),
    )
    return F.aggregate(a, start, step, lambda s: s["out"])


def angles(a: Column, length: int) -> Column:
    """Linear in the angle, wrapped to [-pi, pi)."""
    return F.transform(linear(unwrapped(a), length), lambda x: F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi)


def with_resampled(df: DataFrame, chunk: str, out: str, length: int, width: int, angle: Sequence[int] = ()) -> DataFrame:
    """out: the column chunk, an array of steps of `width` numbers, at `length` steps, channel by channel. Channels in angle
    go the short way and end in [-pi, pi). A chunk with a coordinate that means 'no pose' is INVALID throughout."""
    def series(k: int) -> Column:
        channel = F.transform(chunk, _number(k))
        if k not in angle:
            return let(channel, lambda a: linear(a, length))
        return F.transform(let(unwrapped(channel), lambda a: linear(a, length)), lambda x: F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi)

    steps = F.transform(F.arrays_zip(*[series(k).alias(f"s{k}") for k in range(width)]), lambda z: F.array(*[z[f"s{k}"] for k in range(width)]))
    bad = F.exists(F.flatten(F.col(chunk)), lambda x: x >= INVALID_FROM)
    invalid = F.array_repeat(F.array_repeat(F.lit(INVALID), width), length)
    return df.withColumn(out, F.when(bad, invalid).otherwise(steps))


def _number(k: int) -> Callable[[Column], Column]:
    return lambda step: F.get(step, F.lit(k))


def repeated_mask(mask: Column, length: int) -> Column:
    """A mask whose steps are repeated as often as they go into `length` as a whole."""
    times = F.floor(F.lit(length) / F.size(mask)).cast("int")
    return F.when(F.size(mask) == length, mask).otherwise(F.flatten(F.transform(mask, lambda x: F.array_repeat(x, times))))


def last_token(states: Column, mask: Column) -> Column:
    """The state of the last token that counts: the last one of all if it counts (padding in front), else the one at the
    number of those that do; null if none does."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return F.when(F.element_at(mask, -1) == 1, F.element_at(states, -1)).when(n > 0, F.try_element_at(states, n))


def unit_length(v: Column) -> Column:
    """A vector over its length, or over 1e-12 if that is more; null if a number is."""
    size = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.when(F.forall(v, lambda x: x.isNotNull()), F.transform(v, lambda x: x / size))


def slerp(q: Column, r: Column, share: Column) -> Column:
    """Between two unit quaternions, the short way."""
    d = F.aggregate(F.zip_with(q, r, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.least(F.lit(1.0), F.abs(d)))
    near = F.abs(d) > 1 - 1e-12
    a = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    b = F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle)) * F.when(d < 0, -1.0).otherwise(1.0)
    return F.zip_with(q, r, lambda x, y: a * x + b * y)
