"""Shapes of arrays: rows of a matrix, gathers, one-hot codes, splits and joins on the last axis, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def reshaped(a: Column, width: int) -> Column:
    """An array as rows of `width`; a last, shorter row keeps what is left over."""
    rows = F.ceil(F.size(a) / width).cast("int")
    return F.when(F.size(a) == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(a, i * width + 1, width)))


def gathered(rows: Column, i: int) -> Column:
    """Value i of each row, null where a row is shorter."""
    return F.transform(rows, lambda r: F.get(r, F.lit(i)))


def repeated(a: Column, times: int) -> Column:
    """Each value `times` times in its place."""
    return F.flatten(F.transform(a, lambda v: F.array_repeat(v, times)))


def one_hot(i: Column, width: int) -> Column:
    """1 at place i (from 0), 0 elsewhere; a place outside gives zeros alone."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce((k == i).cast("int"), F.lit(0)))


def split_last(rows: Column, widths: Sequence[int]) -> list[Column]:
    """Rows cut on their last axis into parts of the given widths."""

    def part(start: int, width: int) -> Column:
        return F.transform(rows, lambda r: F.slice(r, start + 1, width))

    return [part(sum(widths[:k]), w) for k, w in enumerate(widths)]


def joined_last(a: Column, b: Column) -> Column:
    """Rows of both side by side."""
    return F.zip_with(a, b, lambda x, y: F.concat(x, y))


def steps(a: Column) -> Column:
    """Differences to the next value, with a zero for the last one."""
    return F.transform(a, lambda v, i: F.coalesce(F.get(a, i + 1) - v, F.lit(0.0)))


def sampled(a: Column, points: int) -> Column:
    """`points` values at equal distances from the first on."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.get(a, F.floor(k * F.size(a) / points).cast("int")))


def attribute_map(attributes: Column) -> Column:
    """Name to first value of structs (name, values); the last of equal names counts, none is an empty map."""
    kept = F.filter(attributes, lambda x: x["name"].isNotNull())
    latest = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept), F.lit(1))), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(F.transform(latest, lambda x: F.struct(x["name"], F.get(x["values"], F.lit(0)))))


def is_instruction(attributes: Column) -> Column:
    """Whether a clip's attribute map stands for an instruction: no mistake, and an action that isn't an adjustment."""
    at = lambda k: F.try_element_at(attributes, F.lit(k))
    return ~at("Mistake").eqNullSafe("Yes") & F.coalesce(at("Action") != "Adjust", F.lit(False))
