"""Action layouts of the embodiments packed to one width and back, and the rules that choose a layout, as one expression.

A packed action has a block of ten numbers for each arm: position, the first two columns of the rotation, gripper; blocks of
arms that a layout lacks, grippers that it lacks and the rest of the width are zero."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import geometry as G

WIDTH, BLOCK, ANY = 32, 10, "*"


@dataclass(frozen=True)
class Layout:
    """arms: which of left (0) and right (1) are there. sixd: rotations are two matrix columns, not yaw, pitch and roll."""

    arms: tuple[int, ...]
    gripper: bool
    sixd: bool = False

    @property
    def arm(self) -> int:
        return 3 + (6 if self.sixd else 3) + self.gripper

    @property
    def width(self) -> int:
        return self.arm * len(self.arms)


LAYOUTS = {
    "robot_left": Layout((0,), True), "robot_right": Layout((1,), True), "robot_both": Layout((0, 1), True), "robot_both_6d": Layout((0, 1), True, True),
    "human_left": Layout((0,), False), "human_right": Layout((1,), False), "human_both": Layout((0, 1), False), "human_both_6d": Layout((0, 1), False, True),
}


def columns_of_ypr(yaw: Column, pitch: Column, roll: Column) -> list[Column]:
    """First and second column of the rotation by yaw, then pitch, then roll."""
    (cy, cp, cr), (sy, sp, sr) = ([f(x) for x in (yaw, pitch, roll)] for f in (F.cos, F.sin))
    return [cy * cp, sy * cp, -sp, cy * sp * sr - sy * cr, sy * sp * sr + cy * cr, cp * sr]


def ypr_of_columns(c: list[Column]) -> list[Column]:
    """Back from two columns, which needn't be orthogonal or of unit length."""
    a, b = c[:3], c[3:]
    long = F.greatest(G.norm(a), F.lit(1e-8))
    x = [v / long for v in a]
    along = G.dot(x, b)
    rest = [v - along * u for u, v in zip(x, b, strict=True)]
    size = F.greatest(G.norm(rest), F.lit(1e-8))
    y = [v / size for v in rest]
    z = x[0] * y[1] - x[1] * y[0]
    return [F.atan2(x[1], x[0]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -x[2]))), F.atan2(y[2], z)]


def pack(action: Column, layout: Layout) -> Column:
    """One action of the layout's width as WIDTH numbers; another width is an error, null stays null."""
    zero, blocks = F.lit(0.0), []
    for side in (0, 1):
        if side not in layout.arms:
            blocks += [zero] * BLOCK
            continue
        at = layout.arms.index(side) * layout.arm
        own = G.parts(action, at, layout.arm)
        rotation = own[3:9] if layout.sixd else columns_of_ypr(*own[3:6])
        blocks += [*own[:3], *rotation, own[-1] if layout.gripper else zero]
    out = F.array(*blocks, *[zero] * (WIDTH - 2 * BLOCK))
    wrong = F.concat(F.lit(f"an action of width {layout.width} expected, not "), F.size(action).cast("string"))
    return F.when(action.isNull() | (F.size(action) == layout.width), F.when(action.isNotNull(), out)).otherwise(F.raise_error(wrong))


def unpack(packed: Column, layout: Layout) -> Column:
    """The layout's own numbers of a packed action; 6-D columns are given as they are."""
    out = []
    for side in layout.arms:
        own = G.parts(packed, side * BLOCK, BLOCK)
        out += [*own[:3], *(own[3:9] if layout.sixd else ypr_of_columns(own[3:9])), *own[9:][: int(layout.gripper)]]
    return F.when(packed.isNotNull(), F.array(*out))


def pack_chunk(chunk: Column, layout: Layout) -> Column:
    """All steps of a chunk."""
    return F.transform(chunk, lambda a: pack(a, layout))


def unpack_chunk(chunk: Column, layout: Layout) -> Column:
    return F.transform(chunk, lambda a: unpack(a, layout))


class Rules:
    """Which layout holds for an embodiment and an action key, either of which may be ANY. The most special rule wins: both
    named, then the embodiment alone, then the key alone, then neither; of two rules for one pair the later one."""

    def __init__(self, rules: Mapping[tuple[str, str], str]) -> None:
        if unknown := set(rules.values()) - set(LAYOUTS):
            raise ValueError(f"no layouts {sorted(unknown)}")
        self.rules = dict(rules)

    def layout(self, embodiment: str, key: str) -> Layout | None:
        for pair in ((embodiment, key), (embodiment, ANY), (ANY, key), (ANY, ANY)):
            if pair in self.rules:
                return LAYOUTS[self.rules[pair]]
        return None

    def _ranked(self) -> list[tuple[tuple[str, str], str]]:
        return sorted(self.rules.items(), key=lambda r: (r[0][0] == ANY, r[0][1] == ANY))

    def compiled(self, embodiment: Column, key: Column, to: Callable[[str], Column]) -> Column:
        """to(name of the layout) for each row, as one CASE over all rules; a row without a rule is an error."""
        out = None
        for (e, k), name in self._ranked():
            holds = F.lit(True) if e == ANY else embodiment == e
            holds = holds & (F.lit(True) if k == ANY else key == k)
            out = F.when(holds, to(name)) if out is None else out.when(holds, to(name))
        why = F.concat(F.lit("no layout for "), F.coalesce(embodiment, F.lit("null")), F.lit(" and "), F.coalesce(key, F.lit("null")))
        return F.raise_error(why) if out is None else out.otherwise(F.raise_error(why))

    def pack(self, embodiment: Column, key: Column, action: Column) -> Column:
        return self.compiled(embodiment, key, lambda n: pack(action, LAYOUTS[n]))

    def unpack(self, embodiment: Column, key: Column, packed: Column) -> Column:
        return self.compiled(embodiment, key, lambda n: unpack(packed, LAYOUTS[n]))


def arms_of(action: Column) -> Column:
    """A 14-wide action (per arm: position, yaw, pitch, roll, gripper) as two structs of pose (xyz + quaternion) and gripper."""
    arm = lambda at: F.struct(F.concat(F.slice(action, at + 1, 3), G.ypr_to_quaternion(F.slice(action, at + 4, 3))).alias("pose"), F.get(action, F.lit(at + 6)).alias("gripper"))
    return F.when(F.size(action) == 14, F.array(arm(0), arm(7)))
