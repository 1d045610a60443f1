"""Checks of whole episodes: metadata, counts, required keys, shapes and norms of arrays, annotations, bounds of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schema import EMBODIMENTS, INVALID_FROM, layout

# Fixed values of the data format.
FIELDS = ("embodiment", "total_frames", "fps", "task_name", "features")
RATES = (30, 60)
REQUIRED = ("images.front_1", "left.obs_ee_pose", "right.obs_ee_pose")
POSES = ("left.obs_ee_pose", "right.obs_ee_pose", "left.obs_wrist_pose", "right.obs_wrist_pose", "obs_head_pose", "left.cmd_ee_pose", "right.cmd_ee_pose")
GRIPPERS = ("left.obs_gripper", "right.obs_gripper", "left.gripper", "right.gripper")
KEYPOINTS = ("left.obs_keypoints", "right.obs_keypoints")
NAMES, PLACES = ("embodiment", "robot_name", "robot_type", "embodiment_name"), ("", "attributes.", "metadata.")
#: how far a quaternion's norm may be from 1
NORM = 1e-4 + 1e-5


def _field(doc: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({doc}, '$.{path}', '{kind}')")


def _there(doc: str, path: str) -> Column:
    return F.expr(f"variant_get({doc}, '$.{path}') IS NOT NULL")


def embodiment_of(doc: str) -> Column:
    """Upper-case name of the embodiment in a variant of metadata: the first of twelve places whose value is a known number
    or a text that isn't blank."""
    names = F.create_map(*[F.lit(x) for k, v in EMBODIMENTS.items() for x in (str(v), k)])

    def read(path: str) -> Column:
        said = F.trim(_field(doc, path, "string"))
        number = F.regexp_replace(said, "^0+(?=.)", "")
        return F.when(said.rlike("^[0-9]+$"), F.try_element_at(names, number)).otherwise(F.nullif(F.upper(said), F.lit("")))

    return F.coalesce(*[read(place + name) for place in PLACES for name in NAMES])


def valid_pose(pose: Column) -> Column:
    """Whether a pose (xyz + quaternion) has finite coordinates that don't mean 'no pose' and a quaternion that isn't zero."""
    size = F.sqrt(F.aggregate(F.slice(pose, 4, 4), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce((F.size(pose) == 7) & F.forall(F.slice(pose, 1, 3), lambda x: F.abs(x) < INVALID_FROM) & (size > 1e-6), F.lit(False))


def _problem(family: str, key: Column, what: Column, wrong: Column) -> Column:
    return F.when(wrong, F.struct(F.lit(family).alias("family"), key.alias("key"), what.alias("problem")))


def _exploded(df: DataFrame, key: str, problems: list[Column]) -> DataFrame:
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    return df.select(key, F.explode(found).alias("p")).select(key, "p.*")


def episode_problems(episodes: DataFrame, arrays: DataFrame, annotations: DataFrame, key: str = "episode_hash") -> DataFrame:
    """key, family, key and problem of every check that fails; an episode without rows here is valid.

    episodes (key, metadata: JSON text), arrays (key, name, t, value: array of doubles or null for images) in rows by frame,
    annotations (key, name, ordinal, record: JSON text). Arrays and annotations are aggregated before they meet their
    episode. Frames from total_frames on aren't checked for norms. Without total_frames no count is checked; metadata that
    don't parse lack all fields."""
    meta = episodes.select(key, F.try_parse_json("metadata").alias("_d"))
    meta = meta.withColumn("_frames", _field("_d", "total_frames", "long")).withColumn("_fps", _field("_d", "fps", "double"))
    lacks = [_problem("metadata", F.lit(f), F.lit("missing field"), ~F.coalesce(_there("_d", f), F.lit(False))) for f in FIELDS]
    rate = _problem("fps", F.lit("fps"), F.concat(F.lit("unexpected "), F.coalesce(F.col("_fps").cast("string"), F.lit("none"))), ~F.coalesce(F.col("_fps").isin(*RATES), F.lit(False)))
    of_metadata = _exploded(meta, key, [*lacks, rate])

    rows = arrays.join(meta.select(key, "_frames"), key)
    width, size = F.size("value"), F.sqrt(F.aggregate(F.slice("value", 4, 4), F.lit(0.0), lambda s, x: s + x * x))
    inside = F.col("_frames").isNull() | (F.col("t") < F.col("_frames"))
    off = inside & (width == 7) & ~F.coalesce(F.abs(size - 1) <= NORM, F.lit(False))
    sums = rows.groupBy(key, "name").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_frames").alias("_frames"), F.min(width).alias("_low"), F.max(width).alias("_high"),
        F.count_if(off).alias("_off"), F.min(F.when(off, F.col("t"))).alias("_at"),
    )
    name = F.col("name")
    widths = F.concat(F.col("_low").cast("string"), F.when(F.col("_low") != F.col("_high"), F.concat(F.lit(" to "), F.col("_high").cast("string"))).otherwise(""))
    wide = lambda names, n, family: _problem(family, name, F.concat(F.lit(f"width {n} expected, not "), widths), name.isin(*names) & ((F.col("_low") != n) | (F.col("_high") != n)))
    of_arrays = _exploded(sums, key, [
        _problem("frame count", name, F.concat(F.col("_n").cast("string"), F.lit(" of "), F.col("_frames").cast("string"), F.lit(" frames")), F.col("_n") < F.col("_frames")),
        wide(POSES, 7, "pose"), wide(GRIPPERS, 1, "gripper"), wide(KEYPOINTS, 63, "keypoints"),
        _problem("pose", name, F.concat(F.col("_off").cast("string"), F.lit(" quaternions not of length 1, the first at "), F.col("_at").cast("string")), name.isin(*POSES) & (F.col("_off") > 0)),
    ])

    wanted = meta.select(key, F.explode(F.array(*map(F.lit, REQUIRED))).alias("name"))
    missing = wanted.join(sums.select(key, "name"), [key, "name"], "left_anti").select(key, F.lit("required key").alias("family"), F.col("name").alias("key"), F.lit("missing").alias("problem"))

    notes = annotations.join(meta.select(key, "_frames"), key).withColumn("_r", F.try_parse_json("record"))
    kind = F.expr("schema_of_variant(_r)")
    start, end = _field("_r", "start_idx", "long"), _field("_r", "end_idx", "long")
    is_int = lambda n: F.expr(f"schema_of_variant(variant_get(_r, '$.{n}')) = 'BIGINT'")
    why = (
        F.when(F.col("_r").isNull() | ~kind.startswith("OBJECT"), "not a record")
        .when(~F.coalesce(F.expr("schema_of_variant(variant_get(_r, '$.text')) = 'STRING'"), F.lit(False)), "text")
        .when(~F.coalesce(is_int("start_idx"), F.lit(False)), "start_idx").when(~F.coalesce(is_int("end_idx"), F.lit(False)), "end_idx")
        .when(~F.coalesce((start >= 0) & (start <= end) & (end <= F.coalesce("_frames", end)), F.lit(False)), "range")
    )
    notes = notes.withColumn("_why", why).groupBy(key, "name").agg(F.count(F.lit(1)).alias("_n"), F.count("_why").alias("_bad"), F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("ordinal"))).alias("_first"))
    text = F.concat(F.col("_bad").cast("string"), F.lit(" of "), F.col("_n").cast("string"), F.lit(" malformed, the first by its "), F.col("_first"))
    of_notes = notes.filter("_bad > 0").select(key, F.lit("annotation").alias("family"), F.col("name").alias("key"), text.alias("problem"))
    return of_metadata.unionAll(of_arrays).unionAll(missing).unionAll(of_notes)


def bounds_reason(value: Column, low: Column, high: Column, channels: list[int] | None = None) -> Column:
    """'not finite' if any number of a vector is null, NaN or infinite; 'bounds' if one of the channels (all by default) is
    below low or above high, arrays of the vector's size; null if neither, and for vectors of another size."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    pick = (lambda a: a) if channels is None else (lambda a: F.array(*[F.get(a, F.lit(k)) for k in channels]))
    outside = F.exists(F.arrays_zip(pick(value).alias("x"), pick(low).alias("l"), pick(high).alias("h")), lambda z: (z["x"] < z["l"]) | (z["x"] > z["h"]))
    why = F.when(F.exists(value, lambda x: ~finite(x)), "not finite").when(outside, "bounds")
    return F.when((F.size(value) == F.size(low)) & (F.size(value) == F.size(high)), why)


def guarded_channels(name: str, width: int) -> list[int] | None:
    """Positions and grippers of cartesian actions and poses whose layout is known; of all other keys every channel."""
    known = layout(width) if "actions_cartesian" in name or "ee_pose" in name else None
    return sorted(known["xyz"] + known["grip"]) if known else None


def first_violation(checks: list[tuple[str, Column]]) -> Column:
    """struct<key, reason> of the first key, in order, whose reason isn't null; null if there is none."""
    found = [F.when(reason.isNotNull(), F.struct(F.lit(name).alias("key"), reason.alias("reason"))) for name, reason in checks]
    return reduce(lambda a, b: F.coalesce(a, b), found)


def quantile_bounds(stats: DataFrame, slack: float = 0.0) -> tuple[Column, Column]:
    """Lower and upper bound from the outermost quantiles that a table of statistics has: q0_01 and q99_99, else q0_1 and
    q99_9, else q1 and q99, widened by slack."""
    first = lambda names: F.coalesce(*[F.col(n) for n in names if n in stats.columns])
    return first(("q0_01", "q0_1", "q1")) - slack, first(("q99_99", "q99_9", "q99")) + slack
