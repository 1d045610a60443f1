"""Data model: registry columns, embodiments, channel layouts and sentinels."""

from __future__ import annotations

from pyspark.sql import types as T

REGISTRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("episode_hash", "operator", "task", "embodiment", "robot_name")]
    + [T.StructField("num_frames", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("task_description", "scene", "objects", "data_type")]
    + [T.StructField("is_deleted", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("zarr_processed_path", "zarr_mp4_path", "zarr_processing_error")]
)
SPANS = "episode_hash string, track string, text string, start_idx int, end_idx int"
NORM_STATS = "embodiment int, key string, step int, dim int, mean double, std double, min double, max double, median double, q1 double, q99 double, q0_01 double, q99_99 double"

# Fixed values of the data format.
EMBODIMENTS = {
    "EVE_RIGHT_ARM": 0, "EVE_LEFT_ARM": 1, "EVE_BIMANUAL": 2, "ARIA_RIGHT_ARM": 3, "ARIA_LEFT_ARM": 4, "ARIA_BIMANUAL": 5,
    "EVA_RIGHT_ARM": 6, "EVA_LEFT_ARM": 7, "EVA_BIMANUAL": 8, "MECKA_BIMANUAL": 9, "MECKA_RIGHT_ARM": 10, "MECKA_LEFT_ARM": 11,
    "SCALE_BIMANUAL": 12, "SCALE_RIGHT_ARM": 13, "SCALE_LEFT_ARM": 14,
}
#: width of a bimanual cartesian vector: width of one arm's rotation, and whether a gripper ends each arm
LAYOUTS = {12: (3, False), 14: (3, True), 18: (6, False), 20: (6, True)}
#: coordinates from here on mean "no pose"; they are written back as INVALID
INVALID_FROM, INVALID = 1e8, 1e9
ZERO_FRAMES, UPLOAD_FAILED = -1, -2


def layout(width: int) -> dict[str, list[int]] | None:
    """Channels of the positions, rotations and grippers; None for a width that isn't known."""
    if width not in LAYOUTS:
        return None
    rot, grip = LAYOUTS[width]
    out: dict[str, list[int]] = {"xyz": [], "rot": [], "grip": []}
    for arm in (0, width // 2):
        out["xyz"] += range(arm, arm + 3)
        out["rot"] += range(arm + 3, arm + 3 + rot)
        out["grip"] += [arm + 3 + rot] if grip else []
    return out
