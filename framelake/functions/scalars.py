"""Column functions: hashes of times, paths, texts, prompts and states. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.schema import EMBODIMENTS, UPLOAD_FAILED, ZERO_FRAMES

_STAMP = "yyyy-MM-dd-HH-mm-ss-SSSSSS"


def hash_of_millis(ms: Column) -> Column:
    """Episode hash of a time in milliseconds (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_millis(ms), _STAMP)


def millis_of_hash(h: Column) -> Column:
    return F.unix_millis(F.to_timestamp(h, _STAMP))


def frame_of_micros(us: Column, fps: float) -> Column:
    return (us / 1e6 * fps).cast("int")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def bucket_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[a-z0-9+.-]+://([^/?#]+)", 1)


def key_of(uri: Column) -> Column:
    return F.btrim(F.regexp_extract(uri, r"^[a-z0-9+.-]+://[^/?#]+/?([^?#]*)", 1), F.lit("/"))


def segment_from_end(uri: Column, n: int) -> Column:
    return F.try_element_at(F.split(F.rtrim(uri, F.lit("/")), "/"), F.lit(-n))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def without_suffix(name: Column, suffix: str) -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def swapped_suffix(name: Column, old: str, new: str) -> Column:
    return F.when(F.endswith(name, F.lit(old)), F.concat(without_suffix(name, old), F.lit(new))).otherwise(name)


def swapped_prefix(key: Column, new: str) -> Column:
    """images.x becomes new.x"""
    return F.concat(F.lit(new + "."), F.regexp_replace(key, r"^[^.]*\.", ""))


def arm(robot_name: Column) -> Column:
    name = F.lower(F.coalesce(robot_name, F.lit("")))
    return F.when(F.contains(name, F.lit("left")), "left").when(F.contains(name, F.lit("right")), "right").otherwise("both")


def task_or_unknown(task: Column) -> Column:
    return F.when(task.isNull() | task.isin("", "nan", "null"), "unknown").otherwise(task)


def is_out_of_memory(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("outofmemory|out of memory|oom")


def frames_status(n: Column) -> Column:
    """What went wrong, '' if nothing did."""
    return F.when(n > 0, "").when(n == UPLOAD_FAILED, "Upload Failed").when(n == ZERO_FRAMES, "Zero Frames").otherwise("Conversion Failed Unhandled Error")


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y", "t")


def listed(text: Column) -> Column:
    """Comma-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def percent(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double") / 100


def embodiment_id(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in EMBODIMENTS.items() for x in kv]), F.upper(name))


def embodiment_name(i: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in EMBODIMENTS.items() for x in (v, k)]), i)


def size_text(n: Column) -> Column:
    """A number of bytes for people."""
    units = ["B", "KB", "MB", "GB", "TB"]
    show = lambda k: F.concat(F.format_string("%.2f", n / 2.0 ** (10 * k)), F.lit(f" {units[k]}"))
    out = show(4)
    for k in (3, 2, 1, 0):
        out = F.when(n < 2 ** (10 * (k + 1)), show(k)).otherwise(out)
    return out


def state_bins(state: Column, bins: int = 256) -> Column:
    """Bin numbers of values clipped to [-1, 1], joined by blanks."""
    one = lambda x: F.least(F.lit(bins - 1), F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) * (bins / 2))).cast("string")
    return F.array_join(F.transform(state, one), " ")


def control_mode(embodiment: Column, modes: Sequence[tuple[str, str]] = ()) -> Column:
    """The first mode whose key the name contains; else a default that depends on the name."""
    # Fixed texts of the prompt format.
    out = F.when(F.contains(embodiment, F.lit("aria")), "cam frame xyzypr per arm").otherwise("cam frame xyzypr gripper per arm")
    for key, mode in reversed(modes):
        out = F.when(F.contains(embodiment, F.lit(key.lower())), mode).otherwise(out)
    return out


def prompt(task: Column, embodiment: Column, mode: Column, state: Column) -> Column:
    """Blocks whose value is null are left out."""
    named = [("Task: ", task), ("Embodiment: ", embodiment), ("Control mode: ", mode), ("State: ", state)]
    return F.concat(F.concat_ws(", ", *[F.concat(F.lit(n), c) for n, c in named]), F.lit(";\nAction: "))


def better_of(a: Column, b: Column) -> Column:
    """Both as percent, the better one (both in a tie) in bold; '--' for null."""
    show = lambda x, y: F.when(x.isNull(), "--").when(x >= F.coalesce(y, x), F.format_string("\\textbf{%.1f}", x * 100)).otherwise(F.format_string("%.1f", x * 100))
    return F.concat_ws(" & ", show(a, b), show(b, a))
