"""Rule tables: each rule that a row breaks is a row of (key, rule, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.schema import INVALID_FROM


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: name to (condition that must hold, detail). A null condition counts as broken."""
    rows = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))) for name, (ok, detail) in rules.items()]
    broken = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("b")).select(key, "b.rule", "b.detail")


def pose_rules(pose: Column) -> dict[str, tuple[Column, Column]]:
    q = F.sqrt(F.aggregate(F.slice(pose, 4, 4), F.lit(0.0), lambda s, x: s + x * x))
    return {
        "pose width": (F.size(pose) == 7, F.size(pose)),
        "pose valid": (F.forall(F.slice(pose, 1, 3), lambda x: F.abs(x) < INVALID_FROM), F.lit("")),
        "unit quaternion": (F.abs(q - 1) < 1e-4, F.lit("")),
    }


def span_rules(start: Column, end: Column, frames: Column, strict: bool = True) -> dict[str, tuple[Column, Column]]:
    return {"span inside": ((start >= 0) & (end <= frames), end), "span order": (start < end if strict else start <= end, end)}


def idle_reason(seen: DataFrame, key: str, now: Column, idle_for: float, up_for: float) -> DataFrame:
    """Of workers (key, started, worked), those that are too old or whose last work is too long ago; times in seconds."""
    up, rest = now - F.col("started"), now - F.coalesce("worked", "started")
    why = F.when(up > up_for, "too old").when(rest > idle_for, "idle")
    return seen.select(key, why.alias("reason")).filter("reason IS NOT NULL")


def inconsistent(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that are on one side only or more than once, and columns that differ: (key, problem)."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_a_{c}") for c in columns])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), *[F.min(c).alias(f"_b_{c}") for c in columns])
    differs = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), c) for c in columns]
    both = F.col("_n").isNotNull() & F.col("_m").isNotNull()
    found = F.array(F.when(F.col("_m").isNull(), "only left"), F.when(F.col("_n").isNull(), "only right"), F.when((F.col("_n") > 1) | (F.col("_m") > 1), "repeated"), *[F.when(both, x) for x in differs])
    return a.join(b, key, "full_outer").select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def declared_widths(df: DataFrame) -> DataFrame:
    """Columns of a frame table with their kind: image, annotation, numeric or scalar."""
    kind = lambda t: "image" if t == "binary" else "numeric" if t.startswith("array<") and "string" not in t else "annotation" if "struct" in t or "string" in t else "scalar"
    spark = df.sparkSession
    return spark.createDataFrame([(c, t, kind(t)) for c, t in df.dtypes], "column string, type string, kind string")


def rate(violated: Column) -> Column:
    """Percent of rows that are violated; null of no rows, and a row that can't be checked counts as good."""
    return F.round(100.0 * F.avg(F.when(violated, 1.0).otherwise(0.0)), 6)
