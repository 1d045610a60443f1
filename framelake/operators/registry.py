"""Operators on the episode registry: filters, set algebra, upserts and reconciliation. All are DataFrame to DataFrame;
mutations return the new table or a preview and never write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named filters, as SQL conditions
PRESETS = {
    "aria-fold-clothes": ["embodiment = 'aria'", "task = 'fold_clothes'"],
    "aria-all": ["embodiment = 'aria'"],
    "eva-all": ["embodiment = 'eva'"],
    "mecka-fold-clothes": ["embodiment = 'mecka'", "task = 'fold_clothes'"],
}


def present(c: Column | str) -> Column:
    """The text, or null where it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist which isn't blank; '' if none."""
    return F.coalesce(*[present(n) for n in names if n in df.columns], F.lit(""))


def normalize(df: DataFrame) -> DataFrame:
    """Missing values to their defaults; robot_name falls back to robot_type and then embodiment."""
    return df.withColumns({"robot_name": first_present(df, "robot_name", "robot_type", "embodiment"), "is_deleted": F.coalesce("is_deleted", F.lit(False))})


def where_all(df: DataFrame, conditions: list[str], missing_column: str = "error", drop_deleted: bool = True) -> DataFrame:
    """All SQL conditions, and by default not deleted. missing_column='pass' keeps every row for a condition that names
    a column the table lacks; by default analysis fails."""
    kept = []
    for c in conditions:
        try:
            kind = df.selectExpr(f"({c}) AS c").schema[0].dataType.simpleString()
        except Exception as e:
            if missing_column == "pass" and "UNRESOLVED_COLUMN" in str(e):
                continue
            raise
        if kind != "boolean":
            raise TypeError(f"{c!r} is {kind}, not boolean")
        kept.append(F.expr(c))
    if drop_deleted:
        kept.append(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return df.filter(reduce(Column.__and__, kept, F.lit(True)))


def preset(name: str) -> list[str]:
    if name not in PRESETS:
        raise ValueError(f"unknown filter {name!r}; there are {sorted(PRESETS)}")
    return PRESETS[name]


def where_group_larger(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose group has more than `least` rows: a pre-aggregated count and a join, not a window over whole groups."""
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key)
    return df.join(big, key, "left_semi")


def where_equal(df: DataFrame, path: str, **values: object) -> DataFrame:
    return df.filter(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in values.items()], F.col(path).isNotNull()))


def choose(df: DataFrame, key: str, include: list[DataFrame] = (), exclude: list[DataFrame] = ()) -> DataFrame:
    """Rows in every include list and in no exclude list."""
    for x in include:
        df = df.join(x.select(key).distinct(), key, "left_semi")
    for x in exclude:
        df = df.join(x.select(key).distinct(), key, "left_anti")
    return df


def skip_reason(done: bool = True) -> Column:
    """Why a bundle isn't converted; null if it is. Expects columns listed, known and those of the registry."""
    rules = [("not listed", ~F.col("listed")), ("no row", ~F.col("known"))]
    rules += [("done", present("zarr_processed_path").isNotNull())] if done else []
    rules += [("has error", F.coalesce("zarr_processing_error", F.lit("")) != ""), ("deleted", F.coalesce("is_deleted", F.lit(False)))]
    out = F.lit(None).cast("string")
    for name, hit in reversed(rules):
        out = F.when(hit, name).otherwise(out)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def insert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there; rows of a key that is are reported by conflicts()."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def conflicts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return new.join(old.select(*key), key, "left_semi")


def has_keys(df: DataFrame, keys: list[str]) -> dict[str, bool]:
    """Which columns are there; a check of the schema alone."""
    return {k: k in df.columns for k in keys}


def require(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows, if all their keys are known; else an error that names some that aren't."""
    lost = [r[0] for r in rows.select(key).join(known.select(key), key, "left_anti").distinct().take(5)]
    if lost:
        raise LookupError(f"unknown {key}: {lost}")
    return rows


def update(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows with the non-null values of new ones. Of new rows with one key the largest counts, column by column."""
    values = [c for c in new.columns if c not in key]
    fresh = new.groupBy(*key).agg(F.max(F.struct(*values)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(f"_new_{c}") for c in values])
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new.columns and c not in key else F.col(c) for c in old.columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A row for each key, the new one where there are two; of several new ones the largest, column by column. A max
    aggregation keeps one row in the shuffle's map side."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*key, "_rank")]
    return both.groupBy(*key).agg(F.max(F.struct("_rank", *cols)).alias("_r")).select(*key, *[f"_r.{c}" for c in cols])


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def soft_delete_blank(df: DataFrame, path: str) -> DataFrame:
    """Marks rows without a path as deleted; `changed` tells which weren't yet."""
    blank = present(path).isNull()
    return df.withColumn("changed", blank & ~F.coalesce("is_deleted", F.lit(False))).withColumn("is_deleted", blank | F.coalesce("is_deleted", F.lit(False)))


def reset(df: DataFrame, columns: list[str], when: Column) -> DataFrame:
    return df.withColumns({c: F.when(when, "").otherwise(F.col(c)) for c in columns})


def add_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def reconcile(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys with their state: missing, orphan or matched."""
    a, b = required.select(key).distinct().withColumn("_r", F.lit(True)), found.select(key).distinct().withColumn("_f", F.lit(True))
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "orphan").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """A union in which the earliest part that has a key keeps it."""
    both = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*cols), "part").alias("_r")).select(key, "_r.*")


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
