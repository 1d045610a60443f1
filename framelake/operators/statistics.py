"""Exact statistics, normalization, outliers, sampling, splits, batching and curation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources.scratch import steps


def norm_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes and interpolated quantiles of the non-NaN values of each group."""
    v = F.col(value)
    q = lambda p: F.percentile(v, p)
    return df.filter(~F.isnan(v)).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        q(0.5).alias("median"), q(0.01).alias("q1"), q(0.99).alias("q99"), q(0.0001).alias("q0_01"), q(0.9999).alias("q99_99"),
    )


STATS = ("mean", "std", "min", "max", "median", "q1", "q99", "q0_01", "q99_99")


def save_stats(stats: DataFrame, embodiment: str, key: str, dim: str, path: str, mode: str = "errorifexists") -> None:
    """norm_stats() by embodiment, key and dimension as JSON: a line {embodiment, stats: {key: {statistic: [a number for each
    dimension]}}} for each embodiment. A document is as large as an embodiment has keys and dimensions."""
    lists = stats.groupBy(embodiment, key).agg(F.sort_array(F.collect_list(F.struct(dim, *STATS))).alias("_d"))
    named = F.struct(*[F.col(f"_d.{c}").alias(c) for c in STATS])
    docs = lists.groupBy(embodiment).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), named))).alias("stats"))
    docs.select(F.col(embodiment).alias("embodiment"), "stats").write.mode(mode).json(path)


def load_stats(spark: SparkSession, path: str, names: str) -> DataFrame:
    """What save_stats() wrote, as rows: the two columns of names (as in 'label int, key string'), dim and STATS."""
    (first, kind), (second, other) = (x.split() for x in names.split(", "))
    lists = ", ".join(f"{c}: array<double>" for c in STATS)
    docs = spark.read.schema(f"embodiment {kind}, stats map<string, struct<{lists}>>").json(path)
    rows = docs.select(F.col("embodiment").alias(first), F.explode("stats").alias(second, "_s")).withColumn(second, F.col(second).cast(other))
    return rows.select(first, second, F.posexplode(F.arrays_zip(*[F.col(f"_s.{c}").alias(c) for c in STATS])).alias("dim", "_z")).select(first, second, "dim", "_z.*")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" and c not in ("min", "max") else F.col(c) for c, k in df.dtypes])


def running_offset(df: DataFrame, key: str, n: str, out: str, blocks: int = 64) -> DataFrame:
    """Sum of n over all smaller keys. Blocks by range: sums inside each, and the sums of whole blocks before it, so no
    task sees all rows. The ranged rows are written once, so both sums are over the same blocks."""
    with steps(df.sparkSession) as own:
        ranged = own.written(df.repartitionByRange(blocks, key).withColumn("_b", F.spark_partition_id()))
        w = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        inside = ranged.withColumn("_in", F.coalesce(F.sum(n).over(w), F.lit(0)))
        total = ranged.groupBy("_b").agg(F.sum(n).alias("_s"))  # one row for each block
        order = Window.partitionBy(F.lit(0)).orderBy("_b")
        before = total.select("_b", (F.sum("_s").over(order) - F.col("_s")).alias("_before"))
        return own.result(inside.join(F.broadcast(before), "_b").withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_b", "_in", "_before"))


def normalize(x: Column, stats: Column, mode: str) -> Column:
    """zscore, minmax or quantile."""
    if mode == "zscore":
        return (x - stats["mean"]) / (stats["std"] + 1e-6)
    a, b = {"minmax": ("min", "max"), "quantile": ("q1", "q99")}[mode]
    return 2 * (x - stats[a]) / (stats[b] - stats[a] + 1e-6) - 1


def unnormalize(x: Column, stats: Column, mode: str) -> Column:
    if mode == "zscore":
        return x * (stats["std"] + 1e-6) + stats["mean"]
    a, b = {"minmax": ("min", "max"), "quantile": ("q1", "q99")}[mode]
    return (x + 1) / 2 * (stats[b] - stats[a] + 1e-6) + stats[a]


def reject_reason(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "not finite").when(x < low, "low").when(x > high, "high")


def hash_rank(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """u in [0, 1): a seeded permutation that needs no sort; rows with u < p are a sample of share p, nested in p."""
    return df.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30))


def split(df: DataFrame, key: list[str], valid: float, seed: int = 42) -> DataFrame:
    ranked = hash_rank(df, key, seed)
    return ranked.withColumn("split", F.when(F.col("u") < valid, "valid").otherwise("train")).drop("u")


def top_share(df: DataFrame, by: str, score: str, tie: str, share: float) -> DataFrame:
    """The best max(1, ceil(n * share)) rows of each group, or all of a group with a score that isn't finite."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf"))
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("_bad"))
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    ranked = df.withColumn("_r", F.row_number().over(w)).join(per, by)
    return ranked.filter((F.col("_bad") > 0) | (F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)))).drop("_r", "_n", "_bad")


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    w = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / w)).cast("int")
    return df.filter(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shared_histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts of all values in bins of equal width between the smallest and the largest one; the last bin is closed. Nulls
    are left out; where all values are equal there is one bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.floor((F.col(value) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    b = F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int")
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kl_divergence(p: DataFrame, q: DataFrame, key: str, eps: float = 1e-10) -> DataFrame:
    """Of two histograms (key, n), with eps added to each share and shares renormalised over the bins of both."""
    share = lambda df, c: df.withColumn(c, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select(key, c)
    both = share(p, "p").join(share(q, "q"), key, "full_outer").select(F.coalesce("p", F.lit(0.0)) + eps, F.coalesce("q", F.lit(0.0)) + eps).toDF("p", "q")
    sums = both.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("a"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    return sums.select((F.col("a") / F.col("sp") - F.log(F.col("sp") / F.col("sq"))).alias("kl"))


def size_batches(df: DataFrame, by: str, order: list[str], size: str, target: float) -> DataFrame:
    """batch of each row: rows of a group join one after the other, and a new batch begins where a non-empty one would
    pass the target; a null size counts as 0. Each group is one sequence by definition: its rows are sorted on disk where
    needed and pass a task as Arrow batches, so that only a group, a batch number and a sum are held."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, total = None, 0, 0.0
        for rows in batches:
            out = []
            for key, x in zip(rows.column(0).to_pylist(), rows.column(rows.num_columns - 1).to_pylist(), strict=True):
                if group != (key,):
                    group, number, total = (key,), 0, 0.0
                if total > 0 and total + x > target:
                    number, total = number + 1, 0.0
                total += x
                out.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(out, pa.int32())], [*names, "batch"])

    names = [by, *order]
    rows = df.select(*names, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("_size"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.repartition(by).sortWithinPartitions(*names, "_size").mapInArrow(numbered, ", ".join([*kinds, "batch int"]))


def nearest_value(left: DataFrame, right: DataFrame, by: str, key: str, x: str) -> DataFrame:
    """For each left row the right row of its group whose x is nearest, of rows as near the one with the smallest key: other.
    Both sides are sorted up and down, as for a join in time, and no window looks ahead. A null x has no nearest row."""
    right = right.filter(F.col(x).isNotNull()).groupBy(by, x).agg(F.min(key).alias(key))
    both = left.select(by, key, x, F.lit(1).alias("_side")).unionByName(right.select(by, key, x, F.lit(0).alias("_side")))
    both = both.withColumn("_m", F.when(F.col("_side") == 0, F.struct(F.col(x).alias("x"), F.col(key).alias("k"))))
    last = lambda *order: F.last("_m", True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = last(x, "_side"), last(F.desc(x), "_side")
    out = both.withColumn("_b", back).withColumn("_a", ahead).filter("_side = 1")
    below, above = F.col(x) - F.col("_b.x"), F.col("_a.x") - F.col(x)
    near = F.when(F.col("_a").isNull() | (below < above), F.col("_b.k")).when(F.col("_b").isNull() | (above < below), F.col("_a.k")).otherwise(F.least("_a.k", "_b.k"))
    return out.select(by, key, F.when(F.col(x).isNotNull(), near).alias("other"))
