"""What runs leave behind: scores and timings in files, table rows, key names, and substitutes for rows that failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.scalars import better_of


def key_triple(key: Column) -> Column:
    """struct<first, now, last> of an observation's key: 'x_1', 'x_t', 'x_T'; a key that ends in _1 is the first already."""
    base = F.regexp_replace(key, "_1$", "")
    return F.struct(F.concat(base, F.lit("_1")).alias("first"), F.concat(base, F.lit("_t")).alias("now"), F.concat(base, F.lit("_T")).alias("last"))


def fallbacks(rows: DataFrame, by: str, key: str, failed: Column, seed: int = 42) -> DataFrame:
    """For each failed row another row of its group that didn't fail: by, key, other. In the order of a hash of the keys the
    next one is taken, from the end on the first, so failed rows spread over all others; null where there is none. A group
    is cut into blocks by the start of the hash, so no task sees all of a large one: the next good row is in the block, or
    it is the first one of the blocks behind. Windows run backwards and on, never over all that follows."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    df = rows.select(by, key, failed.alias("_bad")).withColumn("_h", h).withColumn("_b", F.coalesce(F.substring("_h", 1, 2), F.lit("")))
    good = ~F.col("_bad") & F.col(key).isNotNull()
    behind = lambda c, *parts, order: F.last(c, True).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    firsts = df.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_at")).agg(F.min(F.when(good, F.struct("_h", key)))[key].alias("_first"))
    least = F.first("_first", True).over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn("_next", F.coalesce(behind("_first", "_by", order=[F.desc("_at")]), least)).drop("_first")
    inside = behind(F.when(good, F.col(key)), by, "_b", order=[F.desc("_h"), F.desc(key)])
    found = df.withColumn("_in", inside).filter("_bad")
    found = found.join(firsts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_at")))
    return found.select(by, key, F.coalesce("_in", "_next").alias("other"))


def table_rows(scores: DataFrame, row: str, first: str, second: str) -> DataFrame:
    """row and line: a LaTeX line of a name, with blanks for underlines, and two scores as percent, the better one in bold."""
    name = F.replace(F.col(row).cast("string"), F.lit("_"), F.lit(" "))
    return scores.select(row, F.concat(name, F.lit(" & "), better_of(F.col(first), F.col(second)), F.lit(" \\\\")).alias("line"))


def save_scores(scores: DataFrame, task: str, episode: str, score: str, path: str, mode: str = "errorifexists") -> None:
    """JSON lines {task, scores: {episode: score}} under path/scores_by_task, scores that aren't finite as null, and under
    path/stats {task, count, mi_mean, mi_std, mi_median, mi_min, mi_max} of the finite ones."""
    s = F.when(~F.isnan(score) & (F.abs(F.col(score)) < float("inf")), F.col(score))
    df = scores.select(F.col(task).alias("task"), F.col(episode).cast("string").alias("_e"), s.alias("_s"))
    df.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("_e", "_s"))).alias("scores")).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/scores_by_task")
    stats = df.groupBy("task").agg(F.count(F.lit(1)).alias("count"), F.avg("_s").alias("mi_mean"), F.stddev_pop("_s").alias("mi_std"), F.median("_s").alias("mi_median"), F.min("_s").alias("mi_min"), F.max("_s").alias("mi_max"))
    stats.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/stats")


def load_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(task, episode, score) and the statistics that save_scores() wrote."""
    rows = spark.read.schema("task string, scores map<string,double>").json(f"{path}/scores_by_task").select("task", F.explode("scores").alias("episode", "score"))
    return rows, spark.read.schema("task string, count long, mi_mean double, mi_std double, mi_median double, mi_min double, mi_max double").json(f"{path}/stats")


TIMINGS = "episode_key string, processed_path string, mp4_path string, num_frames long, duration_sec double"


def append_timings(rows: DataFrame, path: str) -> None:
    """Adds CSV files with a header to a folder of timings."""
    rows.select(*[x.split()[0] for x in TIMINGS.split(", ")]).write.mode("append").option("header", True).csv(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMINGS).option("header", True).csv(path)
