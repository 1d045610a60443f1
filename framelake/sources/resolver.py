"""Episodes chosen in a registry and read from a store of frames: only their folders, row groups and frames are scanned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: so many episodes are named in the scan's filters; more are found by a join, whose own filters prune folders at run time
NAMED = 1000


def bucket(episode: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(episode.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def write_store(frames: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """frames (episode_hash, frame_idx, ...) in folders by bucket of the episode, sorted, so that row groups hold few episodes."""
    df = frames.withColumn("bucket", bucket(F.col("episode_hash"), buckets))
    df.repartition("bucket").sortWithinPartitions("bucket", "episode_hash", "frame_idx").write.mode(mode).partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Resolved:
    """frames: of the episodes that could be read. errors: episode_hash and reason of those that couldn't."""

    frames: DataFrame
    errors: DataFrame


def _scan(spark: SparkSession, path: str, episodes: DataFrame, buckets: int) -> DataFrame:
    """The store's rows of these episodes (episode_hash, bucket)."""
    store = spark.read.parquet(path)
    some = episodes.select("episode_hash", "bucket").limit(NAMED + 1).collect()  # bounded by NAMED
    if len(some) > NAMED:
        return store.join(episodes.select("episode_hash", "bucket"), ["bucket", "episode_hash"], "left_semi")
    return store.filter(F.col("bucket").isin(sorted({r["bucket"] for r in some})) & F.col("episode_hash").isin([r["episode_hash"] for r in some]))


def resolve(registry: DataFrame, path: str, columns: list[str], first: int = 0, end: int | None = None, buckets: int = BUCKETS) -> Resolved:
    """Frames first to end - 1 of the registry's episodes (episode_hash, zarr_processed_path, num_frames), by name, columns
    only. An episode without a path, one that the store lacks and one with fewer frames than registered is left out and told
    in errors; a registered count that is null or negative isn't checked."""
    spark = registry.sparkSession
    episodes = registry.dropDuplicates(["episode_hash"]).withColumn("bucket", bucket(F.col("episode_hash"), buckets))
    blank = F.trim(F.coalesce("zarr_processed_path", F.lit(""))) == ""
    wanted = episodes.filter(~blank)
    rows = _scan(spark, path, wanted, buckets)
    there = rows.groupBy("episode_hash").agg(F.count(F.lit(1)).alias("_there"))
    judged = wanted.join(there, "episode_hash", "left").withColumn(
        "reason", F.when(F.col("_there").isNull(), "not in the store").when(F.col("_there") < F.col("num_frames"), F.concat(F.col("_there").cast("string"), F.lit(" of "), F.col("num_frames").cast("string"), F.lit(" frames")))
    )
    errors = episodes.filter(blank).select("episode_hash", F.lit("no path").alias("reason")).unionAll(judged.filter("reason IS NOT NULL").select("episode_hash", "reason"))
    cut = rows.filter(F.col("frame_idx") >= first)
    if end is not None:
        cut = cut.filter(F.col("frame_idx") < end)
    bad = judged.filter("reason IS NOT NULL").select("episode_hash")
    return Resolved(cut.select("episode_hash", "frame_idx", *columns).join(bad, "episode_hash", "left_anti"), errors)


def read_slices(spark: SparkSession, path: str, slices: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """For slices (episode_hash, first, end) their frames; overlapping slices give a frame to each. The widest range of all
    slices reaches the scan, and so do their episodes."""
    ends = slices.agg(F.min("first").alias("a"), F.max("end").alias("b")).first()
    own = slices.withColumn("bucket", bucket(F.col("episode_hash"), buckets))
    rows = _scan(spark, path, own.select("episode_hash", "bucket").distinct(), buckets)
    if ends["a"] is not None:
        rows = rows.filter((F.col("frame_idx") >= ends["a"]) & (F.col("frame_idx") < ends["b"]))
    return rows.join(own, ["bucket", "episode_hash"]).filter("frame_idx >= first AND frame_idx < end").select("episode_hash", "first", "end", "frame_idx", *columns)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """episode_hash, total_frames, first_frame, last_frame and, for each other column, in how many frames it isn't null."""
    df = spark.read.parquet(path)
    features = [c for c in df.columns if c not in ("episode_hash", "frame_idx", "bucket")]
    counts = [F.count(F.col(f"`{c}`")).alias(c) for c in features]
    return df.groupBy("episode_hash").agg(F.count(F.lit(1)).alias("total_frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), *counts)


def probe(registry: DataFrame, path: str, order: list[Column], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The frames of the first episode, by order, that has a path."""
    one = registry.filter("trim(coalesce(zarr_processed_path, '')) <> ''").orderBy(*order).limit(1)
    return resolve(one, path, columns, buckets=buckets).frames
