"""Readers and writers. Parquet is the storage format: frames by embodiment, sorted by episode and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.schema import REGISTRY, SPANS


def read_registry(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The registry from Parquet or over JDBC; columns that the source lacks are null."""
    df = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    if missing := {"episode_hash"} - set(df.columns):
        raise ValueError(f"the registry lacks {sorted(missing)}")
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in REGISTRY]
    return df.select(*own, *[c for c in df.columns if c not in REGISTRY.fieldNames()])


def write_frames(frames: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """frames (embodiment, episode_hash, frame_idx, ...) with all columns present in each frame, numbered without gaps."""
    holes = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    n = F.count(F.lit(1))
    bad = frames.groupBy("episode_hash").agg((F.max("frame_idx") + 1 != n).alias("_gap"), *holes)
    wrong = bad.filter(" OR ".join(["_gap", *[f"`{c}` > 0" for c in columns]])).select("episode_hash").limit(5).collect()  # a message names five
    if wrong:
        raise ValueError(f"gaps or missing values in {[r[0] for r in wrong]}")
    frames.repartition("embodiment", "episode_hash").sortWithinPartitions("episode_hash", "frame_idx").write.mode(mode).partitionBy("embodiment").parquet(path)


def read_range(spark: SparkSession, path: str, first: int, end: int, columns: list[str]) -> DataFrame:
    """Frames first to end - 1 of every episode; the range and the columns reach the scan."""
    df = spark.read.parquet(path)
    return df.filter((F.col("frame_idx") >= first) & (F.col("frame_idx") < end)).select("episode_hash", "frame_idx", *columns)


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """append adds a track's spans to those there; overwrite replaces the tracks that are written and no others."""
    spans.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("track").parquet(path)


def spans_of_json(raw: DataFrame, column: str) -> DataFrame:
    """raw (episode_hash, track, JSON bytes of {text, start_idx, end_idx}) as spans."""
    parsed = F.from_json(F.col(column).cast("string"), "text string, start_idx int, end_idx int")
    names = [x.split()[0] for x in SPANS.split(", ")]
    return raw.select("episode_hash", "track", parsed.alias("s")).select("episode_hash", "track", "s.*").select(*names)


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with Labels or label, start_time and end_time; the episode is the second part of the file's name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = spark.read.csv(path, header=True).withColumn("episode", F.try_element_at(F.split(name, "_"), F.lit(2)))
    label = F.coalesce(*[F.col(c) for c in ("Labels", "label") if c in df.columns])
    return df.select("episode", label.alias("text"), F.col("start_time").try_cast("double").alias("start_time"), F.col("end_time").try_cast("double").alias("end_time"))


def read_catalog(spark: SparkSession, path: str, least_frames: int = 0) -> DataFrame:
    df = spark.read.schema("tar_filename string, episode_hash string, n_frames int, embodiment string").json(path, multiLine=True)
    return df.filter(F.col("n_frames") >= least_frames)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """{task: {episode: score or null}} as rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return raw.select(F.explode("m").alias("task", "s")).select("task", F.explode("s").alias("episode_hash", "mi"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold something under a path, with size, parent folder and stem; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return df.withColumn("parent", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))


def bundles(files: DataFrame, parts: dict[str, str]) -> DataFrame:
    """Parents that hold a file for every part (name to a pattern of its path), by name."""
    has = [F.bool_or(F.col("path").rlike(p)).alias(n) for n, p in parts.items()]
    return files.groupBy("parent").agg(*has).filter(" AND ".join(f"`{n}`" for n in parts)).select("parent").orderBy("parent")
