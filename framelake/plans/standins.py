"""The given tables in the roles of the data model, and the same as SQL for the counterparts of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each expression is valid in Spark SQL and in standard SQL.
_REGISTRY = {
    "episode_hash": "CAST(doc_id AS STRING)",
    "operator": "source",
    "task": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END",
    "embodiment": "CASE WHEN doc_id % 4 = 0 THEN 'aria' WHEN doc_id % 4 = 1 THEN 'eva' ELSE 'mecka' END",
    "robot_name": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN 'aria_left' WHEN doc_id % 9 = 2 THEN 'aria_right' WHEN doc_id % 9 = 4 THEN '  ' ELSE 'eva_bimanual' END",
    "num_frames": "CASE WHEN doc_id % 17 = 0 THEN -1 WHEN doc_id % 19 = 0 THEN -2 ELSE n_chars END",
    "is_deleted": "CASE WHEN doc_id % 7 = 0 THEN TRUE WHEN doc_id % 5 = 0 THEN NULL ELSE FALSE END",
    "zarr_processed_path": "CASE WHEN doc_id % 6 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN NULL ELSE 's3://store/' || source || '/' || CAST(doc_id AS STRING) END",
    "zarr_processing_error": "CASE WHEN doc_id % 23 = 0 THEN 'CUDA Out Of Memory' WHEN doc_id % 29 = 0 THEN 'Zero Frames' ELSE '' END",
    "doc_id": "doc_id",
}
REGISTRY_SQL = "registry AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _REGISTRY.items()) + " FROM documents)"
_FRAMES = {
    "episode": "user_id",
    "t": "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT)",
    "event_id": "event_id",
    "kind": "event_type",
    "value": "value",
}
FRAMES_SQL = "frames AS (SELECT ts, " + ", ".join(f"{e} AS {c}" for c, e in _FRAMES.items()) + " FROM events)"
#: spans of frames with a text: a new span begins at each event of the kind 'click'
SPANS_SQL = (
    FRAMES_SQL
    + """, marks AS (SELECT *, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM frames),
spans AS (SELECT episode, CAST(s AS BIGINT) AS ordinal, min(t) AS start_idx, max(t) + CAST(s % 3 AS BIGINT) AS end_idx,
  'label ' || CAST(CAST(s AS BIGINT) AS STRING) AS text FROM marks WHERE s > 0 AND s % 4 <> 3 GROUP BY episode, s)"""
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in _REGISTRY.items()])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("ts", *[f"{e} AS {c}" for c, e in _FRAMES.items()])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = frames(spark, sf_dir).selectExpr("*", "sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS s")
    ends = marks.filter("s > 0 AND s % 4 <> 3").groupBy("episode", "s").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.selectExpr("episode", "s AS ordinal", "a AS start_idx", "b + s % 3 AS end_idx", "'label ' || CAST(s AS STRING) AS text")
