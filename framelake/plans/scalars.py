"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import scalars as X
from framelake.plans.registry import query
from framelake.plans.standins import REGISTRY_SQL, load, registry


@query("X5 X6 X34 S29 S34", r"""SELECT page_id, regexp_extract(url, '^[a-z0-9+.-]+://([^/?#]+)', 1) AS bucket, trim(regexp_extract(url, '^[a-z0-9+.-]+://[^/?#]+/?([^?#]*)', 1), '/') AS key,
  regexp_replace(url, '/[^/]*$', '') AS parent, string_split(rtrim(url, '/'), '/')[-2] AS second_last, length(url) - length(replace(url, '/', '')) AS depth FROM pages""")
def uri_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", X.bucket_of(u).alias("bucket"), X.key_of(u).alias("key"), X.parent(u).alias("parent"), X.segment_from_end(u, 2).alias("second_last"), X.depth(u).cast("long").alias("depth"))


@query("X7 X20 X35 S8 S31", """WITH n AS (SELECT doc_id, source || '.' || lang || CASE WHEN doc_id % 2 = 0 THEN '.zarr' ELSE '.vrs' END AS name FROM documents)
SELECT doc_id, CASE WHEN name LIKE '%.zarr' THEN left(name, length(name) - 5) ELSE name END AS stem, CASE WHEN name LIKE '%.vrs' THEN left(name, length(name) - 4) || '.json' ELSE name END AS companion,
 'dino.' || regexp_replace(name, '^[^.]*\\.', '') AS renamed FROM n""")
def name_rewrites(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    df = load(spark, d, "documents").selectExpr("doc_id", "source || '.' || lang || CASE WHEN doc_id % 2 = 0 THEN '.zarr' ELSE '.vrs' END AS name")
    return df.select("doc_id", X.without_suffix(name, ".zarr").alias("stem"), X.swapped_suffix(name, ".vrs", ".json").alias("companion"), X.swapped_prefix(name, "dino").alias("renamed"))


@query("X8 X9 X10 X11", f"""WITH {REGISTRY_SQL} SELECT episode_hash, CASE WHEN robot_name LIKE '%left%' THEN 'left' WHEN robot_name LIKE '%right%' THEN 'right' ELSE 'both' END AS arm,
 CASE WHEN task = '' THEN 'unknown' ELSE task END AS task, lower(zarr_processing_error) LIKE '%out of memory%' AS oom,
 CASE WHEN num_frames > 0 THEN '' WHEN num_frames = -2 THEN 'Upload Failed' WHEN num_frames = -1 THEN 'Zero Frames' ELSE 'Conversion Failed Unhandled Error' END AS status FROM registry""")
def registry_decoded(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return registry(spark, d).select("episode_hash", X.arm(c("robot_name")).alias("arm"), X.task_or_unknown(c("task")).alias("task"), X.is_out_of_memory(c("zarr_processing_error")).alias("oom"), X.frames_status(c("num_frames")).alias("status"))


@query("X12 X13 X14 R23", """WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN 'TRUE' WHEN 'error' THEN 't' ELSE 'no' END AS flag, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS STRING) || '%' END AS pct, 'a, b,,' || event_type AS tags FROM events)
SELECT event_id, lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 't') AS flag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END::DOUBLE AS share, 'a|b|' || substr(tags, 7) AS tags FROM t""")
def coercions(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN 'TRUE' WHEN 'error' THEN 't' ELSE 'no' END AS flag", "CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS STRING) || '%' END AS pct", "'a, b,,' || event_type AS tags"
    )
    return df.select("event_id", X.truth(F.col("flag")).alias("flag"), X.percent(F.col("pct")).alias("share"), F.array_join(X.listed(F.col("tags")), "|").alias("tags"))


@query("X15", """SELECT vec_id, CAST(vec_id % 15 AS INTEGER) AS id, ['EVE_RIGHT_ARM','EVE_LEFT_ARM','EVE_BIMANUAL','ARIA_RIGHT_ARM','ARIA_LEFT_ARM','ARIA_BIMANUAL','EVA_RIGHT_ARM','EVA_LEFT_ARM','EVA_BIMANUAL','MECKA_BIMANUAL','MECKA_RIGHT_ARM','MECKA_LEFT_ARM','SCALE_BIMANUAL','SCALE_RIGHT_ARM','SCALE_LEFT_ARM'][CAST(vec_id % 15 AS INTEGER) + 1] AS name, CAST(vec_id % 15 AS INTEGER) AS back FROM embeddings""")
def embodiment_names(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").selectExpr("vec_id", "CAST(vec_id % 15 AS INT) AS id").withColumn("name", X.embodiment_name(F.col("id")))
    return df.select("vec_id", "id", "name", X.embodiment_id(F.lower("name")).alias("back"))


@query("X16 X17 X18 S26 S37", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"text":"' || event_type || '","start_idx":' || CAST(event_id AS STRING) || '}' AS packed FROM events""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").withColumn("p", F.from_json(F.col("props").cast("binary").cast("string"), "k long"))
    return df.select("event_id", "p.k", F.to_json(F.struct(F.col("event_type").alias("text"), F.col("event_id").alias("start_idx"))).alias("packed"))


@query("X4 X38 R9", """WITH s AS (SELECT conv_id, turn, turn * 700000 + conv_id % 13 * 1000 AS us, (turn + 1) * 700000 AS stop FROM conversations)
SELECT conv_id, turn, CAST(trunc(us / 1e6 * 30) AS INTEGER) AS frame, greatest(us - 500000, 0) AS start_us, least(stop - 500000, 3000000) AS end_us FROM s WHERE least(stop - 500000, 3000000) > greatest(us - 500000, 0)""")
def annotation_times(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "conversations").selectExpr("conv_id", "turn", "turn * 700000 + conv_id % 13 * 1000 AS us", "(turn + 1) * 700000 AS stop")
    start, end = F.greatest(F.col("us") - 500000, F.lit(0)), F.least(F.col("stop") - 500000, F.lit(3000000))
    return df.select("conv_id", "turn", X.frame_of_micros(F.col("us"), 30).alias("frame"), start.alias("start_us"), end.alias("end_us")).filter("end_us > start_us")


@query("X27 X28 X29 P8", """WITH s AS (SELECT vec_id, lower(CASE WHEN vec_id % 3 = 0 THEN 'ARIA BIMANUAL' ELSE 'EVA LEFT ARM' END) AS emb, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE array_to_string(list_transform(embedding, lambda x: CAST(least(255, floor((greatest(-1.0, least(1.0, x::DOUBLE)) + 1) * 128))::BIGINT AS STRING)), ' ') END AS state FROM embeddings)
SELECT vec_id, 'Task: sort, Embodiment: ' || emb || ', Control mode: ' || CASE WHEN emb LIKE '%aria%' THEN 'cam frame xyzypr per arm' ELSE 'joint' END || CASE WHEN state IS NULL THEN '' ELSE ', State: ' || state END || ';' || chr(10) || 'Action: ' AS prompt FROM s""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    emb = F.when(F.col("vec_id") % 3 == 0, "aria bimanual").otherwise("eva left arm")
    state = F.when(F.col("vec_id") % 5 != 0, X.state_bins(F.transform("embedding", lambda x: x.cast("double"))))
    return load(spark, d, "embeddings").select("vec_id", X.prompt(F.lit("sort"), emb, X.control_mode(emb, [("EVA", "joint")]), state).alias("prompt"))


@query("X26 X32", """SELECT o_orderkey, CASE WHEN o_totalprice < 1024 THEN 'B' WHEN o_totalprice < 1048576 THEN 'KB' ELSE 'MB' END AS unit FROM orders""")
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.element_at(F.split(X.size_text(F.col("o_totalprice")), " "), 2).alias("unit"))


@query("X36 X39 X33", """SELECT page_id, sha256(url) AS operator_hash, md5(html) AS checksum, regexp_matches(url, '^https?://[a-z.]+/(en|fr)/[0-9]+') AS valid FROM pages""")
def digests(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("operator_hash"), F.md5("html").alias("checksum"), F.col("url").rlike("^https?://[a-z.]+/(en|fr)/[0-9]+").alias("valid"))


@query("A6", """WITH a AS (SELECT conv_id, count(*) FILTER (role = 'user') AS users, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, users, n - users AS others, last FROM a WHERE n > 2""")
def attribute_maps(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    return counts.filter("n > 2").select("conv_id", "users", (F.col("n") - F.col("users")).alias("others"), "last")


@query("S22", """SELECT doc_id, split_part(name, '_', 2) AS episode, label FROM (SELECT doc_id, 'ep_' || CAST(doc_id AS STRING) || '_meta.csv' AS name, coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END, source) AS label FROM documents)""")
def companion_names(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents").selectExpr("doc_id", "'ep_' || CAST(doc_id AS STRING) || '_meta.csv' AS name", "CASE WHEN doc_id % 4 <> 0 THEN lang END AS label", "source")
    return df.select("doc_id", F.try_element_at(F.split("name", "_"), F.lit(2)).alias("episode"), F.coalesce("label", "source").alias("label"))
