"""Queries on validation rules and data health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import scalars as X
from framelake.operators import quality as Q
from framelake.operators import registry as R
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, REGISTRY_SQL, SPANS_SQL, frames, load, registry, spans


@query("Q1 Q4 K1 D19", f"""WITH {REGISTRY_SQL}, r AS (SELECT episode_hash, unnest(['embodiment', 'robot', 'frames', 'task', 'path']) AS rule, unnest([embodiment IN ('aria', 'eva'), trim(robot_name) <> '', num_frames > 0, task <> '', zarr_processed_path LIKE 's3://%']) AS ok, unnest([embodiment, coalesce(robot_name, ''), CAST(num_frames AS STRING), task, coalesce(zarr_processed_path, '')]) AS detail FROM registry)
SELECT episode_hash, rule, detail FROM r WHERE NOT coalesce(ok, FALSE)""")
def episode_violations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = {
        "embodiment": (c("embodiment").isin("aria", "eva"), c("embodiment")), "robot": (F.trim("robot_name") != "", c("robot_name")), "frames": (c("num_frames") > 0, c("num_frames")),
        "task": (c("task") != "", c("task")), "path": (c("zarr_processed_path").startswith("s3://"), c("zarr_processed_path")),
    }
    return Q.violations(registry(spark, d), "episode_hash", rules)


@query("Q2 F17", """WITH e AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: x::DOUBLE) AS p FROM embeddings), r AS (SELECT vec_id, abs(sqrt(p[4]*p[4]+p[5]*p[5]+p[6]*p[6]+p[7]*p[7]) - 1) < 1e-4 AS ok FROM e) SELECT vec_id, 'unit quaternion' AS rule, '' AS detail FROM r WHERE NOT ok""")
def pose_violations(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 7).cast("array<double>").alias("pose"))
    return Q.violations(df, "vec_id", Q.pose_rules(F.col("pose")))


@query("Q1 D19 A24", f"""WITH {SPANS_SQL}, n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode), s AS (SELECT s.*, n.n, s.episode * 1000 + s.ordinal AS span FROM spans s JOIN n ON n.episode = s.episode)
SELECT span, 'span inside' AS rule, CAST(end_idx AS STRING) AS detail FROM s WHERE end_idx > n UNION ALL SELECT span, 'span order', CAST(end_idx AS STRING) FROM s WHERE start_idx >= end_idx""")
def span_violations(spark: SparkSession, d: str) -> DataFrame:
    sizes = frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    df = spans(spark, d).join(sizes, "episode").withColumn("span", F.col("episode") * 1000 + F.col("ordinal"))
    return Q.violations(df, "span", Q.span_rules(F.col("start_idx"), F.col("end_idx"), F.col("n")))


@query("Q17", f"""WITH {FRAMES_SQL}, e AS (SELECT episode, min(epoch_us(ts) // 1000000) AS started, max(CASE WHEN kind = 'purchase' THEN epoch_us(ts) // 1000000 END) AS worked FROM frames GROUP BY episode), m AS (SELECT max(epoch_us(ts) // 1000000) AS now FROM events),
r AS (SELECT episode, CASE WHEN now - started > 2590000 THEN 'too old' WHEN now - coalesce(worked, started) > 100000 THEN 'idle' END AS reason FROM e, m) SELECT * FROM r WHERE reason IS NOT NULL""")
def idle_workers(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    df = df.crossJoin(F.broadcast(df.agg(F.max("at").alias("now"))))
    seen = df.groupBy("episode", "now").agg(F.min("at").alias("started"), F.max(F.when(F.col("kind") == "purchase", F.col("at"))).alias("worked"))
    return Q.idle_reason(seen, "episode", F.col("now"), 100000, 2590000)


@query("Q18 J14", """WITH a AS (SELECT doc_id, count(*) AS n, min(n_chars) AS x FROM documents GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS m, min(CASE WHEN doc_id % 9 = 0 THEN -1 ELSE n_chars END) AS x FROM documents JOIN labels USING (doc_id) GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'only left' ELSE 'n_chars' END AS problem FROM a LEFT JOIN b ON b.doc_id = a.doc_id WHERE b.doc_id IS NULL OR a.x <> b.x""")
def registry_consistency(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    right = docs.join(load(spark, d, "labels").select("doc_id"), "doc_id").withColumn("n_chars", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("n_chars")))
    return Q.inconsistent(docs, right, "doc_id", ["n_chars"])


@query("R19 X18", """SELECT event_id, coalesce(json_extract_string(props, '$.embodiment'), json_extract_string(props, '$.meta.embodiment'), json_extract_string(props, '$.k')) AS embodiment FROM events""")
def embodiment_from_metadata(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p: F.get_json_object("props", p)
    return load(spark, d, "events").select("event_id", F.coalesce(at("$.embodiment"), at("$.meta.embodiment"), at("$.k")).alias("embodiment"))


@query("R17 X39", """WITH b AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY user_id) SELECT user_id, md5(array_to_string(l, '')) AS block, l[3] AS third FROM b""")
def frame_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Frames of an episode in one block with their lengths, and one read back by its offset."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    df = load(spark, d, "events").groupBy("user_id").agg(rows.alias("r")).withColumn("r", F.col("r.event_type"))
    df = df.withColumn("block", F.array_join("r", "")).withColumn("sizes", F.transform("r", lambda x: F.length(x)))
    start = F.aggregate(F.slice("sizes", 1, 2), F.lit(0), lambda s, x: s + x)
    return df.select("user_id", F.md5("block").alias("block"), F.substr(F.col("block"), start + 1, F.col("sizes")[2]).alias("third"))


@query("F10 F15", """WITH k AS (SELECT event_type AS key_name, CASE WHEN event_type = 'view' THEN 'camera_keys' WHEN event_type = 'error' THEN 'annotation_keys' ELSE 'action_keys' END AS key_type, 'obs.' || event_type AS zarr_key, user_id % 3 AS embodiment FROM events)
SELECT embodiment, key_name, key_type, zarr_key, count(*) AS n FROM k WHERE key_type NOT IN ('camera_keys', 'annotation_keys') GROUP BY ALL""")
def schematic_keys(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "camera_keys").when(F.col("event_type") == "error", "annotation_keys").otherwise("action_keys")
    df = load(spark, d, "events").select((F.col("user_id") % 3).alias("embodiment"), F.col("event_type").alias("key_name"), kind.alias("key_type"), F.concat(F.lit("obs."), "event_type").alias("zarr_key"))
    return df.filter(~F.col("key_type").isin("camera_keys", "annotation_keys")).groupBy("embodiment", "key_name", "key_type", "zarr_key").agg(F.count(F.lit(1)).alias("n"))


@query("K3 D9", f"""WITH {SPANS_SQL} SELECT episode, 'main' AS track, text, start_idx, end_idx FROM spans UNION ALL SELECT episode, 'new', kind, t, t + 1 FROM frames WHERE kind = 'purchase'""")
def appended_annotations(spark: SparkSession, d: str) -> DataFrame:
    new = frames(spark, d).filter("kind = 'purchase'").selectExpr("episode", "'new' AS track", "kind AS text", "t AS start_idx", "t + 1 AS end_idx")
    return spans(spark, d).selectExpr("episode", "'main' AS track", "text", "start_idx", "end_idx").unionByName(new)


@query("M8 K6", f"""WITH {FRAMES_SQL}, c AS (SELECT episode, CASE WHEN episode % 3 = 0 THEN 0 ELSE episode END AS raw_total FROM (SELECT DISTINCT episode FROM frames WHERE episode % 2 = 0)), n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode)
SELECT n.episode, coalesce(nullif(c.raw_total, 0), n.n) AS total, coalesce(c.raw_total, 0) <> 0 AS hit FROM n LEFT JOIN c ON c.episode = n.episode""")
def cached_or_computed(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d)
    cache = df.filter("episode % 2 = 0").select("episode").distinct().withColumn("raw_total", F.when(F.col("episode") % 3 == 0, 0).otherwise(F.col("episode")))
    fresh = df.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    good = F.nullif(F.col("raw_total"), F.lit(0).cast("long"))
    return fresh.join(cache, "episode", "left").select("episode", F.coalesce(good, "n").alias("total"), good.isNotNull().alias("hit"))


@query("K19 X10", f"""WITH {REGISTRY_SQL} SELECT CASE WHEN lower(zarr_processing_error) LIKE '%out of memory%' THEN 'oom' WHEN zarr_processing_error <> '' THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(num_frames) AS BIGINT) AS frames FROM registry GROUP BY 1""")
def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("zarr_processing_error")
    status = F.when(X.is_out_of_memory(e), "oom").when(R.present(e).isNotNull(), "failed").otherwise("ok")
    return registry(spark, d).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("num_frames").alias("frames"))
