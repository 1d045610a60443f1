"""Queries on the episode registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import scalars as X
from framelake.operators import joins as J
from framelake.operators import registry as R
from framelake.plans.registry import query
from framelake.plans.standins import REGISTRY_SQL, load, registry

_LIVE = "NOT coalesce(is_deleted, FALSE)"
_ROBOT = "CASE WHEN trim(robot_name) <> '' THEN robot_name ELSE embodiment END"


@query("S1 F1 F6 F7", f"WITH {REGISTRY_SQL} SELECT episode_hash, {_ROBOT} AS robot_name, task FROM registry WHERE {_LIVE} AND embodiment = 'aria' AND trim(coalesce(zarr_processed_path, '')) <> ''")
def registry_active(spark: SparkSession, d: str) -> DataFrame:
    df = R.normalize(registry(spark, d))
    return R.where_all(df, ["embodiment = 'aria'", "trim(coalesce(zarr_processed_path, '')) <> ''"]).select("episode_hash", "robot_name", "task")


@query("S2", f"WITH {REGISTRY_SQL} SELECT episode_hash, operator, task, num_frames FROM registry WHERE doc_id = (SELECT max(doc_id) FROM registry)")
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    df = registry(spark, d)
    return df.join(df.agg(F.max("doc_id").alias("doc_id")), "doc_id", "left_semi").select("episode_hash", "operator", "task", "num_frames")


@query("S3 S9", f"WITH {REGISTRY_SQL} SELECT episode_hash, task FROM registry WHERE doc_id IN (SELECT doc_id FROM labels) AND task <> ''")
def registry_in_list(spark: SparkSession, d: str) -> DataFrame:
    wanted = load(spark, d, "labels").select("doc_id")
    return R.choose(registry(spark, d), "doc_id", include=[wanted]).filter("task <> ''").select("episode_hash", "task")


@query("F2", f"WITH {REGISTRY_SQL} SELECT episode_hash, operator FROM registry WHERE {_LIVE} AND operator IN (SELECT operator FROM registry WHERE {_LIVE} GROUP BY operator HAVING count(*) > 40)")
def registry_large_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.where_group_larger(R.where_all(registry(spark, d), []), "operator", 40).select("episode_hash", "operator")


@query("F3", f"WITH {REGISTRY_SQL} SELECT 'aria-all' AS preset, episode_hash FROM registry WHERE {_LIVE} AND embodiment = 'aria' UNION ALL SELECT 'eva-all', episode_hash FROM registry WHERE {_LIVE} AND embodiment = 'eva'")
def registry_presets(spark: SparkSession, d: str) -> DataFrame:
    df = registry(spark, d)
    one = lambda p: R.where_all(df, R.preset(p)).select(F.lit(p).alias("preset"), "episode_hash")
    return one("aria-all").unionByName(one("eva-all"))


@query("F4 J4", f"WITH {REGISTRY_SQL} SELECT episode_hash, task FROM registry WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def registry_completed(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "labels").filter("quality = 1")
    return R.choose(registry(spark, d), "doc_id", include=[done]).select("episode_hash", "task")


@query("F5", f"WITH {REGISTRY_SQL} SELECT episode_hash FROM registry WHERE task = 'en' AND embodiment = 'mecka' AND zarr_processed_path IS NOT NULL")
def registry_equal(spark: SparkSession, d: str) -> DataFrame:
    return R.where_equal(registry(spark, d), "zarr_processed_path", task="en", embodiment="mecka").select("episode_hash")


@query("F8 U3 S12 S13 S35", f"WITH {REGISTRY_SQL} SELECT episode_hash FROM registry WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM registry WHERE num_frames > 300) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def registry_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    df, labels = registry(spark, d), load(spark, d, "labels")
    return R.choose(df, "doc_id", include=[labels, df.filter("num_frames > 300")], exclude=[labels.filter("toxic = 1")]).select("episode_hash")


@query("F16 R3", f"""WITH {REGISTRY_SQL}, b AS (SELECT p.page_id, r.*, r.doc_id IS NOT NULL AS known, p.page_id % 10 <> 3 AS listed FROM pages p LEFT JOIN registry r ON r.doc_id = p.page_id * 3)
SELECT page_id, CASE WHEN NOT listed THEN 'not listed' WHEN NOT known THEN 'no row' WHEN trim(zarr_processed_path) <> '' THEN 'done' WHEN coalesce(zarr_processing_error, '') <> '' THEN 'has error' WHEN coalesce(is_deleted, FALSE) THEN 'deleted' END AS reason FROM b""")
def conversion_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    bundles = load(spark, d, "pages").selectExpr("page_id", "page_id * 3 AS doc_id", "page_id % 10 <> 3 AS listed")
    df = bundles.join(registry(spark, d).withColumn("known", F.lit(True)), "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return df.select("page_id", R.skip_reason().alias("reason"))


@query("F19 S16", f"WITH {REGISTRY_SQL} SELECT episode_hash, num_frames FROM registry WHERE num_frames >= 500 AND doc_id IN (SELECT doc_id FROM labels)")
def catalog_min_frames(spark: SparkSession, d: str) -> DataFrame:
    return R.choose(registry(spark, d), "doc_id", include=[load(spark, d, "labels")]).filter("num_frames >= 500").select("episode_hash", "num_frames")


@query("F20 A13", "SELECT task, n FROM (SELECT lang || source AS task, count(*) AS n FROM documents GROUP BY 1) WHERE n > 5")
def duplicate_task_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_keys(load(spark, d, "documents").select(F.concat("lang", "source").alias("task")), "task").filter("n > 5")


_NEW = "SELECT CAST(doc_id AS STRING) AS episode_hash, 'relabelled' AS task, doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT 'new-' || CAST(page_id AS STRING), 'fresh', -page_id - 1 FROM pages"


def _new(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "labels").filter("toxic = 1").selectExpr("CAST(doc_id AS STRING) AS episode_hash", "'relabelled' AS task", "doc_id")
    return a.unionByName(load(spark, d, "pages").selectExpr("'new-' || CAST(page_id AS STRING) AS episode_hash", "'fresh' AS task", "-page_id - 1 AS doc_id"))


@query("K9 K17 K18 U6", f"WITH {REGISTRY_SQL}, fresh AS ({_NEW}) SELECT episode_hash, task, doc_id FROM fresh UNION ALL SELECT episode_hash, task, doc_id FROM registry WHERE episode_hash NOT IN (SELECT episode_hash FROM fresh)")
def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    return R.upsert(registry(spark, d).select("episode_hash", "task", "doc_id"), _new(spark, d), ["episode_hash"])


@query("K7", f"WITH {REGISTRY_SQL}, fresh AS ({_NEW}) SELECT episode_hash, task, doc_id FROM registry UNION ALL SELECT episode_hash, task, doc_id FROM fresh WHERE episode_hash NOT IN (SELECT episode_hash FROM registry)")
def registry_insert(spark: SparkSession, d: str) -> DataFrame:
    return R.insert(registry(spark, d).select("episode_hash", "task", "doc_id"), _new(spark, d), ["episode_hash"])


@query("K8", f"WITH {REGISTRY_SQL}, fresh AS ({_NEW}) SELECT r.episode_hash, coalesce(f.task, r.task) AS task, r.num_frames FROM registry r LEFT JOIN fresh f ON f.episode_hash = r.episode_hash")
def registry_update(spark: SparkSession, d: str) -> DataFrame:
    return R.update(registry(spark, d).select("episode_hash", "task", "num_frames"), _new(spark, d).select("episode_hash", "task"), ["episode_hash"])


@query("K10", f"WITH {REGISTRY_SQL} SELECT episode_hash FROM registry WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def registry_delete(spark: SparkSession, d: str) -> DataFrame:
    return R.delete(registry(spark, d), load(spark, d, "labels").filter("quality = 0"), "doc_id").select("episode_hash")


@query("K11", f"WITH {REGISTRY_SQL}, m AS (SELECT episode_hash, trim(coalesce(zarr_processed_path, '')) = '' AS blank, coalesce(is_deleted, FALSE) AS del FROM registry) SELECT episode_hash, blank OR del AS is_deleted, blank AND NOT del AS changed FROM m")
def registry_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return R.soft_delete_blank(registry(spark, d), "zarr_processed_path").select("episode_hash", "is_deleted", "changed")


@query("K12 K13", f"WITH {REGISTRY_SQL} SELECT episode_hash, CASE WHEN coalesce(is_deleted, FALSE) THEN '' ELSE zarr_processed_path END AS zarr_processed_path, '' AS zarr_mp4_path FROM registry")
def registry_reset_and_migrate(spark: SparkSession, d: str) -> DataFrame:
    df = R.add_columns(registry(spark, d), {"zarr_mp4_path": "", "task": "never used"})
    return R.reset(df, ["zarr_processed_path"], F.coalesce("is_deleted", F.lit(False))).select("episode_hash", "zarr_processed_path", "zarr_mp4_path")


@query("J1 U4 K21 K23 J16 J5 J14 S11", f"""WITH {REGISTRY_SQL}, r AS (SELECT DISTINCT operator || '/' || task AS prefix FROM registry WHERE {_LIVE}), f AS (SELECT DISTINCT source || '/' || lang AS prefix FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(r.prefix, f.prefix) AS prefix, CASE WHEN f.prefix IS NULL THEN 'missing' WHEN r.prefix IS NULL THEN 'orphan' ELSE 'matched' END AS state FROM r FULL JOIN f ON r.prefix = f.prefix""")
def reconcile_prefixes(spark: SparkSession, d: str) -> DataFrame:
    required = R.where_all(registry(spark, d), []).select(F.concat_ws("/", "operator", "task").alias("prefix"))
    found = load(spark, d, "documents").filter("doc_id % 2 = 0").select(F.concat_ws("/", "source", "lang").alias("prefix"))
    return R.reconcile(required, found, "prefix")


@query("J2 X1 X2 X3", """WITH b AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events), h AS (SELECT event_id, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%d-%H-%M-%S-') || lpad(CAST((ms % 1000) * 1000 AS STRING), 6, '0') AS hash FROM b)
SELECT event_id, ms, hash, ms AS back FROM h""")
def timestamp_hashes(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    df = df.withColumn("hash", X.hash_of_millis(F.col("ms")))
    bundles = df.select("hash", X.millis_of_hash(F.col("hash")).alias("back")).distinct()
    return df.join(bundles, "hash").select("event_id", "ms", "hash", "back")


@query("J3 A6", f"""WITH {REGISTRY_SQL}, t AS (SELECT p.page_id, coalesce(CASE WHEN r.task IN ('', 'nan', 'null') THEN NULL ELSE r.task END, 'unknown') AS task FROM pages p LEFT JOIN registry r ON r.doc_id = p.page_id * 11)
SELECT task, count(*) AS n, min(page_id) AS first_page FROM t GROUP BY task""")
def episodes_by_task(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages").selectExpr("page_id", "page_id * 11 AS doc_id")
    df = pages.join(registry(spark, d).select("doc_id", "task"), "doc_id", "left").withColumn("task", X.task_or_unknown(F.col("task")))
    return df.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("J6", "SELECT source AS task_id, arg_min(lang, doc_id) AS hash FROM documents GROUP BY source")
def first_lookup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.col("source").alias("task_id")).agg(F.min_by("lang", "doc_id").alias("hash"))


@query("J12 R4", """SELECT l.l_orderkey AS k, l.l_linenumber AS line, coalesce(CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE 'direct ' || CAST(s.s_suppkey AS STRING) END, r.r_name) AS model
FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def chain_lookup(spark: SparkSession, d: str) -> DataFrame:
    steps = [
        (load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("direct "), F.col("s_suppkey").cast("string"))).alias("direct")), "l_suppkey"),
        (load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey"),
        (load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey"),
    ]
    df = J.chain(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), steps)
    return df.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.coalesce("direct", "r_name").alias("model"))


@query("U1 U5", f"""WITH {REGISTRY_SQL}, p AS (SELECT doc_id, 0 AS part FROM registry WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM registry WHERE doc_id % 3 = 0) SELECT doc_id, min(part) AS part FROM p GROUP BY doc_id""")
def union_first_wins(spark: SparkSession, d: str) -> DataFrame:
    df = registry(spark, d).select("doc_id")
    return R.first_wins([df.filter("doc_id % 2 = 0"), df.filter("doc_id % 3 = 0")], "doc_id")


@query("U2", "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def union_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "labels").select("doc_id").union(load(spark, d, "documents").filter("lang = 'fr'").select("doc_id")).distinct()


@query("R1", f"""WITH {REGISTRY_SQL}, k AS (SELECT page_id * 7 AS doc_id FROM pages) SELECT k.doc_id, CASE WHEN r.doc_id IS NULL THEN 'not found' WHEN trim(coalesce(r.zarr_processed_path, '')) = '' THEN 'empty' ELSE 'ok' END AS reason FROM k LEFT JOIN registry r ON r.doc_id = k.doc_id""")
def path_lookup_reason(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "pages").selectExpr("page_id * 7 AS doc_id")
    df = keys.join(registry(spark, d).select("doc_id", "zarr_processed_path", F.lit(True).alias("known")), "doc_id", "left")
    return df.select("doc_id", F.when(F.col("known").isNull(), "not found").when(R.present("zarr_processed_path").isNull(), "empty").otherwise("ok").alias("reason"))


@query("R5 X7 K22", f"""WITH {REGISTRY_SQL} SELECT episode_hash, zarr_processed_path AS old_path, regexp_replace(zarr_processed_path, '/[^/]*$', '') || '/episode-' || episode_hash AS new_path FROM registry WHERE trim(coalesce(zarr_processed_path, '')) <> '' AND zarr_processed_path NOT LIKE '%/episode-%'""")
def path_rewrite(spark: SparkSession, d: str) -> DataFrame:
    df = registry(spark, d).filter(R.present("zarr_processed_path").isNotNull() & ~F.col("zarr_processed_path").contains("/episode-"))
    return df.select("episode_hash", F.col("zarr_processed_path").alias("old_path"), F.concat(X.parent(F.col("zarr_processed_path")), F.lit("/episode-"), "episode_hash").alias("new_path"))


@query("J20", "SELECT a, min(b) AS b FROM (SELECT DISTINCT source AS a FROM documents) l JOIN (SELECT DISTINCT source || lang AS b FROM documents) r ON starts_with(b, a) OR starts_with(a, b) GROUP BY a")
def companion_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return J.first_prefix_match(docs.select(F.col("source").alias("a")).distinct(), docs.select(F.concat("source", "lang").alias("b")).distinct(), "a", "b", 4)


@query("S33 S31", """WITH c AS (SELECT doc_id, unnest([1, 2, 3]) AS k, unnest([doc_id * 3, doc_id * 5 + 1, doc_id - 7]) AS page_id FROM documents) SELECT doc_id, arg_min(c.page_id, k) AS page_id FROM c JOIN pages p ON p.page_id = c.page_id GROUP BY doc_id""")
def companion_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first of several candidate keys that is there."""
    candidates = load(spark, d, "documents").selectExpr("doc_id", "posexplode(array(doc_id * 3, doc_id * 5 + 1, doc_id - 7)) AS (k, page_id)")
    hits = candidates.join(load(spark, d, "pages").select("page_id"), "page_id", "left_semi")
    return hits.groupBy("doc_id").agg(F.min_by("page_id", "k").alias("page_id"))
