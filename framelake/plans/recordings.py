"""Queries over recordings: status reports, rebuilds of the registry, label attributes, array shapes and health figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import arrays as A
from framelake.functions import geometry as G
from framelake.operators import quality as Q
from framelake.operators import registry as R
from framelake.operators import windows as W
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, REGISTRY_SQL, frames, load, registry


@query("K18 K9", """WITH o AS (SELECT user_id AS recording, event_type AS feature, count(*) AS n, 'seen' AS status FROM events GROUP BY ALL), f AS (SELECT user_id AS recording, event_type AS feature, count(*) AS n, 'checked' AS status FROM events WHERE value > 50 GROUP BY ALL)
SELECT recording, feature, coalesce(f.n, o.n) AS n, coalesce(f.status, o.status) AS status FROM o FULL JOIN f USING (recording, feature)""")
def status_report_merge(spark: SparkSession, d: str) -> DataFrame:
    """A new report over an old one, by recording and feature."""
    report = lambda e, s: e.groupBy(F.col("user_id").alias("recording"), F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit(s))
    e = load(spark, d, "events")
    return R.upsert(report(e, "seen"), report(e.filter("value > 50"), "checked"), ["recording", "feature"])


@query("K7", f"WITH {REGISTRY_SQL} SELECT l.doc_id, CAST(l.quality AS BIGINT) AS quality FROM labels l WHERE CAST(l.doc_id AS STRING) IN (SELECT episode_hash FROM registry)")
def registry_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an insert whose key is taken."""
    new = load(spark, d, "labels").selectExpr("CAST(doc_id AS STRING) AS episode_hash", "doc_id", "CAST(quality AS LONG) AS quality")
    return R.conflicts(registry(spark, d).select("episode_hash"), new, ["episode_hash"]).select("doc_id", "quality")


@query("K4 F12", f"WITH {REGISTRY_SQL} SELECT episode_hash, num_frames, TRUE AS had_task, FALSE AS had_depth FROM registry")
def removed_keys(spark: SparkSession, d: str) -> DataFrame:
    df = registry(spark, d).select("episode_hash", "num_frames", "task")
    had = R.has_keys(df, ["task", "depth"])
    return df.drop("task").withColumns({f"had_{k}": F.lit(v) for k, v in had.items()})


@query("J16", f"""WITH {REGISTRY_SQL}, m AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 1500) SELECT episode_hash FROM registry r WHERE EXISTS (SELECT 1 FROM m WHERE m.source = r.operator AND m.lang = r.task)""")
def rows_to_update(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows whose pair of columns is among the missing ones."""
    missing = load(spark, d, "documents").filter("n_chars > 1500").select(F.col("source").alias("operator"), F.col("lang").alias("task"))
    return registry(spark, d).join(missing, ["operator", "task"], "left_semi").select("episode_hash")


@query("F20", "WITH t AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), r AS (SELECT DISTINCT lang FROM documents WHERE n_chars > 20000) SELECT source, lang, n FROM t WHERE n > 1 AND lang NOT IN (SELECT lang FROM r WHERE lang IS NOT NULL)")
def repeated_tasks_kept(spark: SparkSession, d: str) -> DataFrame:
    """Keys that repeat, without those of a remove list."""
    docs = load(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    gone = docs.filter("n_chars > 20000").select("lang").distinct()
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(gone, "lang", "left_anti").select("source", "lang", "n")


@query("R2 K9", f"""WITH {REGISTRY_SQL}, m AS (SELECT CAST(d.doc_id AS STRING) AS episode_hash, coalesce(l.q, -1) AS quality, CASE WHEN p.page_id IS NULL THEN '' ELSE 's3://store/' || CAST(d.doc_id AS STRING) END AS zarr_processed_path
FROM documents d LEFT JOIN (SELECT doc_id, CAST(max(quality) AS BIGINT) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = d.doc_id WHERE d.doc_id % 2 = 0)
SELECT r.episode_hash, coalesce(m.zarr_processed_path, r.zarr_processed_path) AS zarr_processed_path, m.quality FROM registry r LEFT JOIN m ON m.episode_hash = r.episode_hash""")
def rebuilt_registry(spark: SparkSession, d: str) -> DataFrame:
    """Metadata with descriptions and presence as rows, upserted into the registry."""
    meta = load(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id")
    described = load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    there = load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("there")).distinct()
    path = F.when(F.col("there"), F.concat(F.lit("s3://store/"), F.col("doc_id").cast("string"))).otherwise("")
    rows = meta.join(described, "doc_id", "left").join(there, "doc_id", "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("episode_hash"), path.alias("zarr_processed_path"), F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))
    old = registry(spark, d).select("episode_hash", "zarr_processed_path")
    return R.upsert(old, rows, ["episode_hash"])


@query("R10", """WITH s AS (SELECT DISTINCT source, n_chars AS frames, lang FROM documents WHERE n_chars > 100 AND source IS NOT NULL)
SELECT source, frames, lang, row_number() OVER (PARTITION BY source ORDER BY frames, lang) AS step FROM s""")
def convergence_series(spark: SparkSession, d: str) -> DataFrame:
    """Distinct measurements of each series in the order of their frames."""
    rows = load(spark, d, "documents").filter("n_chars > 100 AND source IS NOT NULL").select("source", F.col("n_chars").alias("frames"), "lang").distinct()
    return rows.withColumn("step", F.row_number().over(W.over("source", "frames").orderBy("frames", F.col("lang").asc_nulls_last())).cast("long"))


@query("R14", """SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - o_totalprice), 4) AS gap FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY gap DESC, l_orderkey, l_linenumber LIMIT 20""")
def largest_differences(spark: SparkSession, d: str) -> DataFrame:
    """A report of the twenty rows that differ most between two sources."""
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    rows = load(spark, d, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("l_extendedprice") - F.col("o_totalprice")), 4).alias("gap"))
    return rows.orderBy(F.desc("gap"), "l_orderkey", "l_linenumber").limit(20)


@query("X37", """WITH a AS (SELECT event_id, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN 'Yes' ELSE 'No' END AS mistake, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'Adjust' ELSE 'Move' END AS act FROM events)
SELECT event_id, kind || ' ' || act AS text FROM a WHERE mistake <> 'Yes' AND act IS NOT NULL AND act <> 'Adjust'""")
def instructions(spark: SparkSession, d: str) -> DataFrame:
    """Attribute lists of clips as maps; mistakes, adjustments and clips without an action go."""
    one = lambda n, v: F.struct(F.lit(n).alias("name"), F.array(v).alias("values"))
    action = F.when(F.col("event_id") % 5 == 1, "Adjust").when(F.col("event_id") % 5 != 0, "Move")
    given = F.array(one("Mistake", F.when(F.col("event_id") % 7 == 0, "Yes").otherwise("No")), one("Kind", F.col("event_type")), one("Action", action))
    listed = F.filter(given, lambda x: x["values"][0].isNotNull())
    df = load(spark, d, "events").select("event_id", A.attribute_map(listed).alias("m")).filter(A.is_instruction(F.col("m")))
    return df.select("event_id", F.concat_ws(" ", F.col("m")["Kind"], F.col("m")["Action"]).alias("text"))


@query("X24 R22", """WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(0, 8), lambda i: x[i * 8 + 4] * (i + 1))), 5) AS column_sum, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS code, round(x[32], 6) AS middle, CAST(2 * len(x) AS BIGINT) AS n FROM e""")
def array_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as eight rows, a column of them, labels as one-hot codes, each value twice."""
    x = F.col("embedding").cast("array<double>")
    rows = A.gathered(A.reshaped(x, 8), 3)
    weighted = F.aggregate(F.transform(rows, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    twice = A.repeated(x, 2)
    return load(spark, d, "embeddings").select("vec_id", F.round(weighted, 5).alias("column_sum"), F.array_join(A.one_hot(F.col("label"), 10).cast("array<string>"), "").alias("code"), F.round(F.get(twice, F.lit(63)), 6).alias("middle"), F.size(twice).cast("long").alias("n"))


@query("X25", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), r AS (SELECT vec_id, x, unnest(range(0, 8)) AS i FROM e)
SELECT vec_id, i, round(x[i * 8 + 4], 6) AS first, round(x[i * 8 + 1], 6) AS fourth FROM r""")
def split_and_joined(spark: SparkSession, d: str) -> DataFrame:
    """Rows cut after three values and joined the other way round."""
    a, b, c = A.split_last(A.reshaped(F.col("embedding").cast("array<double>"), 8), [3, 3, 2])
    rows = load(spark, d, "embeddings").select("vec_id", F.posexplode(A.joined_last(b, A.joined_last(a, c))).alias("i", "r"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("r")[0], 6).alias("first"), F.round(F.col("r")[3], 6).alias("fourth"))


@query("W14 F18", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT vec_id, CAST(len(list_filter(range(1, len(x)), lambda i: abs(x[i + 1] - x[i]) > 0.2)) AS BIGINT) AS jumps, round(x[len(x)] - x[1], 5) AS total FROM e""")
def sliding_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Steps between neighbours of a track, a zero after the last: how many are large, and their sum."""
    s = A.steps(F.col("embedding").cast("array<double>"))
    return load(spark, d, "embeddings").select("vec_id", F.size(F.filter(s, lambda v: F.abs(v) > 0.2)).cast("long").alias("jumps"), F.round(F.aggregate(s, F.lit(0.0), lambda t, v: t + v), 5).alias("total"))


@query("W19", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings) SELECT vec_id, round(x[CAST(floor(9 * len(x) / 10) AS BIGINT) + 1] - x[1], 6) AS lag FROM e""")
def interval_lag(spark: SparkSession, d: str) -> DataFrame:
    """The last of ten points at equal distances against the first."""
    p = A.sampled(F.col("embedding").cast("array<double>"), 10)
    return load(spark, d, "embeddings").select("vec_id", F.round(F.get(p, F.lit(9)) - F.get(p, F.lit(0)), 6).alias("lag"))


@query("W13 Q13", f"""WITH {FRAMES_SQL} SELECT episode, t, kind <> 'error' AND bool_and(value < 80) OVER w AND bool_and(event_id % 11 <> 0) OVER w AND count(*) OVER w = 5 AS ok FROM frames WINDOW w AS (PARTITION BY episode ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def head_and_hands_valid(spark: SparkSession, d: str) -> DataFrame:
    """The head at a frame and both hands on the whole window from it on."""
    hands = (F.col("value") < 80) & (F.col("event_id") % 11 != 0)
    return W.valid_ahead(frames(spark, d), hands, 5).select("episode", "t", (F.col("ok") & (F.col("kind") != "error")).alias("ok"))


@query("A4", f"""WITH {FRAMES_SQL} SELECT episode, round(avg(value) FILTER (kind <> 'error'), 6) AS mean FROM frames GROUP BY episode""")
def episode_means(spark: SparkSession, d: str) -> DataFrame:
    """Means without NaN; NaN for an episode that has nothing else."""
    score = F.when(F.col("kind") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return frames(spark, d).groupBy("episode").agg(F.round(F.coalesce(F.avg(F.nanvl(score, F.lit(None).cast("double"))), F.lit(float("nan"))), 6).alias("mean"))


@query("A7 A8", """SELECT l_orderkey AS recording, count(DISTINCT l_linenumber) = max(n) AS complete, CASE WHEN min(l_suppkey) >= 2 THEN max(l_linenumber) + 1 END AS span FROM lineitem, (SELECT max(l_linenumber) AS n FROM lineitem) GROUP BY l_orderkey""")
def landmark_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a recording has all landmarks, and its span; none where a frame is below the first."""
    items = load(spark, d, "lineitem")
    every = items.agg(F.max("l_linenumber").alias("n"))
    seen = items.groupBy(F.col("l_orderkey").alias("recording")).agg(F.count_distinct("l_linenumber").alias("k"), F.max("l_linenumber").alias("last"), F.min("l_suppkey").alias("least"))
    return seen.crossJoin(F.broadcast(every)).select("recording", (F.col("k") == F.col("n")).alias("complete"), F.when(F.col("least") >= 2, F.col("last") + 1).alias("span"))


@query("A14", """WITH e AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings), n AS (SELECT label, p, sqrt(p[4]*p[4] + p[5]*p[5] + p[6]*p[6] + p[7]*p[7]) AS n FROM e),
q AS (SELECT label, p, p[4]/n AS x, p[5]/n AS y, p[6]/n AS z, p[7]/n AS w FROM n)
SELECT label, round(var_samp(p[1]), 6) AS vx, round(var_samp(p[2]), 6) AS vy, round(var_samp(p[3]), 6) AS vz, round(var_samp(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))), 5) AS vyaw FROM q GROUP BY label""")
def pose_variance(spark: SparkSession, d: str) -> DataFrame:
    """Sample variance of places and yaw of poses (x, y, z, and a quaternion with w last)."""
    pose = F.slice(F.col("embedding").cast("array<double>"), 1, 7)
    turn = G.quaternion_to_ypr(G.xyzw_to_wxyz(G.unit_quaternion(pose)))
    df = load(spark, d, "embeddings").select("label", pose.alias("p"), turn[0].alias("yaw"))
    places = [F.round(F.var_samp(F.col("p")[i]), 6).alias(n) for i, n in enumerate(("vx", "vy", "vz"))]
    return df.groupBy("label").agg(*places, F.round(F.var_samp("yaw"), 5).alias("vyaw"))


@query("A25", """SELECT label, round(100.0 * count(*) FILTER (list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) > 0.3) / count(*), 6) AS rate FROM embeddings GROUP BY label""")
def violation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Percent of vectors with a value out of bounds."""
    out = F.exists("embedding", lambda v: F.abs(v.cast("double")) > 0.3)
    return load(spark, d, "embeddings").groupBy("label").agg(Q.rate(out).alias("rate"))
