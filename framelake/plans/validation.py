"""Queries on the validity of episodes and samples, and on statistics that are saved and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import interp as I
from framelake.operators import evaluation as E
from framelake.operators import joins as J
from framelake.operators import statistics as S
from framelake.operators import validation as V
from framelake.plans.arrays import _E, _vectors
from framelake.plans.registry import query
from framelake.plans.standins import SPANS_SQL, frames, load, spans
from framelake.plans.statistics import _dims
from framelake.sources.scratch import steps


def _episodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels as episodes: their vectors are frames with two poses, a gripper, landmarks and a note each."""
    df = _vectors(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).withColumnRenamed("label", "episode")
    even = F.col("episode") % 2 == 0
    meta = df.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    fields = F.struct(F.when(F.col("episode") != 3, "eva").alias("embodiment"), (F.col("n") + F.when(F.col("episode") == 4, 2).otherwise(0)).alias("total_frames"), F.when(F.col("episode") == 5, 25).otherwise(30).alias("fps"), F.lit("fold").alias("task_name"), F.when(~even, F.struct(F.lit(1).alias("x"))).alias("features"))
    episodes = meta.select("episode", F.when(F.col("episode") == 6, "{").otherwise(F.to_json(fields)).alias("metadata"))
    size = F.sqrt(F.aggregate(F.slice("v", 4, 4), F.lit(0.0), lambda s, x: s + x * x)) * F.when((F.col("episode") == 7) & (F.col("t") % 5 == 2), 2.0).otherwise(1.0)
    pose = F.concat(F.slice("v", 1, 3), F.transform(F.slice("v", 4, 4), lambda x: x / F.col("size")))
    named = lambda n, value: F.struct(F.lit(n).alias("name"), value.alias("value"))
    keys = F.array(
        named("left.obs_ee_pose", pose), named("right.obs_ee_pose", F.when(F.col("episode") == 8, F.slice("v", 1, 6)).otherwise(F.concat(F.slice("v", 1, 3), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))))),
        named("left.obs_gripper", F.slice("v", F.lit(1), F.when(F.col("episode") == 9, 2).otherwise(1))), named("left.obs_keypoints", F.slice("v", F.lit(1), F.when((F.col("episode") == 9) & (F.col("t") == 0), 60).otherwise(63))),
    )
    arrays = df.withColumn("size", size).select("episode", "t", F.explode(keys).alias("a")).select("episode", "t", "a.*").filter("episode <> 1 OR name = 'left.obs_ee_pose'")
    images = df.filter(even).select("episode", "t", F.lit("images.front_1").alias("name"), F.lit(None).cast("array<double>").alias("value"))
    # behind the last frame however many there are
    df = df.join(meta, "episode")
    end = F.col("t") + F.when(F.col("vec_id") % 29 == 0, F.col("n") + 1000).otherwise(0)
    record = F.when(F.col("vec_id") % 31 == 0, "[1]").when(F.col("vec_id") % 37 == 0, F.to_json(F.struct(F.lit(1).alias("text"), F.col("t").alias("start_idx"), end.alias("end_idx")))).when(F.col("vec_id") % 41 == 0, '{"text": "a", "end_idx": 1}').otherwise(F.to_json(F.struct(F.lit("go").alias("text"), F.col("t").alias("start_idx"), end.alias("end_idx"))))
    notes = df.select("episode", F.lit("annotations").alias("name"), F.col("t").alias("ordinal"), record.alias("record"))
    return episodes, arrays.unionByName(images), notes


@query("Q1 Q4 K1", """WITH e AS (SELECT label AS episode, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings), n AS (SELECT episode, count(*) AS n FROM e GROUP BY episode),
b AS (SELECT episode, count(*) AS n, count(*) FILTER (t % 5 = 2) AS off FROM e GROUP BY episode),
k AS (SELECT n.episode, n.n, k.name FROM n, (SELECT unnest(['left.obs_ee_pose', 'right.obs_ee_pose', 'left.obs_gripper', 'left.obs_keypoints', 'images.front_1']) AS name) k
  WHERE CASE WHEN name = 'images.front_1' THEN episode % 2 = 0 WHEN name = 'left.obs_ee_pose' THEN TRUE ELSE episode <> 1 END),
w AS (SELECT *, CASE WHEN vec_id % 31 = 0 THEN 'not a record' WHEN vec_id % 37 = 0 THEN 'text' WHEN vec_id % 41 = 0 THEN 'start_idx' WHEN vec_id % 29 = 0 AND episode <> 6 THEN 'range' END AS why FROM e),
a AS (SELECT episode, count(*) AS n, count(why) AS bad, arg_min(why, t) FILTER (why IS NOT NULL) AS first FROM w GROUP BY episode)
SELECT episode, 'metadata' AS family, 'embodiment' AS key, 'missing field' AS problem FROM n WHERE episode IN (3, 6) UNION ALL SELECT episode, 'metadata', f, 'missing field' FROM n, (SELECT unnest(['total_frames', 'fps', 'task_name']) AS f) WHERE episode = 6
UNION ALL SELECT episode, 'metadata', 'features', 'missing field' FROM n WHERE episode % 2 = 0
UNION ALL SELECT episode, 'fps', 'fps', CASE episode WHEN 5 THEN 'unexpected 25.0' ELSE 'unexpected none' END FROM n WHERE episode IN (5, 6)
UNION ALL SELECT episode, 'frame count', name, n || ' of ' || (n + 2) || ' frames' FROM k WHERE episode = 4
UNION ALL SELECT episode, 'pose', 'right.obs_ee_pose', 'width 7 expected, not 6' FROM n WHERE episode = 8 UNION ALL SELECT episode, 'gripper', 'left.obs_gripper', 'width 1 expected, not 2' FROM n WHERE episode = 9
UNION ALL SELECT episode, 'keypoints', 'left.obs_keypoints', CASE WHEN n > 1 THEN 'width 63 expected, not 60 to 63' ELSE 'width 63 expected, not 60' END FROM n WHERE episode = 9
UNION ALL SELECT episode, 'pose', 'left.obs_ee_pose', off || ' quaternions not of length 1, the first at 2' FROM b WHERE episode = 7
UNION ALL SELECT episode, 'required key', 'images.front_1', 'missing' FROM n WHERE episode % 2 = 1 UNION ALL SELECT episode, 'required key', 'right.obs_ee_pose', 'missing' FROM n WHERE episode = 1
UNION ALL SELECT episode, 'annotation', 'annotations', bad || ' of ' || n || ' malformed, the first by its ' || first FROM a WHERE bad > 0""")
def validated_episodes(spark: SparkSession, d: str) -> DataFrame:
    """All problems of episodes by eight families of checks."""
    return V.episode_problems(*_episodes(spark, d), "episode")


@query("Q2 Q3", f"""WITH {_E} SELECT vec_id, abs(x1) < 1e8 AND abs(v[2]) < 1e8 AND abs(v[3]) < 1e8 AND sqrt(f*v[4]*f*v[4] + f*v[5]*f*v[5] + f*v[6]*f*v[6] + f*v[7]*f*v[7]) > 1e-6 AS valid
FROM (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 1e9 ELSE v[1] END AS x1, CASE WHEN vec_id % 11 = 0 THEN 1e-8 ELSE 1.0 END AS f FROM e)""")
def valid_poses(spark: SparkSession, d: str) -> DataFrame:
    scale = F.when(F.col("vec_id") % 11 == 0, 1e-8).otherwise(1.0)
    pose = F.concat(F.array(F.when(F.col("vec_id") % 7 == 0, 1e9).otherwise(F.col("v")[0])), F.slice("v", 2, 2), F.transform(F.slice("v", 4, 4), lambda x: x * scale))
    return _vectors(spark, d).select("vec_id", V.valid_pose(pose).alias("valid"))


_KEYS = {"actions_cartesian": (0, 14), "observations.state.ee_pose": (14, 12), "gaze": (26, 38)}


@query("N3 A25", """WITH d AS (SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT label, dim, quantile_cont(v, 0.0001) + 0.02 AS lo, quantile_cont(v, 0.9999) - 0.02 AS hi FROM d GROUP BY label, dim),
w AS (SELECT vec_id, d.label, d.dim, CASE WHEN vec_id % 23 = 0 AND d.dim = 30 THEN NULL ELSE v END AS v, lo, hi,
  CASE WHEN d.dim < 14 THEN 1 WHEN d.dim < 26 THEN 2 ELSE 3 END AS k, CASE WHEN d.dim < 14 THEN d.dim % 7 NOT IN (3, 4, 5) WHEN d.dim < 26 THEN (d.dim - 14) % 6 < 3 ELSE TRUE END AS guarded FROM d JOIN s ON s.label = d.label AND s.dim = d.dim),
b AS (SELECT vec_id, k, bool_or(v IS NULL) AS bad, bool_or(guarded AND (v < lo OR v > hi)) AS out FROM w GROUP BY vec_id, k),
f AS (SELECT vec_id, min(k) FILTER (bad OR out) AS k FROM b GROUP BY vec_id)
SELECT f.vec_id, ['actions_cartesian', 'observations.state.ee_pose', 'gaze'][f.k] AS key, CASE WHEN b.bad THEN 'not finite' WHEN b.out THEN 'bounds' END AS reason FROM f LEFT JOIN b ON b.vec_id = f.vec_id AND b.k = f.k""")
def first_violations(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors as three keys against their outermost quantiles, drawn in by a negative slack; the first key counts."""
    stats = S.norm_stats(_dims(spark, d), ["label", "dim"], "v")
    low, high = V.quantile_bounds(stats, -0.02)
    ends = stats.select("label", F.struct("dim", low.alias("low"), high.alias("high")).alias("e")).groupBy("label").agg(F.sort_array(F.collect_list("e")).alias("e"))
    v = F.transform("v", lambda x, i: F.when((F.col("vec_id") % 23 == 0) & (i == 30), float("nan")).otherwise(x))
    df = _vectors(spark, d).withColumn("v", v).join(ends, "label")
    checks = []
    for name, (at, n) in _KEYS.items():
        part = lambda c: F.slice(c, at + 1, n)  # noqa: B023, E731
        checks.append((name, V.bounds_reason(part("v"), part("e.low"), part("e.high"), V.guarded_channels(name, n))))
    return df.select("vec_id", V.first_violation(checks).alias("f")).select("vec_id", "f.key", "f.reason")


@query("K14 N6 K15", """WITH d AS (SELECT label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(median(v), 6) AS median, round(quantile_cont(v, 0.01), 6) AS q1, round(quantile_cont(v, 0.99), 6) AS q99,
  round(quantile_cont(v, 0.0001), 6) AS q0_01, round(quantile_cont(v, 0.9999), 6) AS q99_99 FROM d GROUP BY label, dim""")
def statistics_saved_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Nine statistics of all dimensions as nested JSON documents, written, read and taken apart again."""
    stats = S.norm_stats(_dims(spark, d), ["label", "dim"], "v").withColumn("key", F.lit("vector"))
    with steps(spark) as own:
        S.save_stats(stats, "label", "key", "dim", f"{own.path}/stats")
        got = S.load_stats(spark, f"{own.path}/stats", "label int, key string")
        return own.result(S.rounded(got.select("label", "dim", *S.STATS)))


@query("P9 E1 A24", """WITH p AS (SELECT a.label, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT label, list_sum(list_transform(e, lambda x: x * x)) / 64 AS mse, list_sum(list_transform(e, lambda x: abs(x))) / 64 AS mae, list_sum(list_transform(e[57:64], lambda x: x * x)) / 8 AS last, list_max(list_transform(e, lambda x: abs(x))) AS worst FROM p)
SELECT label, count(*) AS n, round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae, round(avg(last), 6) AS final_mse, round(max(worst), 6) AS worst, round(avg(CASE WHEN worst > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS mismatch FROM m GROUP BY label""")
def metric_suite(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors as chunks of eight steps against the next ones: all metrics in one pass."""
    chunk = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", 8 * k + 1, 8))
    df = _vectors(spark, d).select("label", "vec_id", chunk.alias("truth"))
    pairs = df.join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("truth").alias("guess")), "vec_id")
    out = E.suite(pairs, ["label"], "truth", "guess", 0.5)
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mse", "mae", "final_mse", "worst", "mismatch")])


@query("Q15", f"""WITH {SPANS_SQL}, x AS (SELECT f.episode, f.t, arg_max(s.ordinal, s.ordinal) AS o FROM frames f LEFT JOIN spans s ON s.episode = f.episode AND f.t >= s.start_idx AND f.t < s.end_idx GROUP BY f.episode, f.t)
SELECT episode, t, CASE WHEN o IS NULL THEN 0.0 ELSE round(3.0 / sqrt(9.0 + (o % 7) ** 2), 6) END AS x, CASE WHEN o IS NULL THEN 0.0 ELSE round((o % 7) / sqrt(9.0 + (o % 7) ** 2), 6) END AS y FROM x""")
def span_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the unit vector of the last span that holds it, zeros where there is none."""
    s = spans(spark, d).withColumn("text", F.col("ordinal").cast("string"))
    hit = J.interval_join(frames(spark, d), s, closed="left", pick="last").withColumn("o", F.col("text").cast("double") % 7)
    v = I.unit_length(F.array(F.lit(3.0), F.col("o")))
    return hit.select("episode", "t", F.coalesce(v, F.array(F.lit(0.0), F.lit(0.0))).alias("v")).select("episode", "t", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query("Q16", f"""WITH {_E}, m AS (SELECT vec_id, v, vec_id % 7 + 1 AS n, vec_id % 3 = 0 AS left_side FROM e), p AS (SELECT vec_id, CASE WHEN left_side THEN v[57:64] ELSE v[8*(n-1)+1 : 8*n] END AS s FROM m)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, round(s[k] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS x FROM p, (SELECT unnest(range(1, 9)) AS k)""")
def last_token_states(spark: SparkSession, d: str) -> DataFrame:
    """Of eight states with a mask padded on either side the last one that counts, of unit length."""
    n = (F.col("vec_id") % 7 + 1).cast("int")
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.when(F.col("vec_id") % 3 == 0, k >= 8 - n).otherwise(k < n), 1).otherwise(0))
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", 8 * k + 1, 8))
    df = _vectors(spark, d).select("vec_id", I.last_token(states, mask).alias("s")).withColumn("s", I.unit_length(F.col("s")))
    return df.select("vec_id", F.posexplode("s").alias("k", "x")).select("vec_id", "k", F.round("x", 6).alias("x"))


@query("I2 I4 I5", f"""WITH {_E}, c AS (SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN 1e9 ELSE v[1] END AS first, v FROM e),
s AS (SELECT c.vec_id, CAST(step AS INTEGER) AS step, c.first, v, floor(step * 8 / 20.0::DOUBLE) AS low, step * 8 / 20.0::DOUBLE AS p FROM c, (SELECT unnest(range(21)) AS step))
SELECT vec_id, step, round(CASE WHEN first >= 1e8 THEN 1e9 ELSE v[CAST(low AS INTEGER)*7+2] + (v[CAST(least(low+1, 8) AS INTEGER)*7+2] - v[CAST(low AS INTEGER)*7+2]) * (p - low) END, 6) AS y,
  round(CASE WHEN first >= 1e8 THEN 1e9 ELSE v[CAST(low AS INTEGER)*7+7] + (v[CAST(least(low+1, 8) AS INTEGER)*7+7] - v[CAST(low AS INTEGER)*7+7]) * (p - low) END, 6) AS grip, step // 2 % 2 = 0 AS mask FROM s""")
def pose_chunks_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of nine poses with grippers resampled to 21 steps, invalid ones as such, and a mask of ten steps repeated."""
    first = F.when(F.col("vec_id") % 19 == 0, 1e9).otherwise(F.col("v")[0])
    df = _vectors(spark, d).withColumn("w", F.concat(F.array(first), F.slice("v", 2, 62)))
    df = df.withColumn("chunk", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.slice("w", 7 * k + 1, 7)))
    df = I.with_resampled(df, "chunk", "c", 21, 7, angle=(3, 4, 5)).withColumn("m", I.repeated_mask(F.array(*[F.lit(k % 2 == 0) for k in range(11)]), 22))
    return df.select("vec_id", F.posexplode("c").alias("step", "p"), "m").select("vec_id", "step", F.round(F.col("p")[1], 6).alias("y"), F.round(F.col("p")[6], 6).alias("grip"), F.col("m")[F.col("step")].alias("mask"))
