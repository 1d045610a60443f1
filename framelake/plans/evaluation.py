"""Queries on metrics, nested records and reverted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import nested as N
from framelake.operators import embodiments as E
from framelake.operators import evaluation as V
from framelake.operators import registry as R
from framelake.plans.arrays import _poses
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, frames, load


def _halves(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.slice("embedding", 1, 2).cast("array<double>").alias("x"))


_TWO = "v AS (SELECT label, vec_id % 2 AS half, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT label, half, avg(x) AS mx, avg(y) AS my, covar_samp(x, x) + 1e-6 AS a, covar_samp(x, y) AS b, covar_samp(y, y) + 1e-6 AS c FROM v GROUP BY label, half)"


@query("E2", f"""WITH {_TWO}, p AS (SELECT l.label, (l.mx - r.mx) ** 2 + (l.my - r.my) ** 2 + l.a + l.c + r.a + r.c AS base, l.a * r.a + 2 * l.b * r.b + l.c * r.c AS tr, sqrt((l.a * l.c - l.b * l.b) * (r.a * r.c - r.b * r.b)) AS root FROM m l JOIN m r ON r.label = l.label AND l.half = 0 AND r.half = 1)
SELECT label, round(sqrt(greatest(0, base - 2 * sqrt(tr + 2 * root))), 5) AS distance FROM p""")
def frechet_distance(spark: SparkSession, d: str) -> DataFrame:
    """Of two 2-dimensional Gaussians for each label; the counterpart uses the closed form of two dimensions."""
    df = _halves(spark, d)
    one = lambda k: V.moments(df.filter(F.col("half") == k), ["label"], "x", 2)
    return V.frechet(one(0), one(1), ["label"]).select("label", F.round("distance", 5).alias("distance"))


@query("E3", """WITH s AS (SELECT vec_id, vec_id // 5 AS g, embedding[1]::DOUBLE * 9 AS x, embedding[2]::DOUBLE * 9 AS y FROM embeddings), q AS (SELECT a.g, a.vec_id, a.x, a.y, ln(sum(exp(-0.5 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)))) - ln(count(*)) AS lq FROM s a JOIN s b ON b.g = a.g GROUP BY a.g, a.vec_id, a.x, a.y)
SELECT g, round(avg(lq + 0.5 * (x ** 2 + y ** 2)), 6) AS reverse_kl FROM q GROUP BY g""")
def reverse_kl(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double") * 9)
    df = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("g"), x.alias("x"), F.lit([0.0, 0.0]).alias("target"))
    return V.reverse_kl(df, "g", "x", "target").select("g", F.round("reverse_kl", 6).alias("reverse_kl"))


@query("E5", """SELECT user_id AS epoch, count(*) AS n, round(avg(value), 6) AS loss FROM events GROUP BY user_id HAVING (user_id + 1) % 10 = 0""")
def metrics_by_cadence(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").filter((F.col("user_id") + 1) % 10 == 0)
    return df.groupBy(F.col("user_id").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("loss"))


@query("X21 X23 R16", """WITH r AS (SELECT event_id, CAST(user_id AS STRING) AS a, event_type AS b, CAST(json_extract_string(props, '$.k') AS STRING) AS c FROM events) SELECT event_id, unnest(['who.user_id', 'what.kind.name', 'what.k']) AS path, unnest([a, b, c]) AS value FROM r""")
def flattened_records(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select(
        "event_id", F.struct("user_id").alias("who"), F.struct(F.struct(F.col("event_type").alias("name")).alias("kind"), F.get_json_object("props", "$.k").alias("k")).alias("what")
    )
    return N.flattened(df, ["event_id"])


@query("B3 G10")
def reverted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks seen from the wrist, taken back to the camera's frame."""
    chunks = E.action_chunks(_poses(spark, d), E.pipeline("eva", "cartesian_wristframe_6d"))
    back = E.revert_chunks(chunks, "6d", grip=True)
    return back.select("episode", "t", F.size("reverted").alias("steps"), F.size(F.col("reverted")[0]).alias("width"), F.round(F.col("reverted")[0][0], 4).alias("x"))


@query("T1", f"""WITH {FRAMES_SQL}, r AS (SELECT episode, t, value, row_number() OVER (PARTITION BY episode ORDER BY value DESC, t) AS r FROM frames WHERE value < 100) SELECT episode, t, value FROM r WHERE r = 1""")
def probe_frames(spark: SparkSession, d: str) -> DataFrame:
    best = R.top_rows(frames(spark, d).filter("value < 100"), ["episode"], [F.desc("value"), F.col("t")], 1)
    return best.select("episode", "t", "value")


@query("R30", """SELECT conv_id, turn, turn || ' ' || reverse(text) AS text FROM conversations WHERE conv_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0)""")
def annotation_bucket_etl(spark: SparkSession, d: str) -> DataFrame:
    """Transforms whole texts, and only those that aren't there yet."""
    there = load(spark, d, "embeddings").filter("vec_id % 4 = 0").select(F.col("vec_id").alias("conv_id"))
    return R.choose(load(spark, d, "conversations"), "conv_id", exclude=[there]).select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" "), F.reverse("text")).alias("text"))


@query("R30", """SELECT conv_id, turn, reverse(text) AS text FROM conversations WHERE conv_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0)""")
def annotation_text_etl(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are, turned round."""
    there = load(spark, d, "embeddings").filter("vec_id % 4 = 0").select(F.col("vec_id").alias("conv_id"))
    return R.choose(load(spark, d, "conversations"), "conv_id", exclude=[there]).select("conv_id", "turn", F.reverse("text").alias("text"))


@query("F2", """SELECT user_id, round(var_samp(value), 4) AS spread, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) > 10""")
def trajectory_scan(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").filter("event_type <> 'error'")
    return df.groupBy("user_id").agg(F.round(F.var_samp("value"), 4).alias("spread"), F.count(F.lit(1)).alias("n")).filter("n > 10")
