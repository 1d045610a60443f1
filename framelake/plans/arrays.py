"""Queries on geometry, interpolation, packing and the embodiments' pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import interp as I
from framelake.operators import embodiments as E
from framelake.plans.registry import query
from framelake.plans.standins import load

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_Q = _E + """, u AS (SELECT vec_id, v, v[4] AS a0, v[5] AS a1, v[6] AS a2, v[7] AS a3, sqrt(v[4]*v[4]+v[5]*v[5]+v[6]*v[6]+v[7]*v[7]) * CASE WHEN v[4] < 0 THEN -1 ELSE 1 END AS n FROM e),
q AS (SELECT vec_id, v, a0/n AS w, a1/n AS x, a2/n AS y, a3/n AS z FROM u)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("G1 G2 G3 G6 G11 G13 G14 G21 G22 R21", f"""WITH {_Q} SELECT vec_id, round(atan2(2*(w*z+x*y), 1-2*(y*y+z*z)), 6) AS yaw, round(asin(greatest(-1, least(1, 2*(w*y-z*x)))), 6) AS pitch, round(atan2(2*(w*x+y*z), 1-2*(x*x+y*y)), 6) AS roll, round(w, 6) AS w_back, round(x, 6) AS x_back FROM q""")
def quaternion_angles(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).withColumn("q", G.unit_quaternion(F.col("v"))).withColumn("a", G.quaternion_to_ypr(F.col("q"))).withColumn("b", G.ypr_to_quaternion(F.col("a")))
    df = df.withColumn("b", G.unit_quaternion(F.col("b"), 0))
    return df.select("vec_id", *[F.round(F.col("a")[k], 6).alias(n) for k, n in enumerate(("yaw", "pitch", "roll"))], F.round(F.col("b")[0], 6).alias("w_back"), F.round(F.col("b")[1], 6).alias("x_back"))


@query("G7 G8 G9 G4 R11 R15", f"""WITH {_Q}, r AS (SELECT *, v[8]-v[1] AS dx, v[9]-v[2] AS dy, v[10]-v[3] AS dz FROM q)
SELECT vec_id, round((1-2*(y*y+z*z))*dx + 2*(x*y+w*z)*dy + 2*(x*z-w*y)*dz, 6) AS rx, round(2*(x*y-w*z)*dx + (1-2*(x*x+z*z))*dy + 2*(y*z+w*x)*dz, 6) AS ry, round(2*(x*z+w*y)*dx + 2*(y*z-w*x)*dy + (1-2*(x*x+y*y))*dz, 6) AS rz FROM r""")
def relative_positions(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).withColumn("q", G.unit_quaternion(F.col("v"))).withColumn("m", G.quaternion_to_matrix(F.col("q")))
    df = df.withColumn("s", G.minus(F.slice("v", 8, 3), F.slice("v", 1, 3))).withColumn("r", G.rotated(F.col("m"), F.col("s"), inverse=True))
    return df.select("vec_id", *[F.round(F.col("r")[k], 6).alias(n) for k, n in enumerate(("rx", "ry", "rz"))])


@query("G5", f"""WITH {_E}, a AS (SELECT vec_id, v, greatest(sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]), 1e-8) AS n FROM e), b AS (SELECT vec_id, v, v[1]/n AS x1, v[2]/n AS x2, v[3]/n AS x3 FROM a),
c AS (SELECT *, x1*v[4]+x2*v[5]+x3*v[6] AS p FROM b), f AS (SELECT *, v[4]-p*x1 AS r1, v[5]-p*x2 AS r2, v[6]-p*x3 AS r3 FROM c), g AS (SELECT *, greatest(sqrt(r1*r1+r2*r2+r3*r3), 1e-8) AS m FROM f)
SELECT vec_id, round(x1, 6) AS x1, round(r1/m, 6) AS y1, round(r2/m, 6) AS y2, round(x2*r3/m - x3*r2/m, 6) AS z1, round(x3*r1/m - x1*r3/m, 6) AS z2 FROM g""")
def gram_schmidt(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).withColumn("x", G.first_axis(F.col("v"))).withColumn("y", G.second_axis(F.col("v"), F.col("x"))).withColumn("z", G.third_axis(F.col("x"), F.col("y")))
    r = lambda c, k: F.round(F.col(c)[k], 6)
    return df.select("vec_id", r("x", 0).alias("x1"), r("y", 0).alias("y1"), r("y", 1).alias("y2"), r("z", 0).alias("z1"), r("z", 1).alias("z2"))


@query("G12 F18", f"WITH {_E} SELECT vec_id, round(CASE WHEN v[3] > 0.01 THEN 266.5 * v[1] / v[3] + 320 END, 4) AS px, round(CASE WHEN v[3] > 0.01 THEN 266.5 * v[2] / v[3] + 240 END, 4) AS py, v[3] > 0.01 AND 266.5 * v[1] / v[3] + 320 BETWEEN 0 AND 640 AND 266.5 * v[2] / v[3] + 240 BETWEEN 0 AND 480 AS inside FROM e")
def projected_pixels(spark: SparkSession, d: str) -> DataFrame:
    ahead = F.when(F.col("v")[2] > 0.01, F.col("v"))
    df = _vectors(spark, d).withColumn("p", G.pixel(ahead, 266.5, 266.5, 320.0, 240.0))
    inside = F.coalesce(F.col("p")[0].between(0, 640) & F.col("p")[1].between(0, 480), F.lit(False))
    return df.select("vec_id", F.round(F.col("p")[0], 4).alias("px"), F.round(F.col("p")[1], 4).alias("py"), inside.alias("inside"))


@query("G15 G17", f"WITH {_E}, n AS (SELECT vec_id, v, sqrt(tan(v[1])*tan(v[1]) + tan(v[2])*tan(v[2]) + 1) AS n FROM e) SELECT vec_id, round(2 * tan(v[1]) / n, 6) AS gx, round(2 * tan(v[2]) / n, 6) AS gy, round(2 / n, 6) AS gz, round(-v[2], 6) AS hx, round(-v[3], 6) AS hy, round(v[1], 6) AS hz FROM n")
def gaze_and_head(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).withColumn("g", G.gaze(F.col("v")[0], F.col("v")[1], F.lit(2.0))).withColumn("h", G.head_axes(F.col("v")))
    return df.select("vec_id", *[F.round(F.col(c)[k], 6).alias(f"{c}{n}") for c in "gh" for k, n in enumerate("xyz")])


@query("G16 G18 R12", f"""WITH {_E}, f AS (SELECT vec_id, v, v[28]-v[1] AS f1, v[29]-v[2] AS f2, v[30]-v[3] AS f3, v[16]-v[1] AS a1, v[17]-v[2] AS a2, v[18]-v[3] AS a3, v[52]-v[1] AS b1, v[53]-v[2] AS b2, v[54]-v[3] AS b3 FROM e),
u AS (SELECT *, a2*b3-a3*b2 AS u1, a3*b1-a1*b3 AS u2, a1*b2-a2*b1 AS u3 FROM f)
SELECT vec_id, round((v[1]+v[16]+v[28]+v[40]+v[52])/5, 6) AS cx, round((v[3]+v[18]+v[30]+v[42]+v[54])/5, 6) AS cz, round(f1/sqrt(f1*f1+f2*f2+f3*f3), 6) AS fx, round(u1/sqrt(u1*u1+u2*u2+u3*u3), 6) AS ux FROM u""")
def hand_frames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("v")
    df = _vectors(spark, d).select("vec_id", G.hand_centre(k).alias("c"), G.hand_axis(k, "forward").alias("f"), G.hand_axis(k, "up").alias("u"))
    return df.select("vec_id", F.round(F.col("c")[0], 6).alias("cx"), F.round(F.col("c")[2], 6).alias("cz"), F.round(F.col("f")[0], 6).alias("fx"), F.round(F.col("u")[0], 6).alias("ux"))


@query("G10 G19 G20 X24 X25", f"WITH {_E}, p AS (SELECT vec_id, v, list_concat(v[1:14], list_transform(range(18), lambda x: 0.0::DOUBLE)) AS p FROM e) SELECT vec_id, len(p) AS width, round(list_sum(p), 6) AS total, round(p[7], 6) AS left_grip, round(p[14], 6) AS right_grip, p[32] AS last FROM p")
def packed_actions(spark: SparkSession, d: str) -> DataFrame:
    left, right = G.unpacked(F.col("v"), [7, 7])
    df = _vectors(spark, d).withColumn("p", G.packed([left, right]))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return df.select("vec_id", F.size("p").cast("long").alias("width"), F.round(total, 6).alias("total"), F.round(F.col("p")[6], 6).alias("left_grip"), F.round(F.col("p")[13], 6).alias("right_grip"), F.col("p")[31].alias("last"))


@query("I1 I4", f"WITH {_E}, s AS (SELECT vec_id, v, CAST(i AS INTEGER) AS step, i * 63 / 9.0::DOUBLE AS p FROM e, (SELECT unnest(range(10)) AS i)) SELECT vec_id, step, round(v[CAST(floor(p) AS INTEGER)+1] + (v[least(CAST(floor(p) AS INTEGER)+2, 64)] - v[CAST(floor(p) AS INTEGER)+1]) * (p - floor(p)), 6) AS value FROM s")
def linear_resample(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.posexplode(I.linear(F.col("v"), 10)).alias("step", "value")).select("vec_id", "step", F.round("value", 6).alias("value"))


@query("I2 R13", f"""WITH {_E}, a AS (SELECT vec_id, CAST(i AS INTEGER) AS i, v[i] * 20 AS x FROM e, (SELECT unnest(range(1, 4)) AS i)), d AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS dx FROM a),
w AS (SELECT vec_id, i, x - 2*pi() * coalesce(sum(floor((dx + pi()) / (2*pi()))) OVER (PARTITION BY vec_id ORDER BY i), 0) AS u FROM d), p AS (SELECT vec_id, max(u) FILTER (i = 1) AS a, max(u) FILTER (i = 2) AS b, max(u) FILTER (i = 3) AS c FROM w GROUP BY vec_id),
r AS (SELECT vec_id, unnest([0, 1, 2, 3, 4]) AS step, unnest([a, (a+b)/2, b, (b+c)/2, c]) AS y FROM p) SELECT vec_id, step, round(cos(y), 6) AS cosine, round(sin(y), 6) AS sine FROM r""")
def angle_resample(spark: SparkSession, d: str) -> DataFrame:
    a = F.transform(F.slice("v", 1, 3), lambda x: x * 20)
    df = _vectors(spark, d).select("vec_id", F.posexplode(I.angles(a, 5)).alias("step", "y"))
    return df.select("vec_id", "step", F.round(F.cos("y"), 6).alias("cosine"), F.round(F.sin("y"), 6).alias("sine"))


@query("I3", f"""WITH {_Q}, b AS (SELECT *, sqrt(v[8]*v[8]+v[9]*v[9]+v[10]*v[10]+v[11]*v[11]) * CASE WHEN v[8] < 0 THEN -1 ELSE 1 END AS m FROM q), c AS (SELECT *, v[8]/m AS p0, v[9]/m AS p1, v[10]/m AS p2, v[11]/m AS p3 FROM b),
t AS (SELECT *, w*p0+x*p1+y*p2+z*p3 AS d FROM c), g AS (SELECT *, acos(least(1, abs(d))) AS o FROM t), h AS (SELECT *, sin(0.75*o)/sin(o) AS ca, sin(0.25*o)/sin(o) * CASE WHEN d < 0 THEN -1 ELSE 1 END AS cb FROM g)
SELECT vec_id, round(ca*w+cb*p0, 6) AS w, round(ca*x+cb*p1, 6) AS x, round(ca*y+cb*p2, 6) AS y, round(ca*z+cb*p3, 6) AS z FROM h""")
def slerp_quarter(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).select("vec_id", G.unit_quaternion(F.col("v")).alias("q"), G.unit_quaternion(F.col("v"), 7).alias("r"))
    df = df.withColumn("s", I.slerp(F.col("q"), F.col("r"), F.lit(0.25)))
    return df.select("vec_id", *[F.round(F.col("s")[k], 6).alias(n) for k, n in enumerate("wxyz")])


@query("Q16 A24 P6", f"WITH {_E}, p AS (SELECT vec_id, CAST(k AS INTEGER) AS k, list_sum(list_transform(range(1, 65), lambda i: v[i] * cos(0.37 * i * (k + 1)))) AS x FROM e, (SELECT unnest(range(4)) AS k)), n AS (SELECT *, sqrt(sum(x*x) OVER (PARTITION BY vec_id)) AS n FROM p) SELECT vec_id, k, round(x / n, 6) AS x FROM n")
def projected_latents(spark: SparkSession, d: str) -> DataFrame:
    """A fixed projection to four numbers, then unit length."""
    one = lambda k: F.aggregate(F.transform("v", lambda x, i: x * F.cos(0.37 * (i + 1) * (k + 1))), F.lit(0.0), lambda s, x: s + x)
    df = _vectors(spark, d).withColumn("p", F.array(*[one(k) for k in range(4)])).withColumn("n", F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x)))
    return df.select("vec_id", F.posexplode("p").alias("k", "x"), "n").select("vec_id", "k", F.round(F.col("x") / F.col("n"), 6).alias("x"))


def _poses(spark: SparkSession, d: str) -> DataFrame:
    pose = lambda at: F.slice("v", at, 7)
    df = _vectors(spark, d).select(F.col("label").alias("episode"), "vec_id", pose(1).alias("left_obs"), pose(8).alias("right_obs"), pose(15).alias("left_cmd"), pose(22).alias("right_cmd"), pose(29).alias("head"), F.slice("v", 1, 63).alias("left_keys"), F.slice("v", 2, 63).alias("right_keys"), F.abs(F.col("v")[40]).alias("left_grip"), F.abs(F.col("v")[41]).alias("right_grip"))
    return df.withColumn("t", F.expr("CAST(row_number() OVER (PARTITION BY episode ORDER BY vec_id) - 1 AS BIGINT)"))


def _summary(df: DataFrame) -> DataFrame:
    flat = F.flatten("actions")
    return df.select("episode", "t", F.size("actions").alias("steps"), F.size(F.col("actions")[0]).alias("width"), F.size("state").alias("state_width"), F.round(F.aggregate(flat, F.lit(0.0), lambda s, x: s + F.abs(x)), 3).alias("magnitude"))


@query("B1 B2 B10 B11 P1 P4 P5 G8 I4")
def robot_action_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _summary(E.action_chunks(_poses(spark, d), E.pipeline("eva", "cartesian_wristframe_6d")))


@query("B4 B5")
def human_action_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _summary(E.action_chunks(_poses(spark, d), E.pipeline("aria", "cartesian_6d")))


@query("B7 B8")
def keypoint_action_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _summary(E.action_chunks(_poses(spark, d), E.pipeline("mecka", "keypoints_wristframe_quat")))
