"""Queries on hand recordings: nested JSON to rows in the camera's frame, and poses of hands and palms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.operators import landmarks as L
from framelake.plans.arrays import _E, _vectors
from framelake.plans.registry import query


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """A recording for each label, with the documents of its hands and of its body; each vector is a frame."""
    df = _vectors(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) + 10 * F.col("label"))
    point = lambda k, shift: F.struct(F.lit(k).alias("landmark_index"), *[F.col("v")[3 * k + shift + i].alias(c) for i, c in enumerate("xyz")])
    hand = lambda kind, shift: F.struct(F.lit(kind).alias("hand_type"), F.array(*[point(k, shift) for k in range(21)]).alias("landmarks"))
    hands = F.struct(F.array(hand("LEFT", 0), hand("RIGHT", 1), hand("OTHER", 0)).alias("hands"))
    named = lambda at, names: F.struct(*[F.col("v")[at + i].alias(c) for i, c in enumerate(names)])
    pose = F.struct("frame", F.struct(named(28, "xyz").alias("position"), named(31, "wxyz").alias("orientation")).alias("camera_transform"))
    docs = df.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), hands))).alias("frames"), F.collect_list(F.when(F.col("vec_id") % 5 != 0, pose)).alias("poses"))
    return docs.select("label", F.to_json(F.struct("frames")).alias("hands"), F.to_json(F.struct("poses")).alias("body"))


@query("S27 J13 A7", f"""WITH {_E}, f AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) + 10 * label AS frame,
  sqrt(v[32]*v[32]+v[33]*v[33]+v[34]*v[34]+v[35]*v[35]) AS n FROM e),
q AS (SELECT *, v[32]/n AS w, v[33]/n AS i, v[34]/n AS j, v[35]/n AS k, min(frame) OVER (PARTITION BY label) AS base FROM f WHERE vec_id % 5 <> 0),
p AS (SELECT q.*, h AS hand_index, m AS landmark_index, v[3*m+h+1]-v[29] AS x, v[3*m+h+2]-v[30] AS y, v[3*m+h+3]-v[31] AS z FROM q, (SELECT unnest([0, 1]) AS h), (SELECT unnest(range(21)) AS m))
SELECT label, CAST(frame - base AS BIGINT) AS frame, hand_index, CAST(landmark_index AS INTEGER) AS landmark_index, round((1-2*(j*j+k*k))*x + 2*(i*j+w*k)*y + 2*(i*k-w*j)*z, 6) AS x,
  round(2*(i*j-w*k)*x + (1-2*(i*i+k*k))*y + 2*(j*k+w*i)*z, 6) AS y, round(2*(i*k+w*j)*x + 2*(j*k-w*i)*y + (1-2*(i*i+j*j))*z, 6) AS z FROM p""")
def landmarks_in_camera(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of nested documents as rows, each landmark turned by its frame's 4x4 matrix."""
    docs = _recordings(spark, d)
    rows = L.in_camera(L.tidy(docs, "label", "hands"), L.camera_poses(docs, "label", "body"), "label")
    return rows.select("label", "frame", "hand_index", "landmark_index", *[F.round(c, 6).alias(c) for c in "xyz"])


_HANDS = """h AS (SELECT vec_id, CAST(vec_id % 2 AS INTEGER) AS side, list_transform(range(1, 64), lambda i: CASE WHEN vec_id % 13 = 0 THEN 0.0 WHEN vec_id % 17 = 0 AND i BETWEEN 28 AND 30 THEN v[i - 27] ELSE v[i] END) AS k FROM e),
f AS (SELECT *, k[28]-k[1] AS a1, k[29]-k[2] AS a2, k[30]-k[3] AS a3, k[16]-k[1] AS t1, k[17]-k[2] AS t2, k[18]-k[3] AS t3, k[52]-k[1] AS l1, k[53]-k[2] AS l2, k[54]-k[3] AS l3 FROM h),
u AS (SELECT *, t2*l3-t3*l2 AS u1, t3*l1-t1*l3 AS u2, t1*l2-t2*l1 AS u3, sqrt(a1*a1+a2*a2+a3*a3) AS na FROM f),
g AS (SELECT *, a1/na AS f1, a2/na AS f2, a3/na AS f3 FROM u), r AS (SELECT *, f2*u3-f3*u2 AS r1, f3*u1-f1*u3 AS r2, f1*u2-f2*u1 AS r3 FROM g),
m AS (SELECT *, r1/sqrt(r1*r1+r2*r2+r3*r3) AS x1, r2/sqrt(r1*r1+r2*r2+r3*r3) AS x2, r3/sqrt(r1*r1+r2*r2+r3*r3) AS x3, CASE WHEN side = 0 THEN 1 ELSE -1 END AS s FROM r)"""


@query("G16 R12 G3 G13", f"""WITH {_E}, {_HANDS} SELECT vec_id, round((k[1]+k[16]+k[28]+k[40]+k[52])/5, 5) AS px, round((k[3]+k[18]+k[30]+k[42]+k[54])/5, 5) AS pz,
  CASE WHEN na < 1e-6 THEN 1.0 ELSE round(s*x1, 4) END AS m00, CASE WHEN na < 1e-6 THEN 0.0 ELSE round(s*x2, 4) END AS m10, CASE WHEN na < 1e-6 THEN 0.0 ELSE round(-s*(x2*f3-x3*f2), 4) END AS m01,
  CASE WHEN na < 1e-6 THEN 0.0 ELSE round(f1, 4) END AS m02, CASE WHEN na < 1e-6 THEN 1.0 ELSE round(f3, 4) END AS m22 FROM m""")
def poses_of_hands(spark: SparkSession, d: str) -> DataFrame:
    """Poses of hands, mirrored by side, with hands at zero and hands without a direction; read back as matrices."""
    k = F.transform(F.slice("v", 1, 63), lambda x, i: F.when(F.col("vec_id") % 13 == 0, 0.0).when((F.col("vec_id") % 17 == 0) & i.between(27, 29), F.get(F.col("v"), i - 27)).otherwise(x))
    df = _vectors(spark, d).select("vec_id", (F.col("vec_id") % 2).alias("side"), k.alias("k"))
    df = L.with_hand_pose(df, "k", "side", "pose").withColumn("q", F.slice("pose", 4, 4)).withColumn("m", G.quaternion_to_matrix(F.col("q")))
    entries = [F.round(F.col("m")[at], 4).alias(n) for n, at in (("m00", 0), ("m10", 3), ("m01", 1), ("m02", 2), ("m22", 8))]
    return df.select("vec_id", F.round(F.col("pose")[0], 5).alias("px"), F.round(F.col("pose")[2], 5).alias("pz"), *entries)


@query("G18", f"""WITH {_E}, c AS (SELECT vec_id, v[4]-v[1] AS a1, v[5]-v[2] AS a2, v[6]-v[3] AS a3, v[7]/n AS z1, v[8]/n AS z2, v[9]/n AS z3 FROM (SELECT *, sqrt(v[7]*v[7]+v[8]*v[8]+v[9]*v[9]) AS n FROM e)),
y AS (SELECT *, a2*z3-a3*z2 AS b1, a3*z1-a1*z3 AS b2, a1*z2-a2*z1 AS b3 FROM c), u AS (SELECT *, b1/sqrt(b1*b1+b2*b2+b3*b3) AS y1, b2/sqrt(b1*b1+b2*b2+b3*b3) AS y2, b3/sqrt(b1*b1+b2*b2+b3*b3) AS y3 FROM y)
SELECT vec_id, round(y2*z3-y3*z2, 6) AS x1, round(y1, 6) AS y1, round(z1, 6) AS z1, round(y1*z2-y2*z1, 6) AS x3 FROM u""")
def palm_frames(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).select("vec_id", F.slice("v", 1, 3).alias("palm"), F.slice("v", 4, 3).alias("wrist"), F.slice("v", 7, 3).alias("normal"))
    x, y, z = L.palm_axes(F.col("palm"), F.col("wrist"), F.col("normal"))
    return df.select("vec_id", F.round(x[0], 6).alias("x1"), F.round(y[0], 6).alias("y1"), F.round(z[0], 6).alias("z1"), F.round(x[2], 6).alias("x3"))
