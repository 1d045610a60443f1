"""Queries on action layouts and on pauses of whole bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import packing as P
from framelake.operators import selection as S
from framelake.operators import windows as W
from framelake.plans.arrays import _poses, _vectors
from framelake.plans.registry import query

RULES = P.Rules({
    ("eva", "left"): "robot_left", ("eva", "right"): "robot_right", ("eva", P.ANY): "robot_both", ("aria", "left"): "human_left", ("aria", "right"): "human_right",
    ("aria", P.ANY): "human_both", (P.ANY, "sixd"): "human_both_6d", (P.ANY, P.ANY): "robot_both_6d",
})
_NAMES = {
    "embodiment": "CASE label % 3 WHEN 0 THEN 'eva' WHEN 1 THEN 'aria' ELSE 'mecka' END",
    "key": "CASE vec_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'sixd' ELSE 'both' END",
}
_LAYOUT = """CASE WHEN embodiment = 'eva' AND key IN ('left', 'right') THEN 'robot_' || key WHEN embodiment = 'eva' THEN 'robot_both'
  WHEN embodiment = 'aria' AND key IN ('left', 'right') THEN 'human_' || key WHEN embodiment = 'aria' THEN 'human_both' WHEN key = 'sixd' THEN 'human_both_6d' ELSE 'robot_both_6d' END"""


def _block_sql(at: str, sixd: str, grip: str) -> str:
    """Ten numbers of one arm whose own numbers begin behind `at`."""
    y, p, r = (f"v[{at} + {k}]" for k in (4, 5, 6))
    turned = [f"cos({y})*cos({p})", f"sin({y})*cos({p})", f"-sin({p})", f"cos({y})*sin({p})*sin({r})-sin({y})*cos({r})", f"sin({y})*sin({p})*sin({r})+cos({y})*cos({r})", f"cos({p})*sin({r})"]
    rotation = [f"CASE WHEN {sixd} THEN v[{at} + {4 + k}] ELSE {t} END" for k, t in enumerate(turned)]
    last = f"CASE WHEN {grip} THEN v[{at} + CASE WHEN {sixd} THEN 10 ELSE 7 END] ELSE 0.0 END"
    return "[" + ", ".join([*(f"v[{at} + {k}]" for k in (1, 2, 3)), *rotation, last]) + "]"


@query("P7 G20 G10 X24", f"""WITH e AS (
  SELECT vec_id, {", ".join(f"{e} AS {c}" for c, e in _NAMES.items())}, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT *, {_LAYOUT} AS layout FROM e),
a AS (SELECT *, layout LIKE '%6d' AS sixd, layout LIKE 'robot%' AS grip, layout LIKE '%left' AS only_left, layout LIKE '%right' AS only_right FROM l),
b AS (SELECT *, 6 + CASE WHEN sixd THEN 3 ELSE 0 END + CASE WHEN grip THEN 1 ELSE 0 END AS arm FROM a),
p AS (
  SELECT vec_id, layout, arm * CASE WHEN only_left OR only_right THEN 1 ELSE 2 END AS width,
    CASE WHEN only_right THEN list_transform(range(10), lambda i: 0.0::DOUBLE) ELSE {_block_sql("0", "sixd", "grip")} END AS l,
    CASE WHEN only_left THEN list_transform(range(10), lambda i: 0.0::DOUBLE) WHEN only_right THEN {_block_sql("0", "sixd", "grip")} ELSE {_block_sql("arm", "sixd", "grip")} END AS r FROM b)
SELECT vec_id, layout, CAST(width AS INTEGER) AS width, 32 AS packed_width, round(list_sum(list_transform(range(1, 11), lambda i: l[i] * i)), 6) AS left_sum,
  round(list_sum(list_transform(range(1, 11), lambda i: r[i] * i)), 6) AS right_sum, 0.0::DOUBLE AS lost FROM p""")
def converted_actions(spark: SparkSession, d: str) -> DataFrame:
    """Whole actions of eight layouts packed and unpacked by rules with wildcards; lost is the largest difference."""
    df = _vectors(spark, d).selectExpr("vec_id", "v", *[f"{e} AS {c}" for c, e in _NAMES.items()])
    own = RULES.compiled(F.col("embodiment"), F.col("key"), F.lit)
    width = RULES.compiled(F.col("embodiment"), F.col("key"), lambda n: F.lit(P.LAYOUTS[n].width))
    df = df.withColumn("layout", own).withColumn("a", F.slice("v", F.lit(1), width))
    df = df.withColumn("p", RULES.pack(F.col("embodiment"), F.col("key"), F.col("a")))
    df = df.withColumn("back", RULES.unpack(F.col("embodiment"), F.col("key"), F.col("p")))
    total = lambda at: F.round(F.aggregate(F.transform(F.slice("p", at, 10), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)
    lost = F.array_max(F.zip_with("a", "back", lambda x, y: F.abs(x - y)))
    return df.select("vec_id", "layout", F.size("a").alias("width"), F.size("p").alias("packed_width"), total(1).alias("left_sum"), total(11).alias("right_sum"), F.round(lost, 6).alias("lost"))


@query("G19 G22", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
a AS (SELECT vec_id, v, CAST(k AS INTEGER) AS arm, v[7*k+4]/2 AS y, v[7*k+5]/2 AS p, v[7*k+6]/2 AS r FROM e, (SELECT unnest([0, 1]) AS k))
SELECT vec_id, arm, round(v[7*arm+1], 6) AS x, round(cos(y)*cos(p)*cos(r) + sin(y)*sin(p)*sin(r), 6) AS qw, round(cos(y)*cos(p)*sin(r) - sin(y)*sin(p)*cos(r), 6) AS qx,
  round(cos(y)*sin(p)*cos(r) + sin(y)*cos(p)*sin(r), 6) AS qy, round(sin(y)*cos(p)*cos(r) - cos(y)*sin(p)*sin(r), 6) AS qz, round(v[7*arm+7], 6) AS gripper FROM a""")
def arms_of_actions(spark: SparkSession, d: str) -> DataFrame:
    df = _vectors(spark, d).select("vec_id", F.posexplode(P.arms_of(F.slice("v", 1, 14))).alias("arm", "a"))
    numbers = [F.round(F.col("a.pose")[k], 6).alias(n) for k, n in ((0, "x"), (3, "qw"), (4, "qx"), (5, "qy"), (6, "qz"))]
    return df.select("vec_id", "arm", *numbers, F.round("a.gripper", 6).alias("gripper"))


_STEP = "sqrt(list_sum(list_transform(range({a}, {b}), lambda i: (v[i] - l[i]) ** 2)))"
_POINTS = "list_max(list_transform(range(21), lambda k: sqrt((v[{o}+3*k+1]-l[{o}+3*k+1])**2 + (v[{o}+3*k+2]-l[{o}+3*k+2])**2 + (v[{o}+3*k+3]-l[{o}+3*k+3])**2)))"


@query("W7 W8", f"""WITH e AS (SELECT label AS episode, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT *, lag(v) OVER w AS l, lag(vec_id) OVER w AS before FROM e WINDOW w AS (PARTITION BY episode ORDER BY t)),
p AS (SELECT *, coalesce({_STEP.format(a=1, b=8)} < 0.55 AND {_STEP.format(a=8, b=15)} < 0.55 AND (vec_id % 3 = 0 OR before % 3 = 0 OR {_POINTS.format(o=0)} < 0.62) AND {_POINTS.format(o=1)} < 0.66, false) AS still FROM s),
k AS (SELECT *, NOT (still AND coalesce(lag(still) OVER (PARTITION BY episode ORDER BY t), false)) AS keep FROM p)
SELECT episode, t, still, keep, CASE WHEN keep THEN CAST(count(*) FILTER (keep) OVER (PARTITION BY episode ORDER BY t) - 1 AS BIGINT) END AS kept_idx FROM k""")
def pauses_of_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Frames in which both wrists and all landmarks rest; in every third frame the left hand's landmarks are absent."""
    df = _poses(spark, d).withColumn("left_keys", F.when(F.col("vec_id") % 3 != 0, F.col("left_keys")))
    df = df.withColumn("still", F.coalesce(W.moved_less_in_space({"left_obs": 0.55, "right_obs": 0.55}, {"left_keys": 0.62, "right_keys": 0.66}), F.lit(False)))
    df = W.pause_keep(df, F.col("still"))
    kept = W.renumber(df.filter("keep")).select("episode", "t", "kept_idx")
    return df.select("episode", "t", "still", "keep").join(kept, ["episode", "t"], "left")


@query("B12 F9 F11", """WITH e AS (
  SELECT label AS episode, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.episode, a.t, 5 AS steps, round(z.v[15], 6) AS last_x, round(list_sum(a.v[1:8]), 6) AS image, 'step ' || a.t AS annotation, 'actions_cartesian,dino_front_1' AS actions_only
FROM e a JOIN e z ON z.episode = a.episode AND z.t = least(a.t + 4, a.n - 1)""")
def alignment_view(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of actions, embeddings of images and annotations by the key map of alignment training, and its view of actions
    alone."""
    df = W.chunk(_poses(spark, d).join(_vectors(spark, d).select("vec_id", "v"), "vec_id"), "left_cmd", 5, "actions_cartesian")
    df = df.withColumn("dino.front_img_1", F.slice("v", 1, 8)).withColumn("annotations", F.concat(F.lit("step "), F.col("t").cast("string")))
    view = S.by_kinds(df, S.ALIGNMENT, ["episode", "t"])
    alone = S.by_kinds(df, S.ALIGNMENT, [], S.SEEN_OR_SAID).columns
    total = F.aggregate("dino_front_1", F.lit(0.0), lambda s, x: s + x)
    return view.select(
        "episode", "t", F.size("actions_cartesian").alias("steps"), F.round(F.element_at("actions_cartesian", -1)[0], 6).alias("last_x"), F.round(total, 6).alias("image"),
        F.col("annotations").alias("annotation"), F.lit(",".join(alone)).alias("actions_only"),
    )
