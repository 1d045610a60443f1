"""Queries that compare whole vectors of a group with each other: warping partners and blocks of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import information as N
from framelake.operators import pairing as P
from framelake.plans.registry import query
from framelake.plans.standins import load

BAND = 4


def _warping_sql(band: int) -> str:
    """Dynamic programming over the rows of the band, one recursion a step and one column a diagonal."""
    diagonals = range(2 * band + 1)
    at = lambda k: f"r.i + {k - band}"
    inf = "'infinity'::DOUBLE"
    cell = lambda k: f"coalesce((r.a[r.i] - r.b[CASE WHEN {at(k)} BETWEEN 1 AND 64 THEN {at(k)} END]) ** 2, {inf})"
    best = lambda k: ", ".join([f"r.c{k}", f"r.c{k + 1}" if k < 2 * band else inf, f"d{k - 1}" if k else inf])
    steps = ", ".join(f"{cell(k)} + least({best(k)}) AS d{k}" for k in diagonals)
    start = ", ".join(f"{'0.0::DOUBLE' if k == band else inf} AS c{k}" for k in diagonals)
    return f"""WITH RECURSIVE e AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
w AS (
  SELECT a.vec_id, b.vec_id AS other, a.v AS a, b.v AS b, 1 AS i, {start}
  FROM e a JOIN e b ON b.label = a.label AND b.vec_id % 2 = 1 WHERE a.vec_id % 2 = 0
  UNION ALL
  SELECT vec_id, other, a, b, i + 1, {", ".join(f"d{k}" for k in diagonals)}
  FROM (SELECT r.vec_id, r.other, r.a, r.b, r.i, {steps} FROM w r WHERE r.i <= 64))
SELECT vec_id, other, round(c{band}, 6) AS distance FROM w WHERE i = 65
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c{band}, other) = 1"""


@query("J19 E4", _warping_sql(BAND))
def warping_partners(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors as sequences: for each even row the odd row of its label that is nearest by time warping."""
    df = load(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    found = P.nearest_by_warping(df.filter("vec_id % 2 = 0"), df.filter("vec_id % 2 = 1"), "label", "vec_id", "x", BAND)
    return found.select("vec_id", "other", F.round("distance", 6).alias("distance"))


_TRAILS = """e AS (SELECT event_type AS label, event_id, value AS x, epoch_us(ts) / 60000000.0::DOUBLE AS y FROM events)"""


@query("J17 J18", f"""WITH {_TRAILS}, n AS (
  SELECT a.label, a.event_id, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[4] AS eps FROM e a JOIN e b ON b.label = a.label GROUP BY a.label, a.event_id)
SELECT a.label, a.event_id, round(n.eps, 6) AS eps, count(*) FILTER (abs(a.x - b.x) < n.eps * (1 - 1e-10)) - 1 AS nx
FROM e a JOIN n ON n.event_id = a.event_id JOIN e b ON b.label = a.label GROUP BY a.label, a.event_id, n.eps""")
def neighbour_reach(spark: SparkSession, d: str) -> DataFrame:
    """Events as points of value and minute: the distance of each to its third neighbour of its kind in the maximum norm, and
    how many are nearer in value alone."""
    minutes = F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000.0
    df = load(spark, d, "events").select(F.col("event_type").alias("label"), "event_id", F.array("value").alias("x"), F.array(minutes).alias("y"))
    return N.reach_counts(df, "label", "event_id", "x", "y", 3).select("label", "event_id", F.round("eps", 6).alias("eps"), "nx")
