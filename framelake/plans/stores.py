"""Queries through stores and folders that they write first: resolvers, counted batches, drifting CSV files, companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.registry import query
from framelake.plans.standins import load
from framelake.sources import folders as D
from framelake.sources import resolver as R
from framelake.sources.commits import CommittedTable, CountError
from framelake.sources.scratch import steps
from framelake.streaming import rates as M

_EPISODES = """f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value, event_type FROM events),
g AS (SELECT user_id, count(*) AS n, user_id % 9 = 0 AS blank, user_id % 7 = 0 AS absent, user_id % 10 = 1 AS short FROM events WHERE user_id % 4 <> 3 GROUP BY user_id)"""


def _episodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Users as episodes: the frames of most of them, and a registry that names others too and expects too much of some."""
    number = F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT)")
    frames = load(spark, d, "events").select(F.col("user_id").cast("string").alias("episode_hash"), number.alias("frame_idx"), "value", F.col("event_type").alias("kind"), "user_id")
    registry = frames.groupBy("episode_hash", "user_id").agg((F.count(F.lit(1)) + F.when(F.col("user_id") % 10 == 1, 3).otherwise(0)).alias("num_frames"))
    path = F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.concat(F.lit("s3://store/"), "episode_hash"))
    return frames.filter("user_id % 7 <> 0").drop("user_id"), registry.withColumn("zarr_processed_path", path)


@query("S10 S9 S5 S6 S21", f"WITH {_EPISODES} SELECT CAST(f.user_id AS VARCHAR) AS episode_hash, t AS frame_idx, value FROM f JOIN g ON g.user_id = f.user_id WHERE NOT blank AND NOT absent AND NOT short AND t BETWEEN 1 AND 5")
def resolved_frames(spark: SparkSession, d: str) -> DataFrame:
    """A store of frames, read by a filter on the registry: only chosen episodes, frames and columns."""
    frames, registry = _episodes(spark, d)
    with steps(spark) as own:
        R.write_store(frames, f"{own.path}/store")
        return own.result(R.resolve(registry.filter("user_id % 4 <> 3"), f"{own.path}/store", ["value"], 1, 6).frames)


@query("S9 S13 J1", f"""WITH {_EPISODES} SELECT CAST(user_id AS VARCHAR) AS episode_hash,
  CASE WHEN blank THEN 'no path' WHEN absent THEN 'not in the store' ELSE n || ' of ' || (n + 3) || ' frames' END AS reason FROM g WHERE blank OR absent OR short""")
def unresolved_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of the same filter that couldn't be read, and why."""
    frames, registry = _episodes(spark, d)
    with steps(spark) as own:
        R.write_store(frames, f"{own.path}/store")
        return own.result(R.resolve(registry.filter("user_id % 4 <> 3"), f"{own.path}/store", ["value"], 1, 6).errors)


@query("S7 S4 S17", f"""WITH {_EPISODES}, s AS (SELECT DISTINCT user_id, user_id % 5 AS first, user_id % 5 + 4 AS e FROM f WHERE user_id % 7 <> 0 AND user_id % 2 = 0)
SELECT CAST(f.user_id AS VARCHAR) AS episode_hash, s.first, count(*) AS n, round(sum(f.value), 4) AS total, max(m.n) AS total_frames FROM f JOIN s ON s.user_id = f.user_id AND f.t >= s.first AND f.t < s.e
JOIN (SELECT user_id, count(*) AS n FROM f GROUP BY user_id) m ON m.user_id = f.user_id GROUP BY f.user_id, s.first""")
def slices_of_episodes(spark: SparkSession, d: str) -> DataFrame:
    """A slice of each second episode, beside the episode's metadata."""
    frames, registry = _episodes(spark, d)
    first = (F.col("user_id") % 5).alias("first")
    slices = registry.filter("user_id % 2 = 0").select("episode_hash", first, (first + 4).alias("end"))
    with steps(spark) as own:
        R.write_store(frames, f"{own.path}/store")
        got = R.read_slices(spark, f"{own.path}/store", slices, ["value"]).groupBy("episode_hash", "first").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        return own.result(got.join(R.metadata(spark, f"{own.path}/store").select("episode_hash", "total_frames"), "episode_hash"))


@query("K2 K5 K6 M2", """SELECT user_id % 4 AS batch, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) * 2, 4) AS doubled, CAST(max(user_id % 4) = 1 AS BOOLEAN) AS written_again
FROM events WHERE user_id % 4 <> 3 GROUP BY user_id % 4""")
def counted_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches written with their counts: one of them twice, one refused since a row lacks, and a column added to all."""
    e = load(spark, d, "events").withColumn("b", F.col("user_id") % 4)
    with steps(spark) as own:
        t = CommittedTable(spark, f"{own.path}/table")
        t.append(e.filter("b = 1 AND value > 50").drop("b"), 1)
        for k in range(3):
            t.append(e.filter(F.col("b") == k).drop("b"), k)
        last = e.filter("b = 3").drop("b")
        try:
            t.append(last, 3, expected=last.count() + 1)
        except CountError:
            pass
        t.with_column("doubled", F.col("value") * 2)
        t.with_column("doubled", F.col("value") * 5, if_there="skip")
        n = t.log().select("batch", (F.col("seq") == 4).alias("_new"))
        got = t.read().groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("doubled"), 4).alias("doubled"))
        return own.result(got.join(n.filter("_new"), "batch").select("batch", "n", "total", "doubled", (F.col("batch") == 1).alias("written_again")))


@query("S32 S25 S36 S22", """SELECT c_nationkey, c_custkey AS id, c_name AS operator, CASE WHEN c_nationkey % 3 <> 1 THEN c_mktsegment END AS scene, CASE WHEN c_nationkey % 3 = 2 THEN CAST(c_acctbal AS DOUBLE) END AS balance FROM customer""")
def drifting_files(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for each nation, with other headers in other orders, quoted fields and blank lines, as one table."""
    c = load(spark, d, "customer")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    name, segment, key = quoted(F.col("c_name")), quoted(F.col("c_mktsegment")), F.col("c_custkey").cast("string")
    kind = F.col("c_nationkey") % 3
    line = F.when(kind == 0, F.concat_ws(",", key, name, segment)).when(kind == 1, F.concat_ws(",", name, key)).otherwise(F.concat_ws(",", segment, key, F.col("c_acctbal").cast("string"), name))
    header = F.when(kind == 0, "id, collector ,scene_number").when(kind == 1, "\n,,\noperator,id").otherwise("scene,id,balance,collector")
    files = c.groupBy("c_nationkey").agg(F.concat_ws("\n", F.first(header), F.array_join(F.collect_list(line), "\n,\n")).alias("value"))
    with steps(spark) as own:
        files.write.partitionBy("c_nationkey").text(f"{own.path}/csv")
        rows = D.read_drifting(spark, f"{own.path}/csv", glob="part-*")
        nation = F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("int")
        got = D.columns_of(rows.withColumn("c_nationkey", nation), ["id", "operator", "scene", "balance"], "c_nationkey")
        return own.result(got.withColumn("id", F.col("id").cast("long")).withColumn("balance", F.col("balance").cast("double")))


_LISTED = """d AS (SELECT doc_id, '/raw/' || coalesce(source, 'none') || '/' AS dir, 'ep' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS base FROM documents)"""


@query("S31 S32 J20", f"""WITH {_LISTED} SELECT dir || base || '_meta.csv' AS meta_path, base, dir || base || CASE WHEN doc_id % 4 = 1 THEN '.VRS' WHEN doc_id % 4 = 2 THEN '-b.vrs' ELSE '.vrs' END AS main_path,
  CASE WHEN doc_id % 4 = 0 THEN dir || base || '.vrs.json' END AS side_path FROM d WHERE doc_id % 4 <> 3""")
def file_groups(spark: SparkSession, d: str) -> DataFrame:
    """A listing of files joined with itself: metadata files with their recordings and what stands beside those."""
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("/raw/"), F.coalesce("source", F.lit("none")), F.lit("/ep"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("stem"))
    kind = F.col("doc_id") % 4
    ends = F.when(kind == 0, F.array(F.lit("_meta.csv"), F.lit(".vrs"), F.lit(".vrs.json"), F.lit("-a.vrs"))).when(kind == 1, F.array(F.lit("_meta.csv"), F.lit(".VRS"))).when(kind == 2, F.array(F.lit("_meta.csv"), F.lit("-b.vrs"), F.lit("-c.vrs"))).otherwise(F.array(F.lit("_meta.csv"), F.lit(".txt")))
    return D.groups(docs.select(F.explode(F.transform(ends, lambda x: F.concat("stem", x))).alias("path")))


@query("S31 S30", f"""WITH {_LISTED} SELECT dir || base || '.vrs' AS path FROM d WHERE doc_id % 3 <> 1""")
def files_with_companions(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("/raw/"), F.coalesce("source", F.lit("none")), F.lit("/ep"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("stem"))
    ends = F.when(F.col("doc_id") % 3 == 1, F.array(F.lit(".vrs"))).otherwise(F.array(F.lit(".vrs"), F.lit(".vrs.json")))
    return D.with_rewritten(docs.select(F.explode(F.transform(ends, lambda x: F.concat("stem", x))).alias("path")), ".vrs", ".vrs.json")


@query("M1 W15", """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS device, event_id AS frame, ts, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events),
g AS (SELECT device, frame, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device ORDER BY ts, frame) AS p FROM o WHERE top IS NULL OR frame > top),
r AS (SELECT *, CASE WHEN count(p) OVER w = 3 THEN 3e6 / sum(p) OVER w END AS rate FROM g WINDOW w AS (PARTITION BY device ORDER BY ts, frame ROWS 2 PRECEDING)),
k AS (SELECT *, CASE WHEN rate < 0.00003 * 0.5 THEN 'slow' WHEN rate > 0.00003 * 1.5 THEN 'fast' END AS off FROM r), b AS (SELECT *, lag(off) OVER (PARTITION BY device ORDER BY ts, frame) AS before FROM k)
SELECT device, frame, 'late' AS problem, NULL AS rate FROM o WHERE frame < top UNION ALL SELECT device, frame, 'repeated', NULL FROM o WHERE frame = top
UNION ALL SELECT device, frame, off, round(rate * 1e6, 4) FROM b WHERE off IS NOT NULL AND before IS NULL""")
def rate_problems(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of devices that should come about every nine hours: late and repeated ones, and rates off their target."""
    e = load(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("ts"))
    return M.problems(e, 0.00003, 3, 0.5).select("device", "frame", "problem", F.round(F.col("rate") * 1e6, 4).alias("rate"))
