"""Queries on frame tables: chunks, pauses, fills, runs, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import joins as J
from framelake.operators import statistics as S
from framelake.operators import windows as W
from framelake.plans.registry import query
from framelake.plans.standins import FRAMES_SQL, SPANS_SQL, frames, load, spans

_STILL = f"""WITH {FRAMES_SQL}, p AS (SELECT *, coalesce(abs(value - lag(value) OVER w) < 5, FALSE) AS p FROM frames WINDOW w AS (PARTITION BY episode ORDER BY t)),
q AS (SELECT *, NOT (p AND coalesce(lag(p) OVER (PARTITION BY episode ORDER BY t), FALSE)) AS keep FROM p),
kept AS (SELECT episode, t, kind, value, row_number() OVER (PARTITION BY episode ORDER BY t) - 1 AS k FROM q WHERE keep)"""


def _kept(spark: SparkSession, d: str) -> DataFrame:
    df = W.pause_keep(frames(spark, d), W.moved_less(["value"], 5.0))
    return W.renumber(df.filter("keep"))


@query("F1 W7 W8 W1 A1 D2", f"""{_STILL}, c AS (SELECT a.kind, h.step, coalesce(b.value, l.value) AS v FROM kept a CROSS JOIN (SELECT unnest(range(8)) AS step) h LEFT JOIN kept b ON b.episode = a.episode AND b.k = a.k + h.step
  JOIN (SELECT episode, arg_max(value, k) AS value FROM kept GROUP BY episode) l ON l.episode = a.episode WHERE a.kind <> 'error')
SELECT kind AS key, CAST(step AS INTEGER) AS step, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(median(v), 6) AS median, round(quantile_cont(v, 0.01), 6) AS q1, round(quantile_cont(v, 0.99), 6) AS q99,
 round(quantile_cont(v, 0.0001), 6) AS q0_01, round(quantile_cont(v, 0.9999), 6) AS q99_99 FROM c GROUP BY kind, step""")
def chunk_norm_stats(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: pauses out, chunks of the frames that are left, exact statistics of each step."""
    chunks = W.chunk(_kept(spark, d), "value", 8).filter("kind <> 'error'")
    steps = chunks.select(F.col("kind").alias("key"), F.posexplode("chunk").alias("step", "v"))
    return S.rounded(S.norm_stats(steps, ["key", "step"], "v"))


@query("W7 W8", f"{_STILL} SELECT episode, t, k AS kept_idx FROM kept")
def pause_filter(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("episode", "t", "kept_idx")


@query("W1 W2 W6 W18", f"""WITH {FRAMES_SQL}, n AS (SELECT episode, max(t) AS m FROM frames GROUP BY episode)
SELECT f.episode, f.t, CAST(s.i AS INTEGER) AS step, g.value FROM frames f JOIN n ON n.episode = f.episode CROSS JOIN (SELECT unnest(range(3)) AS i) s JOIN frames g ON g.episode = f.episode AND g.t = least(f.t + 4 * s.i, least(f.t + 9, n.m))""")
def strided_chunks(spark: SparkSession, d: str) -> DataFrame:
    df = W.chunk(frames(spark, d), "value", 10)
    return df.select("episode", "t", F.posexplode(W.strided(F.col("chunk"), 4, 3)).alias("step", "value"))


_CHUNK_END = f"""WITH {SPANS_SQL}, e AS (SELECT f.episode, f.t, f.value, arg_max(s.end_idx, s.ordinal) AS stop FROM frames f LEFT JOIN spans s ON s.episode = f.episode AND f.t >= s.start_idx AND f.t < s.end_idx GROUP BY ALL)"""


@query("W3 W4", f"""{_CHUNK_END}, m AS (SELECT episode, max(t) AS m FROM frames GROUP BY episode)
SELECT e.episode, e.t, CAST(least(6, coalesce(e.stop - e.t, 6), m.m - e.t + 1) AS INTEGER) AS n, g.value AS last FROM e JOIN m ON m.episode = e.episode JOIN frames g ON g.episode = e.episode AND g.t = e.t + least(6, coalesce(e.stop - e.t, 6), m.m - e.t + 1) - 1""")
def chunks_within_spans(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d)
    own = spans(spark, d).select("episode", "ordinal", "start_idx", "end_idx", F.col("end_idx").alias("text"))
    ends = J.interval_join(df.select("episode", "t"), own, pick="last").withColumnRenamed("text", "stop")
    df = W.chunk(df.join(ends, ["episode", "t"]), "value", 6, limit="stop", zero=F.lit(None).cast("double"))
    real = F.filter("chunk", lambda x: x.isNotNull())
    return df.select("episode", "t", F.size(real).alias("n"), F.element_at(real, -1).alias("last"))


@query("W5 R28", f"""WITH {SPANS_SQL} SELECT s.episode, s.ordinal, a.value AS bos, b.value AS eos FROM spans s JOIN frames a ON a.episode = s.episode AND a.t = s.start_idx LEFT JOIN frames b ON b.episode = s.episode AND b.t = s.end_idx""")
def span_ends(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t, v: frames(spark, d).select("episode", F.col("t").alias(t), F.col("value").alias(v))
    return spans(spark, d).join(at("start_idx", "bos"), ["episode", "start_idx"]).join(at("end_idx", "eos"), ["episode", "end_idx"], "left").select("episode", "ordinal", "bos", "eos")


@query("W9", f"""WITH {FRAMES_SQL}, z AS (SELECT episode, t, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM frames)
SELECT episode, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM z""")
def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.fill(frames(spark, d), "value", F.col("event_id") % 3 == 0).select("episode", "t", "value")


@query("W10 A7 A8", f"""WITH {FRAMES_SQL}, v AS (SELECT episode, t, value > 1.5 AS ok FROM frames), a AS (SELECT episode, min(t) FILTER (ok) AS first, max(t) FILTER (ok) AS last, count(*) FILTER (ok) AS n_valid FROM v GROUP BY episode)
SELECT episode, first, last, n_valid, CASE WHEN n_valid = 0 THEN 'no valid frame' WHEN n_valid < last - first + 1 THEN 'gap' END AS reject_reason FROM a""")
def validity_windows(spark: SparkSession, d: str) -> DataFrame:
    return W.strict_window(frames(spark, d), F.col("value") > 1.5)


@query("W11", f"""WITH {SPANS_SQL}, n AS (SELECT *, lead(start_idx) OVER (PARTITION BY episode ORDER BY start_idx) AS nxt FROM spans)
SELECT episode, ordinal, start_idx, CASE WHEN nxt - end_idx > 0 AND nxt - end_idx < 9 THEN nxt ELSE end_idx END AS end_idx FROM n""")
def gap_closing(spark: SparkSession, d: str) -> DataFrame:
    return W.close_gaps(spans(spark, d), 9).select("episode", "ordinal", "start_idx", "end_idx")


@query("W12", f"""WITH {FRAMES_SQL}, c AS (SELECT *, kind IS NULL OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY episode ORDER BY t) AS ch FROM frames), r AS (SELECT *, sum(ch::INT) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT episode, CAST(run AS BIGINT) AS run, min(t) AS first, max(t) AS last, count(*) AS n FROM r GROUP BY episode, run HAVING count(*) >= 3""")
def stuck_frames(spark: SparkSession, d: str) -> DataFrame:
    return W.runs(frames(spark, d), "kind", 3)


@query("W13 Q13", f"""WITH {FRAMES_SQL} SELECT episode, t, bool_and(value < 60) OVER w AND count(*) OVER w = 5 AS ok FROM frames WINDOW w AS (PARTITION BY episode ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def validity_ahead(spark: SparkSession, d: str) -> DataFrame:
    return W.valid_ahead(frames(spark, d), F.col("value") < 60, 5).select("episode", "t", "ok")


@query("W15 M1", f"""WITH {FRAMES_SQL} SELECT episode, t, round(avg(value) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM frames""")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("episode", "t", F.round(F.avg("value").over(W.over().rowsBetween(-4, 0)), 6).alias("rolling"))


@query("W16 A16", f"""WITH {FRAMES_SQL}, n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode) SELECT episode, n, CAST(sum(n) OVER (ORDER BY episode) - n AS BIGINT) AS first_row FROM n""")
def episode_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return S.running_offset(sizes, "episode", "n", "first_row")


@query("W20 A22", f"""WITH {FRAMES_SQL}, g AS (SELECT episode, t, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY episode ORDER BY t) AS gap FROM frames)
SELECT episode, count(*) FILTER (gap >= 60000000) AS n_stalls, CAST(coalesce(sum(gap) FILTER (gap >= 60000000), 0) AS BIGINT) AS stalled_ms, count(*) AS n_frames FROM g GROUP BY episode""")
def stall_times(spark: SparkSession, d: str) -> DataFrame:
    df = W.stalls(frames(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "ms", 60_000_000)
    return df.groupBy("episode").agg(F.count_if("stalled").alias("n_stalls"), F.coalesce(F.sum(F.when(F.col("stalled"), F.col("gap"))), F.lit(0)).cast("long").alias("stalled_ms"), F.count(F.lit(1)).alias("n_frames"))


@query("M6 R25", f"WITH {FRAMES_SQL} SELECT episode, t, t // 6 AS query_no, t % 6 AS step, arg_min(value, t) OVER (PARTITION BY episode, t // 6) AS anchor FROM frames")
def receding_horizon(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d).withColumn("query_no", F.floor(F.col("t") / 6)).withColumn("step", F.pmod("t", F.lit(6)))
    first = df.filter("step = 0").select("episode", "query_no", F.col("value").alias("anchor"))
    return df.join(first, ["episode", "query_no"]).select("episode", "t", "query_no", "step", "anchor")


@query("J7 D5", f"""WITH {SPANS_SQL} SELECT f.episode, f.t, coalesce(string_agg(s.text, '|' ORDER BY s.ordinal), '') AS texts FROM frames f LEFT JOIN spans s ON s.episode = f.episode AND f.t >= s.start_idx AND f.t < s.end_idx GROUP BY f.episode, f.t""")
def spans_of_frames(spark: SparkSession, d: str) -> DataFrame:
    return J.interval_join(frames(spark, d), spans(spark, d)).select("episode", "t", F.array_join("texts", "|").alias("texts"))


@query("J8 Q15", f"""WITH {SPANS_SQL} SELECT f.episode, f.t, arg_max(s.text, s.ordinal) AS text FROM frames f LEFT JOIN spans s ON s.episode = f.episode AND f.t BETWEEN s.start_idx AND s.end_idx GROUP BY f.episode, f.t""")
def last_span_of_frames(spark: SparkSession, d: str) -> DataFrame:
    return J.interval_join(frames(spark, d), spans(spark, d), closed="both", pick="last").select("episode", "t", "text")


@query("J10 J11", f"""WITH {SPANS_SQL}, a AS (SELECT f.episode, f.t, arg_min(s.text, s.ordinal) AS text FROM frames f LEFT JOIN spans s ON s.episode = f.episode AND f.t BETWEEN s.start_idx AND s.end_idx GROUP BY f.episode, f.t)
SELECT episode, t, coalesce(last_value(text IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(text IGNORE NULLS) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'task') AS text FROM a""")
def label_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    labelled = J.interval_join(frames(spark, d), spans(spark, d), closed="both", pick="first")
    return J.with_previous(labelled).select("episode", "t", F.coalesce("text", F.lit("task")).alias("text"))


@query("J9 S24", f"""WITH {FRAMES_SQL}, c AS (SELECT episode, t, (epoch_us(ts) // 1000) AS ms FROM frames WHERE kind <> 'view'), p AS (SELECT episode, (epoch_us(ts) // 1000) AS ms, value FROM frames WHERE kind = 'view'),
j AS (SELECT c.episode, c.t, arg_min(p.value, abs(p.ms - c.ms) * 2 + CASE WHEN p.ms > c.ms THEN 1 ELSE 0 END) AS value FROM c LEFT JOIN p ON p.episode = c.episode GROUP BY c.episode, c.t) SELECT * FROM j""")
def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    left, right = df.filter("kind <> 'view'").select("episode", "t", "ms"), df.filter("kind = 'view'").select("episode", "ms", "value")
    return J.asof_nearest(left, right, ["episode"], "ms", "value").select("episode", "t", "value")


@query("J13 S27", f"""WITH {FRAMES_SQL}, b AS (SELECT episode, t, value AS shift FROM frames WHERE t % 2 = 0), m AS (SELECT min(t) AS m FROM b WHERE t > 1)
SELECT f.episode, f.t - m.m AS frame, round(f.value + b.shift, 6) AS x FROM frames f JOIN b ON b.episode = f.episode AND b.t = f.t CROSS JOIN m WHERE f.t > 1""")
def landmarks_in_body_frame(spark: SparkSession, d: str) -> DataFrame:
    df = frames(spark, d)
    body = df.filter("t % 2 = 0").select("episode", "t", F.col("value").alias("shift"))
    joined = df.filter("t > 1").join(body, ["episode", "t"])
    base = joined.agg(F.min("t").alias("m"))
    return joined.crossJoin(F.broadcast(base)).select("episode", (F.col("t") - F.col("m")).alias("frame"), F.round(F.col("value") + F.col("shift"), 6).alias("x"))


@query("A9", f"WITH {FRAMES_SQL}, k AS (SELECT episode, count(*) FILTER (kind = 'view') AS a, count(*) FILTER (kind = 'click') AS b, count(*) FILTER (kind = 'error') AS c FROM frames GROUP BY episode) SELECT episode, least(a, b, c) AS common_frames FROM k")
def common_frames(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return frames(spark, d).groupBy("episode").agg(F.least(n("view"), n("click"), n("error")).alias("common_frames"))


@query("A10 A11 R20", f"""WITH {FRAMES_SQL}, z AS (SELECT episode, count(*) AS n, count(DISTINCT t) FILTER (value < 2) AS zeros FROM frames GROUP BY episode), s AS (SELECT episode, n, zeros, round(zeros / n, 6) AS share, CASE WHEN zeros / n > 0.05 THEN 'failed' ELSE 'ok' END AS status FROM z)
SELECT status, count(*) AS n, round(avg(share), 6) AS mean, round(median(share), 6) AS median, max(share) AS max FROM s GROUP BY status""")
def zero_frame_health(spark: SparkSession, d: str) -> DataFrame:
    share = F.round(F.countDistinct(F.when(F.col("value") < 2, F.col("t"))) / F.count(F.lit(1)), 6)
    raw = F.countDistinct(F.when(F.col("value") < 2, F.col("t"))) / F.count(F.lit(1))
    df = frames(spark, d).groupBy("episode").agg(share.alias("share"), F.when(raw > 0.05, "failed").otherwise("ok").alias("status"))
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean"), F.round(F.median("share"), 6).alias("median"), F.max("share").alias("max"))


@query("S5 S7 S6 F17", f"WITH {FRAMES_SQL} SELECT episode, t, value FROM frames WHERE t BETWEEN 5 AND 9 AND value < 90")
def frame_ranges(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).filter(F.col("t").between(5, 9) & (F.col("value") < 90)).select("episode", "t", "value")
