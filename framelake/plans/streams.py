"""Queries with event-time windows, in the form that runs on streams as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.registry import query
from framelake.plans.standins import load
from framelake.streaming import windows as W


@query("M2 M3", """WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 3600000000 * 3600, epoch_us(ts) // 3600000000 * 3600 - 3600]) AS start FROM events) SELECT start AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY start, event_type""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    df = W.windowed(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "1 hour", "1 day")
    return df.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("W20 M7", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    df = W.sessions(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 day")
    return df.select("user_id", F.unix_micros("window.start").alias("start_us"), "n")
