from __future__ import annotations

from conftest import DATA
from framelake.operators import windows as W
from framelake.streaming import windows as S
from pyspark.sql import functions as F


def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def in_files(spark, df, path, n):
    for k in range(n):
        df.filter(F.pmod(F.xxhash64("event_id"), F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    df = events(spark)
    q = S.windowed(in_files(spark, df, str(tmp_path / "in"), 3), "2 hours", "1 hour", "1000 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    cols = ["window.start", "event_type", "n"]
    got = sorted(map(str, spark.table("w").select(*cols).collect()))
    assert got == sorted(map(str, S.windowed(df, "2 hours", "1 hour", "1 day").select(*cols).collect()))


def test_pauses_on_a_stream_equal_the_batch(spark, tmp_path):
    df = events(spark).select("event_id", F.col("user_id").alias("episode"), "ts", F.floor(F.col("value") / 30).cast("double").alias("value"))
    cut = df.approxQuantile("event_id", [0.5], 0.0)[0]
    for part in (F.col("event_id") <= cut, F.col("event_id") > cut):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.stream_pauses(stream.select("episode", "ts", "value"), 0.5).writeStream.outputMode("append").format("memory").queryName("p").start()
    q.processAllAvailable()
    q.stop()
    w = df.withColumn("t", F.expr("row_number() OVER (PARTITION BY episode ORDER BY ts)"))
    want = W.pause_keep(w, W.moved_less(["value"], 0.5)).select("episode", "ts", "keep")
    assert sorted(map(tuple, spark.table("p").select("episode", "ts", "keep").collect())) == sorted(map(tuple, want.collect()))


def test_append_once(spark, tmp_path):
    df = events(spark)
    stream = in_files(spark, df, str(tmp_path / "in"), 2)
    for _ in range(2):
        q = S.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
