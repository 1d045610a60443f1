from __future__ import annotations

import json

import pytest
from framelake.sources import episodes as E
from pyspark.sql import functions as F


@pytest.fixture
def frames(spark):
    return spark.range(40).select(F.when(F.col("id") < 20, "a").otherwise("b").alias("episode_hash"), (F.col("id") % 20).alias("frame_idx"), F.lit("eva").alias("embodiment"), F.col("id").cast("double").alias("x"))


def test_frames(spark, frames, tmp_path):
    E.write_frames(frames, str(tmp_path / "f"), ["x"])
    got = E.read_range(spark, str(tmp_path / "f"), 3, 5, ["x"])
    assert sorted(map(tuple, got.collect())) == [("a", 3, 3.0), ("a", 4, 4.0), ("b", 3, 23.0), ("b", 4, 24.0)]
    assert "GreaterThanOrEqual(frame_idx,3)" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="'a'"):
        E.write_frames(frames.filter("episode_hash = 'b' OR frame_idx <> 7"), str(tmp_path / "g"), ["x"])
    with pytest.raises(ValueError):
        E.write_frames(frames.withColumn("x", F.nullif("x", F.lit(5.0))), str(tmp_path / "g"), ["x"])


def test_spans(spark, tmp_path):
    p = str(tmp_path / "s")
    raw = spark.createDataFrame([("e", "main", b'{"text": "a", "start_idx": 0, "end_idx": 2}'), ("e", "other", b'{"text": "b", "start_idx": 2, "end_idx": 3}')], "episode_hash string, track string, j binary")
    spans = E.spans_of_json(raw, "j")
    E.write_spans(spans, p)
    E.write_spans(spans.filter("track = 'main'"), p)
    assert spark.read.parquet(p).count() == 3
    E.write_spans(spans.filter("track = 'main'"), p, mode="overwrite")
    assert sorted(r["text"] for r in spark.read.parquet(p).collect()) == ["a", "b"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ep_42_meta.csv").write_text("label,start_time,end_time\npick,0.5,1\nput,x,2\n")
    got = E.read_label_files(spark, str(tmp_path / "in")).orderBy("text").collect()
    assert [tuple(r) for r in got] == [("42", "pick", 0.5, 1.0), ("42", "put", None, 2.0)]
    (tmp_path / "c.json").write_text(json.dumps([{"tar_filename": "a.tar", "episode_hash": "a", "n_frames": 3, "embodiment": "eva"}, {"episode_hash": "b", "n_frames": 9}]))
    assert [r["episode_hash"] for r in E.read_catalog(spark, str(tmp_path / "c.json"), 5).collect()] == ["b"]
    (tmp_path / "s.json").write_text(json.dumps({"fold": {"a": 1.5, "b": None}}))
    assert sorted(map(tuple, E.read_scores(spark, str(tmp_path / "s.json")).collect()), key=str) == [("fold", "a", 1.5), ("fold", "b", None)]


def test_bundles_and_registry(spark, tmp_path):
    for name in ("one/x.vrs", "one/x.json", "two/y.vrs"):
        (tmp_path / "b" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / name).write_text("x")
    files = E.listing(spark, str(tmp_path / "b"))
    assert {r["stem"] for r in files.collect()} == {"x", "y"}
    assert [r[0] for r in E.bundles(files, {"vrs": r"\.vrs$", "json": r"\.json$"}).collect()] == ["one"]
    spark.createDataFrame([("h", 3, "lab")], "episode_hash string, num_frames int, lab string").write.parquet(str(tmp_path / "r"))
    row = E.read_registry(spark, str(tmp_path / "r")).first()
    assert (row["episode_hash"], row["num_frames"], row["task"], row["lab"]) == ("h", 3, None, "lab")
