"""Resolvers, counted batches, drifting files and companions on made-up folders."""

from __future__ import annotations

import pytest
from framelake.sources import folders as D
from framelake.sources import resolver as R
from framelake.sources.commits import CommittedTable, CountError
from framelake.streaming import rates as M
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    frames = spark.range(200).select(F.concat(F.lit("e"), (F.col("id") % 20).cast("string")).alias("episode_hash"), F.floor(F.col("id") / 20).alias("frame_idx"), F.col("id").cast("double").alias("x"), F.lit("y").alias("other"))
    R.write_store(frames, str(tmp_path / "s"), buckets=8)
    return str(tmp_path / "s")


REGISTRY = "episode_hash string, zarr_processed_path string, num_frames int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_chosen_episodes_frames_and_columns_are_read(spark, store):
    registry = spark.createDataFrame([("e1", "p", 10), ("e1", "p", 10), ("e2", "p", None), ("e3", "p", -1), ("e4", " ", 10), ("e5", None, 10), ("e6", "p", 11), ("zz", "p", 10)], REGISTRY)
    got = R.resolve(registry, store, ["x"], 2, 4, buckets=8)
    assert sorted(map(tuple, got.frames.collect())) == sorted((f"e{k}", t, t * 20.0 + k) for k in (1, 2, 3) for t in (2, 3))
    assert sorted(map(tuple, got.errors.collect())) == [("e4", "no path"), ("e5", "no path"), ("e6", "10 of 11 frames"), ("zz", "not in the store")]
    text = plan(got.frames)
    assert "In(episode_hash" in text and "GreaterThanOrEqual(frame_idx,2)" in text and "PartitionFilters: [bucket" in text.replace("isnotnull(bucket#", "bucket") or "bucket#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "other" not in text.split("ReadSchema")[1].split(">")[0]


def test_many_episodes_are_found_by_a_join(spark, store, monkeypatch):
    monkeypatch.setattr(R, "NAMED", 2)
    registry = spark.createDataFrame([(f"e{k}", "p", 10) for k in range(5)], REGISTRY)
    assert R.resolve(registry, store, ["x"], buckets=8).frames.count() == 50


def test_slices_metadata_and_probe(spark, store):
    slices = spark.createDataFrame([("e1", 0, 2), ("e1", 1, 3), ("e7", 9, 20), ("no", 0, 1)], "episode_hash string, first int, end int")
    got = sorted(map(tuple, R.read_slices(spark, store, slices, ["x"], buckets=8).collect()))
    assert got == [("e1", 0, 2, 0, 1.0), ("e1", 0, 2, 1, 21.0), ("e1", 1, 3, 1, 21.0), ("e1", 1, 3, 2, 41.0), ("e7", 9, 20, 9, 187.0)]
    assert R.read_slices(spark, store, slices.limit(0), ["x"], buckets=8).count() == 0
    meta = {r["episode_hash"]: r for r in R.metadata(spark, store).collect()}
    assert len(meta) == 20 and meta["e3"].asDict() == {"episode_hash": "e3", "total_frames": 10, "first_frame": 0, "last_frame": 9, "x": 10, "other": 10}
    registry = spark.createDataFrame([("e9", "", 10), ("e8", "p", 10), ("e2", "p", 10)], REGISTRY)
    assert {r["episode_hash"] for r in R.probe(registry, store, [F.desc("episode_hash")], ["x"], buckets=8).collect()} == {"e8"}


def rows(spark, *ids):
    return spark.createDataFrame([(k, f"v{k}") for k in ids], "id long, v string")


def seen(t):
    return sorted((r["id"], r["batch"]) for r in t.read().collect())


def test_batches_land_once_and_in_full(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="nothing"):
        t.read()
    assert t.append(rows(spark, 1, 2), 0) == 2
    assert t.append(rows(spark, 3), 1, expected=1) == 1
    with pytest.raises(CountError, match="batch 2: 3 rows expected, 2 landed"):
        t.append(rows(spark, 4, 5), 2, expected=3)
    with pytest.raises(CountError):
        t.append(rows(spark, 9), 0, expected=2)
    assert seen(t) == [(1, 0), (2, 0), (3, 1)]
    t.append(rows(spark, 7, 8, 9), 0)
    assert seen(t) == [(3, 1), (7, 0), (8, 0), (9, 0)]
    assert t.vacuum() == 1 and t.vacuum() == 0
    assert seen(t) == [(3, 1), (7, 0), (8, 0), (9, 0)]
    # a folder without its line in the log is not part of the table
    rows(spark, 100).write.parquet(str(tmp_path / "t/data/99-5"))
    assert seen(t) == [(3, 1), (7, 0), (8, 0), (9, 0)]
    assert [tuple(r)[2:4] for r in t.log().orderBy("batch").collect()] == [(3, 3), (1, 1)]


def test_columns_are_added_skipped_or_overwritten(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, 1), 0)
    t.append(rows(spark, 2, 3), 1)
    assert t.with_column("w", F.col("id") * 2)
    with pytest.raises(ValueError, match="'w'"):
        t.with_column("w", F.lit(0))
    assert not t.with_column("w", F.lit(0), if_there="skip")
    assert sorted(r["w"] for r in t.read().collect()) == [2, 4, 6]
    assert t.with_column("w", F.col("id") + 0, if_there="overwrite")
    assert sorted(r["w"] for r in t.read().collect()) == [1, 2, 3]
    t.append(rows(spark, 4), 2)
    assert sorted((r["id"], r["w"]) for r in t.read().collect()) == [(1, 1), (2, 2), (3, 3), (4, None)]
    with pytest.raises(ValueError, match="if_there"):
        t.with_column("z", F.lit(1), if_there="maybe")


def test_a_stream_lands_once_over_restarts(spark, tmp_path):
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    t = CommittedTable(spark, str(tmp_path / "t"))
    for part in ((1, 2), (3,)):
        rows(spark, *part).coalesce(1).write.mode("append").parquet(source)
        t.sink(stream(), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [x for x, _ in seen(t)] == [1, 2, 3]
    assert all(r["expected"] == r["landed"] for r in t.log().collect())


def test_headers_drift(spark, tmp_path):
    files = {
        "a/x_meta.csv": "collector, scene_number,objects\nAnn,3,\"cup, plate\"\nBob,4,\n",
        "a/y_meta.csv": "﻿\n , \nobjects,operator,lab\n,,\n\n\"two\nlines\",Cy,L1,surplus\n",
        "b/z_meta.csv": "operator,collector\nfirst,second\n",
        "b/empty_meta.csv": "",
        "b/head_meta.csv": "operator\n",
        "b/other.csv": "operator\nno\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    got = D.columns_of(D.read_drifting(spark, str(tmp_path)), ["operator", "scene", "objects", "lab"], "path", "row")
    by = sorted((r["path"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in got.collect())
    assert by == [("x_meta.csv", 0, "Ann", "3", "cup, plate", None), ("x_meta.csv", 1, "Bob", "4", "", None), ("y_meta.csv", 0, "Cy", None, "two\nlines", "L1"), ("z_meta.csv", 0, "second", None, None, None)]
    first = D.read_drifting(spark, str(tmp_path), first_only=True).select(D.listed(F.try_element_at("fields", F.lit("objects"))).alias("o"))
    assert sorted(r["o"] for r in first.collect()) == [[], ["cup", "plate"], ["two\nlines"]]
    (tmp_path / "m.txt").write_text("t  x\n1 \t 2.5\n\n3 4\n")
    table = D.columns_of(D.read_drifting(spark, str(tmp_path), "m.txt", {}, delimiter=None), ["t", "x"])
    assert sorted(map(tuple, table.collect())) == [("1", "2.5"), ("3", "4")]


def test_companions(spark):
    names = ["/d/a_meta.csv", "/d/a.vrs", "/d/a.vrs.json", "/d/b_meta.csv", "/d/b.VRS", "/d/b1.vrs", "/d/c_meta.csv", "/d/c-2.Vrs", "/d/c-1.vrs", "/d/c-1.vrs.json", "/d/e_meta.csv", "/other/e.vrs"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = sorted(map(tuple, D.groups(files).collect()))
    assert got == [("/d/a_meta.csv", "a", "/d/a.vrs", "/d/a.vrs.json"), ("/d/b_meta.csv", "b", "/d/b.VRS", None), ("/d/c_meta.csv", "c", "/d/c-1.vrs", "/d/c-1.vrs.json")]
    assert sorted(r[0] for r in D.with_rewritten(files, ".vrs", ".vrs.json").collect()) == ["/d/a.vrs", "/d/c-1.vrs"]


def test_rates_on_a_stream_equal_the_table_over_restarts(spark, tmp_path):
    """The stream is stopped and started between its files; a device that falls silent is told besides."""
    import datetime as dt

    start, sent = dt.datetime(2024, 1, 1), []
    for device, periods in (("a", [0.1] * 8 + [0.5] * 4 + [0.1] * 8), ("b", [0.1, 0.1, 0.02, 0.02, 0.02, 0.1, 0.1, 0.1])):
        at = start
        for frame, p in enumerate(periods):
            at += dt.timedelta(seconds=p)
            sent.append((device, frame, at))
            if frame == 5:
                sent += [(device, 5, at + dt.timedelta(milliseconds=1)), (device, 2, at + dt.timedelta(milliseconds=2))]
    kinds = "device string, frame long, ts timestamp"
    df = spark.createDataFrame(sent, kinds)
    want = sorted((r["device"], r["frame"], r["problem"], round(r["rate"], 6) if r["rate"] else None) for r in M.problems(df, 10.0, 3, 0.3).collect())
    assert {w[2] for w in want} == {"repeated", "late", "slow", "fast"}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", M.PROVIDER)
    try:
        source, cp, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
        ordered = sorted(sent, key=lambda r: r[2])
        late = (start + dt.timedelta(seconds=300), start + dt.timedelta(seconds=600))
        parts = [ordered[:9], ordered[9:20], ordered[20:], [("c", 0, late[0])], [("c", 1, late[1])]]
        for part in parts:
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(source)
            q = M.monitored(spark.readStream.schema(kinds).parquet(source), 10.0, 3, 0.3, 30.0, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            q.awaitTermination(180)
        got = [tuple(r) for r in spark.read.schema(M.FOUND).parquet(out).collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((d, f, p, round(r, 6) if r else None) for d, f, _, p, r in got if p != "stalled") == want
    assert {(d, f) for d, f, _, p, _ in got if p == "stalled"} >= {("a", 19), ("b", 7)}
