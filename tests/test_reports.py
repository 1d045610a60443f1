"""Key names, substitutes, table lines and files of scores and timings on odd input."""

from __future__ import annotations

import json
import math

from framelake.operators import reports as R
from pyspark.sql import functions as F


def test_keys(spark):
    df = spark.createDataFrame([("images.front_1",), ("pose",), ("_1",), ("x_1_1",), (None,)], "k string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(R.key_triple(F.col("k"))).collect()]
    assert got == [("images.front_1", "images.front_t", "images.front_T"), ("pose_1", "pose_t", "pose_T"), ("_1", "_t", "_T"), ("x_1_1", "x_1_t", "x_1_T"), (None, None, None)]


def test_substitutes_are_good_rows_of_the_group(spark):
    rows = [("a", k, k % 3 == 0) for k in range(60)] + [("b", 100, True), ("b", 101, True), ("c", 200, True), ("c", 201, False), (None, 300, True), (None, 301, False), ("d", 400, False)]
    df = spark.createDataFrame(rows, "g string, k int, bad boolean")
    got = {r["k"]: (r["g"], r["other"]) for r in R.fallbacks(df, "g", "k", F.col("bad")).collect()}
    assert set(got) == {k for _, k, bad in rows if bad}
    good = {k for _, k, bad in rows if not bad}
    assert all(o in good and o < 60 for k, (g, o) in got.items() if g == "a")
    assert len({o for g, o in got.values() if g == "a"}) > 5
    assert got[100][1] is None and got[101][1] is None and got[200][1] == 201 and got[300][1] == 301
    again = {r["k"]: (r["g"], r["other"]) for r in R.fallbacks(df.repartition(5), "g", "k", F.col("bad")).collect()}
    assert again == got


def test_table_lines(spark):
    df = spark.createDataFrame([("pick_up", 0.5, 0.25), ("tie", 0.5, 0.5), ("none", None, 0.1), ("both", None, None)], "n string, a double, b double")
    got = {r["n"]: r["line"] for r in R.table_rows(df, "n", "a", "b").collect()}
    assert got == {"pick_up": r"pick up & \textbf{50.0} & 25.0 \\", "tie": r"tie & \textbf{50.0} & \textbf{50.0} \\", "none": r"none & -- & \textbf{10.0} \\", "both": r"both & -- & -- \\"}


def test_scores_and_timings_in_files(spark, tmp_path):
    rows = [("t", "a", 1.0), ("t", "b", math.nan), ("t", "c", 3.0), ("u", "d", math.inf), ("u", "e", None)]
    R.save_scores(spark.createDataFrame(rows, "task string, e string, s double"), "task", "e", "s", str(tmp_path / "s"))
    scores, stats = R.load_scores(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, scores.collect()), key=str) == [("t", "a", 1.0), ("t", "b", None), ("t", "c", 3.0), ("u", "d", None), ("u", "e", None)]
    assert sorted(map(tuple, stats.collect())) == [("t", 3, 2.0, 1.0, 2.0, 1.0, 3.0), ("u", 2, None, None, None, None, None)]
    lines = [json.loads(x) for p in (tmp_path / "s/scores_by_task").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["task"]: x["scores"] for x in lines}["u"] == {"d": None, "e": None}
    timings = spark.createDataFrame([("k,1", "p", None, 3, 0.5)], R.TIMINGS)
    R.append_timings(timings, str(tmp_path / "t"))
    R.append_timings(timings.withColumn("extra", F.lit(1)), str(tmp_path / "t"))
    assert [tuple(r) for r in R.read_timings(spark, str(tmp_path / "t")).collect()] == [("k,1", "p", None, 3, 0.5)] * 2


def test_the_library_works_without_the_training_data_operators(monkeypatch):
    """A subpackage that is there but can't be imported leaves all other queries as they are."""
    import sys

    import __spark_entry__ as entry
    from framelake.plans import registry

    entry._llm.cache_clear()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        assert set(entry.queries()) == set(registry.QUERIES) and entry.oracle_sql() == registry.ORACLES
    finally:
        entry._llm.cache_clear()


def test_substitutes_go_on_behind_the_last_block(spark):
    """One good row for thousands that failed is in few blocks of the hash; the order is that of a plain loop."""
    import hashlib

    rows = [(k % 3, k, k % 500 != 7) for k in range(6000)]
    df = spark.createDataFrame(rows, "g int, k int, bad boolean")
    found = R.fallbacks(df, "g", "k", F.col("bad"))
    want = {}
    for g in range(3):
        own = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k, bad) for a, k, bad in rows if a == g)
        first = after = next((k for _, k, bad in own if not bad), None)
        for _, k, bad in reversed(own):
            if bad:
                want[k] = after
            else:
                after = k
    assert {r["k"]: r["other"] for r in found.collect()} == want and first is not None
    assert "1, unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # a frame that is read anew for each row
