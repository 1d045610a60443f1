"""Documents without a schema walked to any depth, and changes deep inside a schema, against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from framelake.functions import nested as N
from framelake.functions import variants as V
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents() -> list:
    rnd = random.Random(7)

    def some(depth: int):
        kind = rnd.random()
        if depth == 0 or kind < 0.25:
            return rnd.choice(["SUCCESS", "WARNING", "FAILED", 1, 2.5, None, True, "", "{[", "é"])
        if kind < 0.6:
            return [some(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {rnd.choice(["status", "a", "b", "c.d", "état"]): some(depth - 1) for _ in range(rnd.randint(0, 4))}

    chain: object = {"status": "SUCCESS"}
    for k in range(60):
        chain = [chain] if k % 2 else {"x": chain, "status": "WARNING" if k % 3 else "SUCCESS"}
    return [some(5) for _ in range(150)] + [chain, {}, [], {"status": {"status": "FAILED"}}, {"status": None}, {"status": []}, "plain", 3]


def statuses(x: object) -> list[object]:
    if isinstance(x, dict):
        return [v for k, v in x.items() if k == "status"] + [s for k, v in x.items() if k != "status" for s in statuses(v)]
    return [s for v in x for s in statuses(v)] if isinstance(x, list) else []


def leaves(x: object, path: tuple = ()) -> list[tuple[str, object]]:
    inside = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
    return [(".".join(path), x)] if inside is None else [leaf for k, v in inside for leaf in leaves(v, (*path, str(k)))]


def text(x: object) -> str | None:
    return x if isinstance(x, str) else None if x is None else json.dumps(x)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, json.dumps(x)) for k, x in enumerate(documents())] + [(1000, "{"), (1001, None)]
    return spark.createDataFrame(rows, "k int, j string").withColumn("v", F.try_parse_json("j")).cache()


def test_statuses_at_every_depth(docs):
    got = docs.select("k", V.nested_values("v", "status").alias("s"), V.all_among("v", "status", ["SUCCESS", "WARNING"]).alias("ok")).collect()
    by = {r["k"]: r for r in got}
    for k, x in enumerate(documents()):
        want = statuses(x)
        assert len(by[k]["s"]) == len(want)
        assert sorted(s for s in by[k]["s"] if s in ("SUCCESS", "WARNING", "FAILED")) == sorted(s for s in want if s in ("SUCCESS", "WARNING", "FAILED"))
        assert by[k]["ok"] == (bool(want) and all(s in ("SUCCESS", "WARNING") for s in want)), x
    assert by[1000]["s"] is None and by[1001]["s"] is None and not by[1000]["ok"]
    assert any(len(r["s"] or ()) > 25 for r in got)


def test_leaves_of_documents(docs):
    got: dict = {}
    for r in V.flattened(docs, ["k"], "v").collect():
        got.setdefault(r["k"], []).append((r["path"], r["value"]))
    for k, x in enumerate(documents()):
        want = sorted((p, text(v)) for p, v in leaves(x))
        assert sorted(got.get(k, []), key=str) == sorted(want, key=str), x
    assert not {1000, 1001} & set(got)


def test_feature_status(spark):
    rows = [(None,), ('{"version": "2"}',), ('{"version": "1"}',), ('{"version": "1", "status": "FAILED"}',), ('{"version": "1", "a": [{"status": "WARNING"}]}',), ('{"status": "SUCCESS"}',), ('{"version": 1}',)]
    df = spark.createDataFrame(rows, "j string").withColumn("v", F.try_parse_json("j"))
    got = [r[0] for r in df.select(V.feature_status("v", "version", "1", ["SUCCESS", "WARNING"])).collect()]
    assert got == ["MISSING", "VERSION_MISMATCH", "OK", "FAILED", "OK", "VERSION_MISMATCH", "OK"]


DEEP = "a double, s struct<x:double,y:array<struct<z:double,t:string>>>, m map<string,array<double>>, n array<array<double>>"


@pytest.fixture(scope="module")
def deep(spark):
    rows = [(1.0, (2.0, [(3.0, "A"), (None, None), None]), {"k": [4.0, None], "l": None}, [[1.0, 2.0], [3.0, 4.0]]), (None, None, None, None), (0.5, (None, None), {}, [])]
    return spark.createDataFrame(rows, DEEP)


def test_changes_reach_every_depth(deep):
    got = [r.asDict(recursive=True) for r in N.deep_mapped(deep, T.DoubleType, lambda c: c * 10).collect()]
    assert got[0] == {"a": 10.0, "s": {"x": 20.0, "y": [{"z": 30.0, "t": "A"}, {"z": None, "t": None}, None]}, "m": {"k": [40.0, None], "l": None}, "n": [[10.0, 20.0], [30.0, 40.0]]}
    assert got[1] == {"a": None, "s": None, "m": None, "n": None}
    assert got[2] == {"a": 5.0, "s": {"x": None, "y": None}, "m": {}, "n": []}
    cast = N.deep_cast(deep, T.DoubleType, T.IntegerType())
    assert cast.schema.simpleString() == deep.schema.simpleString().replace("double", "int")
    assert cast.first()["s"]["y"][0]["z"] == 3


def test_shapes_and_time_steps(deep):
    kind = deep.schema["n"].dataType
    assert [r[0] for r in deep.select(N.shape(F.col("n"), kind)).collect()] == [[2, 2], None, [0]]
    ragged = deep.filter("a = 1.0").withColumn("n", F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    assert ragged.select(N.shape(F.col("n"), kind)).first()[0] is None
    one = deep.filter("a = 1.0")
    assert one.select(N.expect_size(F.col("n"), kind, -1, 2).alias("n")).first()["n"] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(Exception, match="size 3 expected along dimension 1"):
        one.select(N.expect_size(F.col("n"), kind, 1, 3)).collect()
    assert one.select(N.over_time(F.col("n"), lambda x: F.array_max(x))).first()[0] == [2.0, 4.0]
