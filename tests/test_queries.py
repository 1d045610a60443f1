"""Each registered query against its SQL counterpart in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import DATA
from framelake.plans import registry

registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 5) + 0.0 if hasattr(v, "__float__") else str(v)


def rows(names: list[str], got: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_annotations_keep_whole_texts(spark):
    given = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = registry.QUERIES["annotation_text_etl"](spark, DATA).collect()
    assert any(len(r["text"]) > 12 for r in got if r["text"])
    assert all(r["text"] == (given[r["conv_id"], r["turn"]] or "")[::-1] for r in got if r["text"] is not None)


def test_every_query_names_what_it_covers():
    assert all(registry.IDS[n] for n in registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
