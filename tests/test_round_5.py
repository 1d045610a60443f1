"""Findings of round 5: a column that many sets share isn't spread to all pairs of parts."""

from __future__ import annotations

import random

import pyarrow as pa
from framelake.llm import jaccard
from framelake.llm.common import scratch


def test_classes_go_to_no_more_blocks_than_they_have_hot_columns(spark, monkeypatch):
    rng = random.Random(5)
    held = {d: rng.sample(range(40), 6) for d in range(150)}
    size = {s: sum(s in c for c in held.values()) for s in range(40)}
    entries = spark.createDataFrame([(s, d, size[s]) for d, c in held.items() for s in c], "shingle long, d long, k long")
    home = {d: max(c, key=lambda s: (size[s], s)) for d, c in held.items()}
    members = {h: list(home.values()).count(h) for h in home.values()}
    rows = [(d, 100, home[d], 1, 0, members[home[d]], 0, c) for d, c in held.items()]
    homes = spark.createDataFrame(rows, "d long, n int, home long, parts int, part int, members long, last int, columns array<long>")
    blocks_of = []

    def tried(blocks, homes):
        blocks_of.append({(r.i, r.j, r.side, r.d) for r in blocks.collect()})
        return spark.createDataFrame([], "i long, j long, side int, own boolean, d long")

    monkeypatch.setattr(jaccard, "_candidates", tried)
    with scratch(spark):
        jaccard._hot_links(entries, homes, lambda needed: spark.createDataFrame([], "d long, s binary"))
    last = blocks_of[-1]
    assert len(last) <= 150 * 6
    # any two classes that share a column meet
    together = {}
    for i, j, _, d in last:
        together.setdefault((i, j), set()).add(d)
    assert all(any({a, b} <= g for g in together.values()) for a in held for b in held if a < b and set(held[a]) & set(held[b]))


def test_workers_keep_no_word_hashes_after_a_task(spark):
    def kept(batches):
        batches = list(batches)
        for _ in jaccard._forgetful(jaccard._survey)(iter(batches)):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(jaccard._memo)], pa.int64())], ["n"])

    docs = spark.createDataFrame([(k, f"one two three four five six {k}") for k in range(9)], "doc_id long, text string").coalesce(1)
    assert [r.n for r in docs.mapInArrow(kept, "n long").collect()] == [0]
