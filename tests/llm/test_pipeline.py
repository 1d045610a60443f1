"""The pipeline against brute-force versions of its stages."""

from __future__ import annotations

import corpus_pipeline as P
import pytest
from conftest import DATA
from framelake.llm import bpe, decontaminate, substrings
from framelake.llm.common import written
from test_operators import duplicates


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], DATA)))
    return out


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == P.COLUMNS for df in stages[1:-1])
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_language_stage_drops_texts_without_letters(spark, stages):
    assert by_id(stages[1]) == {d: t for d, t in by_id(stages[0]).items() if t and any(c.isalpha() for c in t)}
    odd = stages[0].limit(3).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 !", "en", "s", 4)], stages[0].schema))
    assert set(by_id(P.language_id(spark, odd, DATA))) == set(by_id(stages[0].limit(3)))


def test_jaccard_stage_keeps_one_of_each_group(stages):
    texts = [(d, t, None) for d, t in by_id(stages[1]).items()]
    assert set(by_id(stages[2])) == {d for d, _, c in duplicates(texts) if d == c}


def test_jaccard_stage_decides_by_row(spark, stages):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(7, words(1)), (7, words(2)), (8, words(1)), (None, words(3)), (None, words(4)), (None, words(4) + " end"), (9, words(4) + " end"), (10, words(5))]
    kept = [(7, words(1)), (7, words(2)), (None, words(3)), (9, words(4) + " end"), (10, words(5))]
    for more in ([], [(10, words(5))]):  # with and without a row that repeats
        df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows + more], stages[0].schema)
        got = P.jaccard_join(spark, df, DATA).select("doc_id", "text").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(kept, key=repr)


def test_language_stage_without_languages(spark, stages):
    df = spark.createDataFrame([(1, "some plain words", None, "s", 16), (2, "12 !", None, "s", 4), (3, None, None, "s", 0)], stages[0].schema)
    assert set(by_id(P.language_id(spark, df, DATA))) == {1}


def test_substring_stage(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    seen: dict = {}
    for d in sorted(before):
        for u in substrings.split_units(before[d]):
            seen.setdefault(u[3], d)
    for d, t in before.items():
        out, run, at = [], [], 0
        for u in [*substrings.split_units(t), None]:
            if u and (u[4] or seen[u[3]] != d):
                run.append(u)
                continue
            if run and sum(x[2] for x in run) >= substrings.MIN_WORDS:
                out.append(t[at : run[0][0]])
                at = run[-1][1]
            run = []
        assert after[d] == "".join([*out, t[at:]])


def test_decontamination_stage(spark, stages):
    hits = decontaminate.contaminated(stages[3], spark.read.parquet(f"{DATA}/benchmark.parquet"))
    bad = {r["doc_id"] for r in hits.collect()}
    assert bad and set(by_id(stages[4])) == set(by_id(stages[3])) - bad


def test_last_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    for r in stages[5].collect():
        assert r["n_tokens"] == len(t.encode(r["text"], add_special_tokens=False).ids)


def test_run_and_empty(spark, stages, tmp_path):
    stages[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    got = P.run(spark, DATA)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, stages[5].select("doc_id", "ids_sha256").collect()))


def test_every_operator_has_a_query():
    from framelake.llm import queries

    assert {int(n.split("_")[0][2:]) for n in queries.QUERIES} == set(range(1, 14))
