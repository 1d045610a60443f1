"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, decontaminate, jaccard, langid, substrings
from framelake.llm.common import delete, maybe_in, scratch, shared_dir, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter. Where nothing could be learned, because no
    row names its language, a text with letters stays. A document without lang gets the language predicted for it."""
    model = langid.train(docs)
    p = langid.predict(F.col("text"), model)
    found = docs.select(*COLUMNS, p.alias("_lid")).filter((F.col("_lid.lang_pred") != "und") | F.col("text").rlike("\\p{L}"))
    return found.withColumn("lang", F.coalesce("lang", F.nullif("_lid.lang_pred", F.lit("und")))).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, the one with the smallest doc_id, nulls last; a row that repeats is
    kept once. Rows are told apart by doc_id and text, so rows with one doc_id or none are separate documents."""
    keyed = docs.select(*COLUMNS, substrings.row_key().alias("_row"))
    with scratch(spark):
        groups = jaccard.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("root"))
        large = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
        members = written(groups.join(large, "root", "left_semi").distinct())
        # texts are read where a row may be a member; all other rows aren't shuffled
        ids = keyed.select("_row", "doc_id").filter(maybe_in(members, "_row")(F.col("_row"))).distinct().join(members, "_row")
        first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select("m._row", F.lit(True).alias("_first"))
        members = written(members.select("_row").join(first, "_row", "left"), keep=True)
    may = keyed.withColumn("_may", maybe_in(members, "_row")(F.col("_row")))
    kept = may.filter("_may").join(members.withColumn("_member", F.lit(True)), "_row", "left").filter("_member IS NULL OR _first")
    return may.filter("NOT _may").select(*COLUMNS).unionByName(kept.dropDuplicates(["_row"]).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of all documents but the first that holds them; every document stays."""
    return substrings.deduplicate(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half the words of a benchmark item or more."""
    hits = decontaminate.contamination(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.select(*COLUMNS, hits.alias("_hits")).filter("size(_hits) = 0").select(*COLUMNS)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and what they decode to. Workers keep fewer words and encode fewer texts at once than in
    operator 4's own query: executors come to this stage with the memory of the stages before."""
    return docs.select(*COLUMNS, bpe.digests(F.col("text"), bpe.vocabulary, words=30_000, group=250_000).alias("_p")).select(*COLUMNS, "_p.*")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: Learned models and the tokenizer can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. The tables of a stage go when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)
        before = [path]
        docs = spark.read.parquet(path)
    return docs
