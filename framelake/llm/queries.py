"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, brown, chat, decontaminate, importance, infill, jaccard, langid, licenses, mixing, structure, substrings, vectors
from framelake.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removed ranges, each with the document that keeps the first copy."""
    return substrings.repeats(table(spark, sf_dir, "documents")).drop("row")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{hard}' AS text")
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their log-weights."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.filter("selected").select("doc_id", "log_weight", "key")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, each with the items it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure.digests(structure.damaged(turns), turns)


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_scores": op10_lm_scores,
    "op11_structure_repair": op11_structure_repair,
    "op12_mix_sources": op12_mix_sources,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op3_embedding_near_dedup": vectors.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_structure_repair": structure.ORACLE,
    "op12_mix_sources": mixing.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
