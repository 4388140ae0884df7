"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import chat_roles, fill_middle, language, lexical_search, media_sniff, mixing, packing, piece_bpe, quality_lines, quality_rules, repair_store, simhash, suffix_dedup
from docketry.llm.common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_store.token_store_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"))


def op4_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_roles.format_conversations(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op9_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.digests(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_simhash, op3_piece_bpe, op4_chat_roles, op5_quality_rules, op6_quality_lines, op7_language, op8_suffix_dedup, op9_media_sniff, op10_packing, op11_mixing, op12_lexical_search, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op12_lexical_search": lexical_search.SQL, "op13_fill_middle": fill_middle.SQL}
