"""The corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again.

Language ID and the quality classifier drop the documents they reject, of each class of near-duplicates one document stays,
passages that repeat lose their later copies, and what is left is packed into sequences. Every stage but the last returns the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import language, packing, quality_lines, similar, suffix_dedup
from docketry.llm.common import discard, new_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lines.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("packing", pack_sequences),
]

#: No stage can be told in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
