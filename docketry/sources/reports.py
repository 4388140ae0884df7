"""Reports as JSON lines that are only appended to, and registries as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Each row a line; what is there stays."""
    rows.write.mode("append").json(path)


def latest(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Of each key the last line, by `order`; lines that can't be read don't count."""
    rows = spark.read.schema(schema).json(path).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def todo(wanted: DataFrame, done: DataFrame, key: str, again: str = "ERROR") -> DataFrame:
    """What has no line yet, or whose last one says `again`."""
    return wanted.join(done.where(F.col("status") != again).select(key), key, "left_anti")


def registry(spark: SparkSession, path: str, one: bool = True) -> DataFrame:
    """(abolished, abolishing, kind) of a JSON document of relations (or of one a line); what can't be read has none."""
    fields = "abolished string, abolishing string, kind string"
    return spark.read.schema(f"relations array<struct<{fields.replace(' string', ':string')}>>").json(path, multiLine=one).select(F.explode("relations").alias("r")).select("r.*").where("abolished IS NOT NULL")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, url) of JSON documents (one a line) of laws, numbers as written. Entries without a number are skipped, of a number that a
    document has twice the last entry counts, and a document that can't be read has none."""
    entry = "number string, title string, url string"
    rows = spark.read.schema(f"laws array<struct<{entry.replace(' string', ':string')}>>").json(path)
    each = rows.withColumn("document", F.monotonically_increasing_id()).select("document", F.posexplode("laws").alias("at", "law")).select("document", "at", "law.*")
    named = each.where(F.trim(F.coalesce("number", F.lit(""))) != "")
    return named.groupBy("document", "number").agg(F.max_by(F.struct("title", "url"), "at").alias("last")).select("number", "last.*")
