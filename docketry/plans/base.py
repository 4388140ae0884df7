"""Registration of queries beside the SQL that checks them, and the input tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.functions.text import FOLDED_STOPWORDS, TOKEN

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one input folder as DataFrames: t.orders, t.documents, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def made(self, rows: str) -> DataFrame:
        """Rows that SQL, read by both engines alike, makes of the tables of this folder: (SELECT ... FROM documents) AS t."""
        names = sorted(set(re.findall(rf"\b(?:FROM|JOIN) ({'|'.join(TABLES)})\b", rows)))
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", rows.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(f"SELECT * FROM {text}", **{name: getattr(self, name) for name in names})


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of Tables under its own name (or another), with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in FOLDED_STOPWORDS)


def tokens_sql(c: str) -> str:
    """The tokens of a text, in SQL."""
    return f"list_filter(list_transform(regexp_extract_all(lower({c}), '{TOKEN}'), lambda x: translate(x, 'ëç', 'ec')), lambda x: (length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')) AND NOT list_contains([{_STOP}], x))"
