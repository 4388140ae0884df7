"""Keyed changes to tables that have no MERGE: each returns the table's new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new replaces target's rows of the same keys; the rest stays."""
    return target.join(new.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def insert_ignore(target: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose keys target doesn't have are added."""
    return target.unionByName(new.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def delete_keys(target: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti").select(*target.columns)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest order value: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("first")).select(key, "first.*")


def partial_update(df: DataFrame, patch: dict[str, Column], where: Column) -> DataFrame:
    """Columns of patch are set in the rows that `where` picks; tenant columns can't be patched."""
    return df.select(*(F.when(where, patch[c]).otherwise(F.col(c)).alias(c) if c in patch and c != "office_id" else F.col(c) for c in df.columns))
