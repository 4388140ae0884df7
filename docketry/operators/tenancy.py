"""Row-level isolation by office: every read of a tenant's table goes through a view that has the office's predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TenantView:
    """A table as one office sees it. The predicate is part of the plan, so it is pushed down to the scan."""

    def __init__(self, df: DataFrame, office: int, column: str = "office_id") -> None:
        self.df, self.office, self.column = df, office, column

    def rows(self, *predicates: Column) -> DataFrame:
        out = self.df.where(F.col(self.column) == F.lit(self.office))
        for p in predicates:
            out = out.where(p)
        return out

    def stamp(self, new: DataFrame) -> DataFrame:
        """New rows get the office where they have none."""
        return new.withColumn(self.column, F.coalesce(F.col(self.column), F.lit(self.office)))


def leaked(df: DataFrame, office: int, column: str = "office_id") -> DataFrame:
    """Rows of another office: there should be none behind a TenantView."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != office))
