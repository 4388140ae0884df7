"""Row-level security in SQL: who asks is a session variable, policies are views over it, and writes are checked against them.

An office has a session of its own (views, variables and functions of other sessions aren't touched). `auth_user_id()` and
`auth_office_id()` are SQL functions of the session's variables; every policed table is a view with its policy as predicate, which the
optimizer folds to a constant and hands to the scan. Rows for an insert or an update go through WITH CHECK: one row of another office
fails the whole statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Policies:
    """The tables (name -> Parquet path) as one caller sees them. policies: table -> SQL predicate over its columns and the two functions."""

    def __init__(self, spark: SparkSession, tables: dict[str, str], policies: dict[str, str], user: int | None, office: int | None) -> None:
        self.spark, self.policies, self.names = spark.newSession(), policies, set(tables)
        for name, value in (("caller", user), ("caller_office", office)):
            self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} BIGINT DEFAULT NULL")
            self.spark.sql(f"SET VARIABLE {name} = CAST(:value AS BIGINT)", {"value": value})
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION auth_user_id() RETURNS BIGINT RETURN session.caller")
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION auth_office_id() RETURNS BIGINT RETURN session.caller_office")
        for name, path in tables.items():
            self.spark.read.parquet(path).createOrReplaceTempView(f"all_{name}")
        for name in tables:
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM all_{name} WHERE {policies.get(name, 'FALSE')}")

    def select(self, sql: str) -> DataFrame:
        """Any query over the policed tables; a table without a policy has no rows."""
        return self.spark.sql(sql)

    def checked(self, name: str, rows: DataFrame) -> DataFrame:
        """WITH CHECK: the rows, or an error if one isn't the caller's."""
        allowed = F.coalesce(F.expr(self.policies.get(name, "FALSE")), F.lit(False))
        return rows.where(F.when(allowed, F.lit(True)).otherwise(F.raise_error(F.lit(f"new row violates the policy of {name}")).cast("boolean")))  # a predicate, which no projection prunes

    def insert(self, name: str, rows: str) -> DataFrame:
        """The table with new rows: a query that gives its columns in order."""
        rows_before = self.spark.table(f"all_{name}")
        new = self.spark.sql(rows).toDF(*rows_before.columns)
        return rows_before.unionByName(self.checked(name, new.select(*(F.col(f.name).cast(f.dataType) for f in rows_before.schema))))

    def update(self, name: str, changes: dict[str, str], where: str) -> DataFrame:
        """The table with the caller's rows changed where `where` holds; a change mustn't move a row out of the policy."""
        rows, seen = self.spark.table(f"all_{name}"), f"coalesce(({self.policies.get(name, 'FALSE')}) AND ({where}), FALSE)"
        old, rest = rows.where(seen), rows.where(f"NOT {seen}")
        return rest.unionByName(self.checked(name, old.withColumns({c: F.expr(e).cast(rows.schema[c].dataType) for c, e in changes.items()})))

    def delete(self, name: str, where: str) -> DataFrame:
        """The table without the caller's rows for which `where` holds."""
        return self.spark.table(f"all_{name}").where(f"NOT coalesce(({self.policies.get(name, 'FALSE')}) AND ({where}), FALSE)")
