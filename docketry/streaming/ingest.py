"""Keyed, resumable ingest: a stream of rows into a table that has each key once, however often a batch or a row is delivered.

The table is partitioned by namespace and by a bucket of the key's hash. A micro-batch is reduced to its latest row a key, merged with the rows of
the buckets it touches, and only those are overwritten. A ledger names the batches that are in, so a batch that is run again is skipped, and if
it broke off before the ledger, merging it again changes nothing. Rows that can't be taken are counted by reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a namespace.
BUCKETS = 16


class KeyedTable:
    """A table in a folder: rows(), the state of the ingest, and the changes to it. Keys are unique within a namespace."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.fields = spark.createDataFrame([], schema).schema
        self.schema = schema + ", bucket int"

    def _table(self) -> DataFrame:
        names = [f.name for f in self.fields if f.name != "namespace"]
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select("namespace", *names, "bucket")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema).select("namespace", *names, "bucket")

    def rows(self) -> DataFrame:
        return self._table().select([f.name for f in self.fields])

    def _touched(self, change: DataFrame) -> Column:
        """The partitions of a change: at most namespaces times buckets."""
        parts = {}
        for r in change.select("namespace", "bucket").distinct().collect():
            parts.setdefault(r.namespace, []).append(r.bucket)
        where = F.lit(False)
        for namespace, buckets in parts.items():
            where = where | ((F.col("namespace") == namespace) & F.col("bucket").isin(buckets))
        return where

    def _overwrite(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "bucket").parquet(f"{self.path}/rows")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        by = ["namespace", "bucket", *self.keys]
        rest = [c for c in rows.columns if c not in by]
        return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("last")).select(*by, "last.*").select(*rows.columns)

    def upsert(self, rows: DataFrame) -> None:
        """The rows' keys get their latest row, of those in the table and the new ones."""
        new = self._latest(self._bucketed(rows.select([f.name for f in self.fields])).select(self._table().columns))
        self._overwrite(self._latest(self._table().where(self._touched(new)).unionByName(new)))

    def delete_keys(self, gone: DataFrame) -> None:
        """Rows whose namespace and keys are in `gone` go; buckets without one aren't opened."""
        gone = self._bucketed(gone.select("namespace", *self.keys).distinct())
        touched = self._table().where(self._touched(gone))
        left = touched.join(gone, ["namespace", "bucket", *self.keys], "left_anti").select(touched.columns)
        kept = left.checkpoint()  # read before what it is read from is overwritten
        emptied = gone.select("namespace", "bucket").distinct().join(kept.select("namespace", "bucket").distinct(), ["namespace", "bucket"], "left_anti").collect()
        self._overwrite(kept)
        for r in emptied:
            self._drop(f"namespace={r.namespace}/bucket={r.bucket}")

    def delete_all(self, namespace: str) -> None:
        """A namespace is a partition: its folder is dropped, nothing is read."""
        self._drop(f"namespace={namespace}")

    def _drop(self, part: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{part}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _ledger(self) -> DataFrame:
        fields = "batch long, reason string, n long"
        try:
            return self.spark.read.schema(fields).json(f"{self.path}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], fields)

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; of a number that is in the ledger, nothing."""
        if self._ledger().where(F.col("batch") == number).limit(1).count():
            return
        batch = batch.persist()
        try:
            reason = F.when(F.col("namespace").isNull(), "no namespace")
            for k in self.keys:
                reason = reason.when(F.col(k).isNull(), f"no {k}")
            judged = batch.withColumn("reason", reason.otherwise("completed"))
            self.upsert(judged.where("reason = 'completed'"))
            counts = judged.groupBy("reason").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number))
            nothing = self.spark.createDataFrame([(number, "completed", 0)], "batch long, reason string, n long")  # a batch without rows is in as well
            counts.select("batch", "reason", "n").unionByName(nothing).coalesce(1).write.mode("append").json(f"{self.path}/ledger")
        finally:
            batch.unpersist()

    def state(self) -> DataFrame:
        """reason (completed, or why rows were skipped), n; and the total."""
        counts = self._ledger().groupBy("reason").agg(F.sum("n").alias("n"))
        return counts.unionByName(counts.agg(F.lit("total").alias("reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))

    def ingest(self, stream: DataFrame, late: str | None = None) -> None:
        """All that a stream has; a second call goes on where the first stopped. With `late`, rows delivered again (same namespace, keys and
        order) within that much of the column `at` are dropped before they reach the table."""
        if late:
            stream = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["namespace", *self.keys, *self.order])
        stream.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.take).trigger(availableNow=True).start().awaitTermination()
