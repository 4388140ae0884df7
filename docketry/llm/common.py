"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches that a worker is done with go back to the system, not to a pool that keeps them.
pa.set_memory_pool(pa.system_memory_pool())

DEFAULT_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs in one process (tests) our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = DEFAULT_SHARED
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there: the lineage ends, and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared folder that isn't there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (other columns stay unread); a null text is empty, and a row without doc_id is no document."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, and of about `size` bytes, so that long texts don't add up in a worker."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and _bytes(batch, at, n) > size:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def _bytes(batch: pa.RecordBatch, at: int, n: int) -> int:
    return sum(column.slice(at, n).nbytes for column in batch.columns)


#: A node with more than one in HUBS of an edge list's rows is a hub; so there are at most HUBS of them.
HUBS = 1000
#: Rows of an edge list that one task takes at least: a small list isn't spread over many tasks, each with files of its own.
TASK_ROWS = 50_000


def _with_minimum(rows: DataFrame, low: DataFrame, least: int, tasks: int) -> DataFrame:
    """rows (u, v) with m of low (u, m, n). A hub's rows, spread as they are, are joined with the broadcast minima of the hubs
    (those with `least` rows or more, which bounds their number); only the rest is dealt by u."""
    hubs = F.broadcast(low.where(F.col("n") >= least).select("u", F.col("m").alias("of_hub")))
    marked = rows.join(hubs, "u", "left")
    rest = marked.where("of_hub is null").select("u", "v").join(low.where(F.col("n") < least).select("u", "m"), "u").coalesce(tasks)
    return marked.where("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs, as (node, root): root is the smallest node reachable.

    Alternating large-star and small-star steps: each is a minimum per node (combined before the shuffle), joined back so that
    no hub lands in one task. Every round is cut by a checkpoint in the shared folder. Nodes without an edge don't appear.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = saved(now), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before, least, tasks = state, max(32, 2 * state["n"] // HUBS), max(8, state["n"] // TASK_ROWS)
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).coalesce(tasks)
        large = _with_minimum(both, low, least, tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(tasks)
        small = _with_minimum(large, low, least, tasks).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = saved(small.where("u <> v").distinct().coalesce(tasks))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
