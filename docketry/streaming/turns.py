"""Event streams: the same plans over batch rows and over a file stream, with state kept by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_dir(spark: SparkSession) -> str:
    """Where checkpoints of streams go: the folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (where or "/tmp/checkpoints").rstrip("/")


def concat_deltas(events: DataFrame) -> DataFrame:
    """(turn_id, text): the deltas of each turn joined in order."""
    return events.where(F.col("event") == "delta").groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "").alias("text"))


def incremental(spark: SparkSession, source: str, schema, build, out: str) -> DataFrame:
    """Process what is new in a folder of Parquet files, once, and return all that has been written so far.

    The stream's checkpoint beside the output remembers the files that are done: a second call reads only new ones.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    run = build(rows).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def hourly_counts(spark: SparkSession, source: str, schema, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type from a stream with a watermark: each batch gives out the hours it changed, and of an hour's rows the
    latest batch's counts. State is kept only for hours that the watermark hasn't passed."""
    out = f"{shared_dir(spark)}/hourly-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    counts = rows.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("hour"), "event_type", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/rows/lot={number}")

    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))


TIMEOUT_MS = 300_000


def _quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Remember a key's last event; when the watermark is TIMEOUT_MS past it, the key has timed out."""
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "last_ms": [last], "event": ["STREAM_TIMEOUT"]})
        return
    seen = sorted([*(int(x) for b in batches for x in b["ms"]), *(state.get if state.exists else ())])
    quiet = [a for a, b in zip(seen, seen[1:], strict=False) if b - a > TIMEOUT_MS]
    if quiet:
        yield pd.DataFrame({"user_id": [key[0]] * len(quiet), "last_ms": quiet, "event": ["STREAM_TIMEOUT"] * len(quiet)})
    state.update((seen[-1],))
    state.setTimeoutTimestamp(max(seen[-1] + TIMEOUT_MS, state.getCurrentWatermarkMs() + 1))


def timeouts(spark: SparkSession, source: str, schema) -> DataFrame:
    """(user_id, last_ms, event) of every silence of over TIMEOUT_MS, from a stream with a timer for each user; whoever is silent when
    the stream ends is closed with it."""
    out = f"{shared_dir(spark)}/timeouts-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")
    timed = rows.select("user_id", "at", F.unix_millis("at").alias("ms")).groupBy("user_id").applyInPandasWithState(_quiet, "user_id long, last_ms long, event string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    run = timed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema("user_id long, last_ms long, event string").parquet(f"{out}/rows").distinct()
    last = spark.read.schema(schema).parquet(source).groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"))
    return found.unionByName(last.join(found, ["user_id", "last_ms"], "left_anti").withColumn("event", F.lit("STREAM_TIMEOUT")))
