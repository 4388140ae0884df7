"""State of conversations and turns over a stream, kept by Spark for each key: values, maps, times to live and timers.

`focus_stream` carries a conversation's law and article from turn to turn. A turn that comes after all that are known costs one value; one
that comes late makes the later turns' rows again, so the last version of every row is that of the batch window, in whatever order the
files arrive. Of a turn the state has the law and article it names and never its text; a conversation that is silent for TTL is forgotten.

`timeout_stream` gives each turn TIMEOUT from its first event. A timer ends it with STREAM_TIMEOUT unless done or error came first.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.streaming.turns import shared_dir

#: Milliseconds: of a turn; of a silent conversation's state.
TIMEOUT_MS, TTL_MS = 300_000, 30 * 24 * 3600 * 1000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FOCUS_SCHEMA = "conv_id long, turn long, role string, law string, article string, user_article string"
_MENTION = "own_law string, own_article string"
_CARRIED = "turn long, role string, law string, article string, user_article string"


@contextlib.contextmanager
def _settings(spark: SparkSession, **more: str) -> Iterator[None]:
    """Maps, timers and times to live need the state store on disk. The session's own settings come back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER} | {f"spark.sql.streaming.{k.replace('_', '.')}": v for k, v in more.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _after(carried: tuple, role: str, law: str | None, article: str | None) -> tuple:
    """What a conversation is about once a turn has been said."""
    return (law or carried[0], article or carried[1], article if role == "user" else carried[2])


class Focus(StatefulProcessor):
    """Of each conversation: the turns and what they name, and what is carried after the last of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "turn long, role string", _MENTION, TTL_MS)
        self.last = handle.getValueState("last", _CARRIED, TTL_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for batch in rows:
            for turn, role, law, article in zip(batch["turn"], batch["role"], batch["own_law"], batch["own_article"], strict=True):
                new[int(turn), role] = (law if isinstance(law, str) else None, article if isinstance(article, str) else None)
        first, carried, walk = min(new), (None, None, None), sorted(new.items())
        last = self.last.get() if self.last.exists() else None
        if last is not None and (last[0], last[1]) < first:
            carried = tuple(last[2:])  # in order: nothing that was given out changes
        elif last is not None:
            known = {(int(k[0]), k[1]): tuple(v) for k, v in self.said.iterator()} | new
            walk = []
            for at, own in sorted(known.items()):
                if at >= first:
                    walk.append((at, own))
                else:
                    carried = _after(carried, at[1], *own)
        out = []
        for at, own in walk:
            out.append((key[0], *at, *carried))
            carried = _after(carried, at[1], *own)
        for at, own in new.items():
            self.said.updateValue(at, own)
        self.last.update((*walk[-1][0], *carried))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOCUS_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


class Deadline(StatefulProcessor):
    """A turn's timer: set by its first event, taken back by its end."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "events long, due long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events, due, over = self.seen.get() or (0, None, False)
        for batch in rows:
            events += len(batch)
            over = over or bool(batch["event"].isin(["done", "error"]).any())
        if over and due is not None:
            self.handle.deleteTimer(due)
            due = None
        elif not over and due is None and events:
            due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(due)
        self.seen.update((events, due, over))
        yield from ()  # no frame at all: one for each turn would be most of the work

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, _, over = self.seen.get() if self.seen.exists() else (0, None, True)
        self.seen.update((events, None, True))  # what comes now is too late
        yield pd.DataFrame({"turn_id": [] if over else [key[0]], "events": [] if over else [events], "event": [] if over else ["STREAM_TIMEOUT"]})

    def close(self) -> None:
        pass


def focus_stream(turns: DataFrame, out: str) -> DataFrame:
    """Runs a stream of turns (conv_id, turn, role, own_law, own_article) to the end of what is there, and gives out its rows so far: of
    each turn what was in focus before it. A call with the same folder goes on where the last one stopped."""
    spark = turns.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/lot={number}")  # a batch that is run again writes the same folder

    with _settings(spark, noDataMicroBatches_enabled="false"):  # else a stream that keeps processing time never says that it is done
        rows = turns.groupBy("conv_id").transformWithStateInPandas(Focus(), FOCUS_SCHEMA, "Update", "ProcessingTime")
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(FOCUS_SCHEMA + ", lot int").parquet(f"{out}/rows")
    rest = F.struct("law", "article", "user_article")
    return made.groupBy("conv_id", "turn", "role").agg(F.max_by(rest, "lot").alias("last")).select("conv_id", "turn", "role", "last.*")


def timeout_stream(events: DataFrame, out: str, timeout_ms: int = TIMEOUT_MS, patience_s: int = 120) -> DataFrame:
    """(turn_id, events, event) of the turns whose timer ran out, from a stream of (turn_id, event). It runs until a batch has begun after
    the last event's deadline and ended, so every timer of what is there has had its chance. A batch may take as long as it needs;
    patience_s bounds only how long the stream may stand idle beyond a turn's time, which is an error: no part is given out for the whole."""
    spark = events.sparkSession
    with _settings(spark):
        timed = events.select("turn_id", "event").groupBy("turn_id").transformWithStateInPandas(Deadline(timeout_ms), "turn_id long, events long, event string", "Append", "ProcessingTime")
        run = timed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(processingTime="500 milliseconds").start()
        try:
            lively, due, batch = time.time(), None, None
            while True:  # batches without rows go on for ever, for the timers
                last = run.lastProgress
                if due is None and last and last["numInputRows"] == 0:
                    due = time.time() + timeout_ms / 1000
                if due is not None and _began(last) > due:
                    break
                if run.exception() is not None:
                    raise run.exception()
                if run.status["isTriggerActive"] or (last and last["batchId"] != batch):
                    lively, batch = time.time(), last and last["batchId"]
                if time.time() > lively + timeout_ms / 1000 + patience_s:
                    raise TimeoutError(f"no batch for {patience_s} seconds beyond the turns' time")
                time.sleep(0.2)
        finally:
            run.stop()
    return spark.read.schema("turn_id long, events long, event string").parquet(f"{out}/rows")


def _began(progress) -> float:
    return datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
