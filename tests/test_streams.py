"""Streams with state: the rows of the batch plans in any order of files, timers, replayed batches."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.plans import dialogue
from docketry.streaming import conversations, ingest, protocol


def spoken(spark):
    rng, rows = random.Random(3), []
    for conv in range(6):
        for turn in range(12):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], rng.choice([None, "04/L-077", "03/L-212"]), rng.choice([None, None, "5", "12"])))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, own_law string, own_article string")


@pytest.mark.parametrize("order", ["turn", "-turn"])
def test_focus_in_any_order(spark, tmp_path, monkeypatch, order):
    """Forwards (only the last value is kept in step) and backwards (later turns are made again) over several micro-batches and two runs."""
    rows = spoken(spark).cache()
    want = {(r.conv_id, r.turn): (r.law, r.article, r.user_article) for r in window(rows).collect()}
    for part in range(4):
        lot = (11 - F.col("turn")) if order == "-turn" else F.col("turn")
        rows.where(F.floor(lot / 3) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (1, 3):  # the second run goes on from the first one's state
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            got = conversations.focus_stream(stream, f"{tmp_path}/out")
    assert {(r.conv_id, r.turn): (r.law, r.article, r.user_article) for r in got.collect()} == want
    lots = spark.read.parquet(f"{tmp_path}/out/rows").count()
    assert lots == len(want) if order == "turn" else lots > len(want)


def window(rows):
    monkey = dialogue.named
    try:
        dialogue.named = lambda turns: turns
        return dialogue.focus(rows)
    finally:
        dialogue.named = monkey


def test_timers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "route"), (1, "delta"), (2, "route"), (2, "done"), (3, "delta"), (3, "error"), (4, "delta")], "turn_id long, event string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = conversations.timeout_stream(stream, f"{tmp_path}/out", 9000)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "STREAM_TIMEOUT"), (4, 1, "STREAM_TIMEOUT")]


def test_timers_wait_for_long_batches(spark, tmp_path, monkeypatch):
    """Batches that take longer than all patience are waited for: none of their turns is left out."""
    rows = spark.range(40).selectExpr("id AS turn_id", "CASE WHEN id % 4 = 0 THEN 'done' ELSE 'delta' END AS event")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")

    class Slow(conversations.Deadline):
        def handleInputRows(self, key, rows, timerValues):
            import time

            time.sleep(0.5)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(conversations, "Deadline", Slow)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = conversations.timeout_stream(stream, f"{tmp_path}/out", 200, patience_s=1)
    assert sorted(map(tuple, got.collect())) == [(k, 1, "STREAM_TIMEOUT") for k in range(40) if k % 4]


SCHEMA = "namespace string, k long, v long, at timestamp, body string"


def lots(spark):
    row = "named_struct('namespace', {}, 'k', {}, 'v', {}, 'at', TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {}), 'body', '{}')"
    make = lambda *rows: spark.sql("SELECT inline(array(" + ", ".join(row.format(*r) for r in rows) + "))").select(*(F.col(c).cast(t) for c, t in (f.split() for f in SCHEMA.split(", "))), )
    return [make(("'a'", 1, 1, 1, "x"), ("'a'", 2, 1, 1, "y"), ("'b'", 1, 5, 1, "z")), make(("'a'", 1, 3, 3, "new"), ("NULL", 9, 1, 1, "n"), ("'b'", "NULL", 1, 1, "n")), make(("'a'", 1, 2, 2, "late"), ("'b'", 7, 1, 9, "q"), ("'b'", 7, 1, 9, "q"))]


def held(table):
    return sorted((r.namespace, r.k, r.v, r.body) for r in table.rows().collect())


def test_keyed_table(spark, tmp_path):
    table = ingest.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ("k",), ("v",), 4)
    assert held(table) == [] and [(r.reason, r.n) for r in table.state().collect()] == [("total", 0)]
    for number, lot in enumerate(lots(spark)):
        table.take(lot, number)
    want = [("a", 1, 3, "new"), ("a", 2, 1, "y"), ("b", 1, 5, "z"), ("b", 7, 1, "q")]
    assert held(table) == want
    assert {r.reason: r.n for r in table.state().collect()} == {"completed": 7, "no namespace": 1, "no k": 1, "total": 9}
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    table.take(lots(spark)[0], 0)  # delivered again: skipped
    assert held(table) == want and {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    table.upsert(lots(spark)[0].where("k IS NOT NULL"))  # broken off before the ledger, and run again
    assert held(table) == want
    table.delete_keys(spark.createDataFrame([("a", 2), ("b", 7), ("b", 99)], "namespace string, k long"))
    assert held(table) == [want[0], want[2]]
    table.delete_all("b")
    table.delete_all("never")
    assert held(table) == [want[0]]


def test_keyed_stream_resumes(spark, tmp_path):
    table = ingest.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ("k",), ("v",), 4)
    for lot in lots(spark)[:2]:
        lot.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table.ingest(stream(), late="1 hour")
    table.ingest(stream(), late="1 hour")
    assert {r.reason: r.n for r in table.state().collect()}["total"] == 6
    lots(spark)[2].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table.ingest(stream(), late="1 hour")
    assert {r.reason: r.n for r in table.state().collect()}["total"] == 8  # of a row delivered twice, one
    assert held(table) == [("a", 1, 3, "new"), ("a", 2, 1, "y"), ("b", 1, 5, "z"), ("b", 7, 1, "q")]


def test_protocol_of_any_cut(spark, monkeypatch):
    """Folded in pieces of any size, a turn ends where a loop over its events ends."""
    rng, names = random.Random(9), ["route", "sources", "warnings", "delta", "delta", "delta", "done", "error", "ping", None]
    turns = {k: [rng.choice(names) for _ in range(rng.randrange(1, 40))] for k in range(30)}
    turns |= {100: ["route", "sources", "warnings", *["delta"] * 700, "done"], 101: ["error"], 102: ["route", "delta"], 103: ["route", *["delta"] * 300, "warnings", "done"]}
    rows = [(k, at, e) for k, events in turns.items() for at, e in enumerate(events)]
    table = spark.createDataFrame(rows, "turn_id long, seq long, event string").repartition(3)
    want = {}
    for k, events in turns.items():
        state, wrong = 0, None
        for at, e in enumerate(events):
            if state in protocol._FROM.get(e, ()):
                state = protocol._TO[e]
            elif wrong is None:
                wrong = at
        want[k] = ("wrong" if wrong is not None else "right" if state == 5 else "unfinished", wrong, events[wrong] if wrong is not None else None)
    for fan in (2, 7, 256):
        monkeypatch.setattr(protocol, "FAN", fan)
        assert {r.turn_id: (r.verdict, r.wrong_seq, r.wrong_event) for r in protocol.judged(table).collect()} == want
    assert want[100][0] == "right" and want[103] == ("wrong", 301, "warnings")
