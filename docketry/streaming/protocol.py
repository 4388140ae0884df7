"""The protocol of a turn's events as an automaton whose transitions compose.

route, then sources, warnings and deltas in this order (the first two may be missing, deltas may be many), then done or error; an error may come
at any time before the end. Every event is a map from the state before it to the state after it, and to the first wrong event seen on
the way (a wrong event changes no state). Maps of neighbours compose to a map again, so a turn is folded FAN events at a time, level by
level: no task ever sorts or holds a long turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("start", "route", "sources", "warnings", "delta", "end")
#: Which state each event leads to, and from which states it may.
_TO = {"route": 1, "sources": 2, "warnings": 3, "delta": 4, "done": 5, "error": 5}
_FROM = {"route": {0}, "sources": {1}, "warnings": {1, 2}, "delta": {1, 2, 3, 4}, "done": {1, 2, 3, 4}, "error": {0, 1, 2, 3, 4}}
FAN = 256


def _map(event: Column, seq: Column) -> Column:
    """The event's map: for each state before, (state after, number of the event if it is wrong there). An unknown event is wrong anywhere."""
    out = []
    for state in range(len(STATES)):
        to = F.lit(state)
        right = F.lit(False)
        for name, target in _TO.items():
            if state in _FROM[name]:
                to, right = F.when(event == name, target).otherwise(to), right | (event == name)
        out.append(F.struct(to.cast("int").alias("to"), F.when(F.coalesce(right, F.lit(False)), None).otherwise(seq).cast("long").alias("wrong")))
    return F.array(*out)


def _then(first: Column, second: Column) -> Column:
    """One map after another."""
    return F.transform(first, lambda a: F.struct(F.get(second, a["to"])["to"].alias("to"), F.coalesce(a["wrong"], F.get(second, a["to"])["wrong"]).alias("wrong")))


def folded(events: DataFrame) -> DataFrame:
    """turn_id, map of all its events (turn_id, seq, event); seq is at least 0 and orders a turn's events."""
    rows = events.select("turn_id", F.col("seq").cast("long").alias("k"), _map(F.col("event"), F.col("seq")).alias("map"))
    highest = events.agg(F.max("seq")).first()[0] or 0
    while True:
        group = rows.groupBy("turn_id", F.expr(f"k div {FAN}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "map"))).alias("maps"))  # at most FAN maps
        start = F.expr("transform(maps[0].map, (x, i) -> named_struct('to', i, 'wrong', CAST(NULL AS BIGINT)))")
        rows = group.select("turn_id", "k", F.aggregate("maps", start, lambda acc, x: _then(acc, x["map"])).alias("map"))
        highest //= FAN
        if not highest:
            return rows.select("turn_id", "map")


def judged(events: DataFrame) -> DataFrame:
    """turn_id, verdict (right, unfinished, wrong), and the first wrong event's seq and name."""
    ends = folded(events).select("turn_id", F.get("map", F.lit(0)).alias("end")).select("turn_id", "end.to", "end.wrong")
    named = events.select("turn_id", F.col("seq").cast("long").alias("wrong"), F.col("event").alias("wrong_event"))
    verdict = F.when(F.col("wrong").isNotNull(), "wrong").when(F.col("to") == len(STATES) - 1, "right").otherwise("unfinished")
    return ends.join(named, ["turn_id", "wrong"], "left").select("turn_id", verdict.alias("verdict"), F.col("wrong").alias("wrong_seq"), "wrong_event")
