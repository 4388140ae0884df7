"""Event protocol, delta accumulation, incremental ingest and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.plans import dialogue
from docketry.plans.base import Tables, query
from docketry.streaming import conversations as V
from docketry.streaming import ingest as I
from docketry.streaming import protocol as P
from docketry.streaming import turns as S

# What the events of a turn say, made from the events table: each user is a turn.
_EVENTS_OF = """SELECT user_id AS turn_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AND user_id % 3 <> 0 THEN 'route' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND user_id % 2 = 0 THEN 'done' WHEN event_type = 'error' THEN 'error' ELSE 'delta' END AS event, substr(event_type, 1, 2) AS payload FROM events"""


def _turns(t: Tables) -> DataFrame:
    return t.spark.sql(_EVENTS_OF.replace("FROM events", "FROM {events}"), events=t.events)


@query(f"SELECT turn_id, min_by(event, seq) = 'route' AS starts_right, bool_or(event IN ('done', 'error')) AS ended, coalesce(bool_and(event = 'delta' OR event IN ('done', 'error') AND seq = last OR event = 'route' AND seq = first), FALSE) AS in_order FROM (SELECT *, min(seq) OVER (PARTITION BY turn_id) AS first, max(seq) OVER (PARTITION BY turn_id) AS last FROM ({_EVENTS_OF}) e) x GROUP BY turn_id")
def event_protocol(t: Tables) -> DataFrame:
    """Whether a turn's events begin with the route, end, and hold nothing but deltas between."""
    events, ends = _turns(t), F.col("event").isin("done", "error")
    turns = events.groupBy("turn_id").agg(
        (F.min_by("event", "seq") == "route").alias("starts_right"),
        F.bool_or(ends).alias("ended"),
        F.count_if(ends).alias("n_ends"),
        F.count_if(F.col("event") == "route").alias("n_routes"),
        F.max_by("event", "seq").isin("done", "error").alias("ends_last"),
    )
    tidy = (F.col("n_routes") <= F.col("starts_right").cast("int")) & (F.col("n_ends") <= F.col("ends_last").cast("int"))
    return turns.select("turn_id", "starts_right", "ended", tidy.alias("in_order"))


@query(f"SELECT turn_id, md5(string_agg(payload, '' ORDER BY seq)) AS digest FROM ({_EVENTS_OF}) e WHERE event = 'delta' GROUP BY turn_id")
def concat_deltas(t: Tables) -> DataFrame:
    return S.concat_deltas(_turns(t)).select("turn_id", F.md5("text").alias("digest"))


@query(f"SELECT turn_id, md5(string_agg(payload, '' ORDER BY seq) FILTER (WHERE event = 'delta') || ' [partial]') AS digest FROM ({_EVENTS_OF}) e GROUP BY turn_id HAVING NOT bool_or(event IN ('done', 'error')) AND bool_or(event = 'delta')")
def partial_persist(t: Tables) -> DataFrame:
    events = _turns(t)
    ended = events.where(F.col("event").isin("done", "error")).select("turn_id")
    return S.concat_deltas(events).join(ended, "turn_id", "left_anti").select("turn_id", F.md5(F.concat("text", F.lit(" [partial]"))).alias("digest"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 10")
def incremental_ingest(t: Tables) -> DataFrame:
    """A file stream, run once to its end, whose checkpoint makes a second run read nothing again."""
    out = f"{S.shared_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    return S.incremental(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema, lambda rows: rows.where("value > 10").select("event_id", "event_type", "value"), out)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def hourly_counts(t: Tables) -> DataFrame:
    return S.hourly_counts(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) x WHERE p IS NULL OR ts - p >= INTERVAL 6 HOUR GROUP BY user_id")
def sessions(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("ts").cast("timestamp").alias("at")).groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS last_ms, 'STREAM_TIMEOUT' AS event FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) x WHERE n IS NULL OR epoch_us(n) // 1000 - epoch_us(ts) // 1000 > 300000")
def stream_timeout(t: Tables) -> DataFrame:
    return S.timeouts(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)


@query(f"SELECT conv_id, turn, role, law, article, nullif(user_article, '') AS user_article FROM {dialogue._BEFORE}")
def stream_focus(t: Tables) -> DataFrame:
    """The focus of every turn from a stream of files in no order, two a micro-batch, with the conversation's state kept between them."""
    out = V.new_folder(t.spark, "focus")
    named = dialogue.named(dialogue.said(t)).select("conv_id", "turn", "role", "own_law", "own_article")
    named.repartition(6, "turn", "role").write.parquet(f"{out}/turns")
    turns = t.spark.readStream.schema(named.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/turns")
    return V.focus_stream(turns, f"{out}/focus")


_SHORT_TURNS = "SELECT event_id // 5 AS turn_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'done' ELSE 'delta' END AS event FROM events"


@query(f"SELECT CAST(turn_id AS BIGINT) AS turn_id, CAST(count(*) AS BIGINT) AS events, 'STREAM_TIMEOUT' AS event FROM ({_SHORT_TURNS}) e GROUP BY turn_id HAVING NOT bool_or(event IN ('done', 'error'))")
def hard_timeout(t: Tables) -> DataFrame:
    """The turns that neither end nor fail, ended by their timers (of 5 seconds here) and nothing else."""
    out = V.new_folder(t.spark, "deadlines")
    events = t.spark.sql(_SHORT_TURNS.replace("event_id // 5", "event_id div 5").replace("FROM events", "FROM {events}"), events=t.events)
    events.write.parquet(f"{out}/events")
    return V.timeout_stream(t.spark.readStream.schema(events.schema).parquet(f"{out}/events"), f"{out}/ended", 5000)


_ORDERS = "namespace string, o_custkey long, o_orderkey long, at timestamp, o_totalprice double"


def _keyed(t: Tables) -> tuple[I.KeyedTable, str]:
    """Orders as a stream of changes to the last order of each customer and priority, in five files in no order; some of them without a customer."""
    out = V.new_folder(t.spark, "keyed")
    key = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey"))
    rows = t.orders.select(F.col("o_orderpriority").alias("namespace"), key.alias("o_custkey"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), "o_totalprice")
    rows.repartition(5, "o_orderkey").write.parquet(f"{out}/source")
    return I.KeyedTable(t.spark, f"{out}/table", _ORDERS, ("o_custkey",), ("at", "o_orderkey")), f"{out}/source"


def _changes(t: Tables, source: str) -> DataFrame:
    return t.spark.readStream.schema(_ORDERS).option("maxFilesPerTrigger", 2).parquet(source)


_LAST_ORDERS = "SELECT o_orderpriority AS namespace, o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderkey % 10 > 0 GROUP BY ALL"


@query(_LAST_ORDERS)
def keyed_ingest(t: Tables) -> DataFrame:
    """Three micro-batches upserted by key; the stream is then started again, and finds nothing new."""
    table, source = _keyed(t)
    table.ingest(_changes(t, source))
    table.ingest(_changes(t, source))
    return table.rows().drop("at")


@query("SELECT CASE WHEN o_orderkey % 10 > 0 THEN 'completed' ELSE 'no o_custkey' END AS reason, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM orders")
def ingest_state(t: Tables) -> DataFrame:
    """How many rows were taken, how many were skipped and why, and the total."""
    table, source = _keyed(t)
    table.ingest(_changes(t, source))
    return table.state()


@query(f"SELECT * FROM ({_LAST_ORDERS}) x WHERE namespace <> '1-URGENT' AND o_custkey % 3 <> 0")
def keyed_deletes(t: Tables) -> DataFrame:
    """A namespace dropped as a partition, and keys deleted from the buckets that hold them."""
    table, source = _keyed(t)
    table.ingest(_changes(t, source))
    table.delete_all("1-URGENT")
    table.delete_keys(table.rows().where("o_custkey % 3 = 0"))
    return table.rows().drop("at")


# Turns of nine events in order, some of them disturbed; and all errors together as one long turn.
_SCRIPT = """SELECT CASE WHEN event_type = 'error' AND event_id % 5 > 0 THEN -1 ELSE CAST(floor(event_id / 9) AS BIGINT) END AS turn_id, event_id AS seq,
CASE WHEN event_id % 101 = 7 THEN 'sources' WHEN event_id % 97 = 5 THEN 'ping' WHEN event_type = 'error' AND event_id % 5 > 0 THEN 'delta' WHEN event_type = 'error' THEN 'error' WHEN event_id % 9 = 0 THEN 'route' WHEN event_id % 9 = 1 THEN 'sources' WHEN event_id % 9 = 2 THEN 'warnings' WHEN event_id % 9 = 8 THEN 'done' ELSE 'delta' END AS event FROM events"""


@query(f"""WITH e AS (SELECT *, lag(event, 1, 'start') OVER (PARTITION BY turn_id ORDER BY seq) AS before FROM ({_SCRIPT}) x),
w AS (SELECT *, NOT CASE event WHEN 'route' THEN before = 'start' WHEN 'sources' THEN before = 'route' WHEN 'warnings' THEN before IN ('route', 'sources') WHEN 'delta' THEN before IN ('route', 'sources', 'warnings', 'delta') WHEN 'done' THEN before IN ('route', 'sources', 'warnings', 'delta') WHEN 'error' THEN before NOT IN ('done', 'error') ELSE FALSE END AS bad FROM e)
SELECT turn_id, CASE WHEN bool_or(bad) THEN 'wrong' WHEN arg_max(event, seq) IN ('done', 'error') THEN 'right' ELSE 'unfinished' END AS verdict, min(seq) FILTER (WHERE bad) AS wrong_seq, arg_min(event, seq) FILTER (WHERE bad) AS wrong_event FROM w GROUP BY turn_id""")
def protocol_automaton(t: Tables) -> DataFrame:
    """Whether each turn keeps the protocol, and which event first breaks it (in SQL: the first that may not follow the one before)."""
    return P.judged(t.spark.sql(_SCRIPT.replace("FROM events", "FROM {events}"), events=t.events))
