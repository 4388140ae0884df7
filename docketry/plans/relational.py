"""Joins, groupings, orders and work queues of the case data plane."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.dml import first_seen, latest_per_key
from docketry.plans.base import Tables, query
from docketry.sources import reports as R
from docketry.streaming.turns import shared_dir


@query("SELECT o.o_orderkey, o.o_orderstatus, c.c_name AS client_name, c.c_mktsegment AS client_segment FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def case_with_client(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    nested = joined.select("o_orderkey", "o_orderstatus", F.when(F.col("c_custkey").isNotNull(), F.struct("c_name", "c_mktsegment")).alias("client"))
    return nested.select("o_orderkey", "o_orderstatus", F.col("client.c_name").alias("client_name"), F.col("client.c_mktsegment").alias("client_segment"))


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_orderstatus, c.c_name FROM lineitem l
LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def invoice_with_client_case(t: Tables) -> DataFrame:
    cases = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return t.lineitem.join(cases, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderstatus", "c_name")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, ',' ORDER BY turn, role) AS roles, max_by(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def session_with_messages(t: Tables) -> DataFrame:
    messages = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("m"), F.max_by("text", "turn").alias("last_text"))
    return messages.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), "last_text")


@query("""SELECT o.o_orderkey, c.c_name, coalesce(l.n, 0) AS n_lines, coalesce(l.last_ship, TIMESTAMP '1970-01-01 00:00:00') AS last_ship FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""")
def case_eager(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_ship"))  # before the join: no fan-out
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("last_ship", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("last_ship"))


@query("""SELECT c.c_custkey, coalesce(o.ids, '') AS case_ids FROM customer c
LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def case_ids_by_client(t: Tables) -> DataFrame:
    ids = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return t.customer.join(ids, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.array_join(F.coalesce("ids", F.array().cast("array<long>")), ",").alias("case_ids"))


@query("SELECT conv_id, turn FROM conversations m WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = m.conv_id AND s.role = 'system')")
def semi_owned_messages(t: Tables) -> DataFrame:
    owned = t.conversations.where(F.col("role") == "system").select("conv_id")
    return t.conversations.join(owned, "conv_id", "left_semi").select("conv_id", "turn")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey)
AND NOT EXISTS (SELECT 1 FROM supplier s WHERE replace(s.s_name, 'Supplier', 'Customer') = c.c_name)""")
def anti_unprovisioned(t: Tables) -> DataFrame:
    users = t.supplier.select("s_suppkey", F.regexp_replace("s_name", "Supplier", "Customer").alias("s_name"))
    return t.customer.join(users, F.col("c_custkey") == F.col("s_suppkey"), "left_anti").join(users, F.col("c_name") == F.col("s_name"), "left_anti").select("c_custkey")


_A = "(SELECT c_custkey AS aid, 'm' || CAST(c_custkey * 3 AS STRING) AS aemail FROM customer) AS a"
_U = "(SELECT s_suppkey AS uid, 'm' || CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 3 WHEN s_suppkey % 3 = 1 THEN s_suppkey * 6 ELSE s_suppkey * 2 + 1 END AS STRING) AS uemail FROM supplier) AS u"


@query(f"SELECT aid, uid FROM {_A} JOIN {_U} ON aemail = uemail AND aid <> uid")
def id_drift(t: Tables) -> DataFrame:
    return t.made(_A).join(t.made(_U), (F.col("aemail") == F.col("uemail")) & (F.col("aid") != F.col("uid"))).select("aid", "uid")


@query(f"""SELECT aid, uid FROM (SELECT aid, uid, row_number() OVER (PARTITION BY aid ORDER BY CASE WHEN aid = uid THEN 0 ELSE 1 END, uid) AS r FROM {_A} JOIN {_U} ON aid = uid OR aemail = uemail) x WHERE r = 1""")
def resolve_identity(t: Tables) -> DataFrame:
    a, u = t.made(_A), t.made(_U)  # two equi-joins instead of an OR
    found = a.join(u, F.col("aid") == F.col("uid")).select("aid", "uid", F.lit(0).alias("rank")).unionByName(a.join(u, F.col("aemail") == F.col("uemail")).select("aid", "uid", F.lit(1).alias("rank")))
    return found.groupBy("aid").agg(F.min(F.struct("rank", "uid"))["uid"].alias("uid"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment AND d.c_custkey < c.c_custkey)")
def dup_email(t: Tables) -> DataFrame:
    first = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    return t.customer.join(first, ["c_nationkey", "c_mktsegment"]).where("c_custkey > first").select("c_custkey")


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey = 4")
def client_cases(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_custkey = 4"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o.o_orderstatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (WHERE o.o_orderstatus = 'F') AS BIGINT) AS closed
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def client_metrics(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    return t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "open", "closed")))


def next_number(cases: DataFrame, number: str) -> DataFrame:
    """The number after the latest; the first on an empty table."""
    return cases.agg(F.format_string("CASE-%06d", F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


@query("SELECT printf('CASE-%06d', coalesce(max(o_orderkey), 0) + 1) AS next_number FROM orders")
def next_case_number(t: Tables) -> DataFrame:
    return next_number(t.orders, "o_orderkey")


@query("SELECT n.n_nationkey AS office_id, printf('CASE-%06d', coalesce(max(c.c_custkey), 0) + 1) AS next_number FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900 GROUP BY n.n_nationkey")
def next_case_number_per_office(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.max("c_custkey").alias("latest"))
    return t.nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("office_id"), F.format_string("CASE-%06d", F.coalesce("latest", F.lit(0)) + 1).alias("next_number"))


@query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def status_tally(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id", name="latest_per_key")
def latest_event_per_key(t: Tables) -> DataFrame:
    return latest_per_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, min_by(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedup_first_seen(t: Tables) -> DataFrame:
    return first_seen(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_work(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("""SELECT user_id FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, max_by(event_type, event_id) AS s FROM events GROUP BY user_id) x WHERE s <> 'view')""")
def retry_errors_only(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s"))
    return t.events.select("user_id").distinct().join(last.where("s <> 'view'"), "user_id", "left_anti")


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC NULLS FIRST, conv_id LIMIT 100")
def recent_sessions(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc_nulls_first("last_turn"), "conv_id").limit(100)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate ASC NULLS LAST, l_orderkey, l_linenumber")
def milestones_by_due(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").orderBy(F.asc_nulls_last("l_shipdate"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC NULLS FIRST, event_id")
def templates_recent(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "purchase").select("event_id", "ts").orderBy(F.desc_nulls_first("ts"), "event_id")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paginate(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy("c_custkey").offset(40).limit(20)


@query("""SELECT s_nationkey AS office_id, s_suppkey AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS r FROM supplier) x WHERE r = 1""")
def elect_owner(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"), F.asc_nulls_last("s_suppkey"))
    return t.supplier.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("s_nationkey").alias("office_id"), F.col("s_suppkey").alias("user_id"))


@query("SELECT doc_id, source FROM documents ORDER BY length(source), source, doc_id")
def numeric_string_sort(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").orderBy(F.length("source"), "source", "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de' ORDER BY n_chars, doc_id LIMIT 50")
def work_queue(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang") == "de").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(50)


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations) x WHERE r <= 6""")
def last_six_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    return t.conversations.withColumn("r", F.row_number().over(w)).where("r <= 6").select("conv_id", "turn", "role")


@query("""WITH old AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0)
SELECT id, 'delete' AS action FROM (SELECT id FROM old EXCEPT SELECT id FROM new) a UNION ALL SELECT id, 'overwrite' FROM (SELECT id FROM old INTERSECT SELECT id FROM new) b UNION ALL SELECT id, 'insert' FROM (SELECT id FROM new EXCEPT SELECT id FROM old) c""")
def reingest_plan(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("id"))
    old, new = ids.where("id % 3 <> 0").withColumn("o", F.lit(1)), ids.where("id % 2 = 0").withColumn("n", F.lit(1))
    both = old.join(new, "id", "full")  # one shuffle for all three sets
    return both.select("id", F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").otherwise("overwrite").alias("action"))


@query("""SELECT event_id, user_id, value, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS norm FROM events WINDOW w AS (PARTITION BY user_id)""")
def minmax_norm(t: Tables) -> DataFrame:
    span = t.events.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))  # partial sums before the shuffle; a hot user isn't windowed
    return t.events.join(span, "user_id").select("event_id", "user_id", "value", F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")).alias("norm"))


@query("SELECT event_id, event_type, substr(sha1(props), 1, 12) AS query_hash, json_object('event_id', event_id, 'type', event_type) AS line FROM events")
def query_log(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", F.substring(F.sha1("props"), 1, 12).alias("query_hash"), F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("line"))


@query("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || json_object('id', event_id) || chr(10) || chr(10) AS frame FROM events""")
def sse_frame(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct(F.col("event_id").alias("id"))), F.lit("\n\n")).alias("frame"))


@query("""SELECT conv_id, CASE WHEN trim(f) = '' THEN 'New chat' WHEN length(f) <= 80 THEN f ELSE rtrim(substr(f, 1, 79)) || '…' END AS title
FROM (SELECT conv_id, trim(replace(min_by(text, turn), chr(10), ' ')) AS f FROM conversations GROUP BY conv_id) x""")
def chat_title(t: Tables) -> DataFrame:
    first = t.conversations.groupBy("conv_id").agg(F.trim(F.translate(F.min_by("text", "turn"), "\n", " ")).alias("f"))
    return first.select("conv_id", F.when(F.col("f") == "", "New chat").when(F.length("f") <= 80, F.col("f")).otherwise(F.concat(F.rtrim(F.substring("f", 1, 79)), F.lit("…"))).alias("title"))


@query("""SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user' FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2, 'assistant' FROM conversations GROUP BY conv_id""")
def append_turn(t: Tables) -> DataFrame:
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    new = last.select("conv_id", F.explode(F.array(F.struct((F.col("turn") + 1).alias("turn"), F.lit("user").alias("role")), F.struct((F.col("turn") + 2).alias("turn"), F.lit("assistant").alias("role")))).alias("m")).select("conv_id", "m.*")
    return t.conversations.select("conv_id", "turn", "role").unionByName(new)


_FAILED = "(SELECT event_id, event_id % 10 AS attempt, CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 499 END AS status FROM events) AS f"


@query(f"SELECT event_id, CASE WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN NULL ELSE least(60.0, 0.5 * pow(2, attempt)) END AS seconds FROM {_FAILED}")
def backoff_schedule(t: Tables) -> DataFrame:
    """How long each failed call waits: doubled from half a second to a minute; none (null) where the caller is at fault, but for too
    many calls. A failure without a status is one of the network and tried again."""
    final = F.coalesce(F.col("status").between(400, 499) & (F.col("status") != 429), F.lit(False))
    return t.made(_FAILED).select("event_id", F.when(~final, F.least(F.lit(60.0), F.lit(0.5) * F.pow(F.lit(2), F.col("attempt")))).alias("seconds"))


_RUNS = "SELECT event_id % 500 AS law, event_id AS line, CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'ERROR' WHEN value > 50 THEN 'GATE_FAILED' ELSE 'INGESTED' END AS status FROM events"


@query(f"SELECT law, max_by(status, line) AS status, max(line) AS line FROM ({_RUNS}) r GROUP BY law")
def report_latest(t: Tables) -> DataFrame:
    """A report that two runs append to, read back: the last line of each law."""
    return _report(t)


@query(f"SELECT law FROM (SELECT DISTINCT o_orderkey % 600 AS law FROM orders) w WHERE law NOT IN (SELECT law FROM (SELECT law, max_by(status, line) AS s FROM ({_RUNS}) r GROUP BY law) x WHERE s <> 'ERROR')")
def report_todo(t: Tables) -> DataFrame:
    """What a further run has to do: laws without a line, or whose last one is an error."""
    return R.todo(t.orders.select((F.col("o_orderkey") % 600).alias("law")).distinct(), _report(t), "law")


def _report(t: Tables) -> DataFrame:
    path, runs = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}", t.spark.sql(_RUNS.replace("FROM events", "FROM {events}"), events=t.events)
    for half in (0, 1):
        R.append(runs.where(F.col("line") % 2 == half), path)
    return R.latest(t.spark, path, "law long, line long, status string", "law", "line").select("law", "status", "line")


@query("SELECT 'L' || p_partkey AS abolished, CAST(count(*) AS BIGINT) AS n, bool_or(p_size > 25) AS fully FROM part GROUP BY p_partkey")
def registry_scan(t: Tables) -> DataFrame:
    """Registries of relations, a JSON document each, written from parts and read back, by the law that is abolished."""
    relation = F.struct(F.concat(F.lit("L"), "p_partkey").alias("abolished"), F.col("p_name").alias("abolishing"), F.when(F.col("p_size") > 25, "full").otherwise("partial").alias("kind"))
    path = f"{shared_dir(t.spark)}/registry-{uuid.uuid4().hex}"
    t.part.select(F.array(relation).alias("relations")).write.json(path)
    return R.registry(t.spark, path, one=False).groupBy("abolished").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "full").alias("fully"))


@query("SELECT '04/L-' || p_partkey AS law, p_name || ' (e re)' AS title FROM part WHERE p_partkey % 6 > 0")
def json_catalog(t: Tables) -> DataFrame:
    """Catalogues written from parts and read back: each names its law twice and once without a number, and every sixth is cut off in the middle."""
    number = F.concat(F.lit("04/L-"), "p_partkey")
    entry = lambda n, title: F.struct(n.alias("number"), title.alias("title"), F.lit(None).cast("string").alias("url"))
    laws = F.array(entry(number, F.col("p_name")), entry(F.lit(None).cast("string"), F.col("p_name")), entry(F.lit("  "), F.col("p_name")), entry(number, F.concat("p_name", F.lit(" (e re)"))))
    line = F.to_json(F.struct(laws.alias("laws")))
    path = f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    t.part.select(F.when(F.col("p_partkey") % 6 > 0, line).otherwise(F.substring(line, 1, 30)).alias("value")).write.text(path)
    return R.catalog(t.spark, path).select(F.col("number").alias("law"), "title")
