"""Retrieval-quality analytics: ranks of hits, recall, reciprocal ranks, percentiles, coverage, costs and gates, on embeddings'
labels as relevance and events as a log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.plans.base import Tables, query

# A run for each user: its events in order are what was retrieved, and purchases are the relevant ones.
_RANKED = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events"
_HITS = f"SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN rank END) AS hit, user_id % 4 AS category FROM ({_RANKED}) r GROUP BY user_id"


def _hits(t: Tables) -> DataFrame:
    ranked = t.events.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return ranked.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))).alias("hit")).withColumn("category", F.col("user_id") % 4)


def within(k: int, hit: str = "hit") -> Column:
    return F.coalesce((F.col(hit) <= k).cast("double"), F.lit(0.0))


def reciprocal(hit: str = "hit") -> Column:
    return F.coalesce(1 / F.col(hit), F.lit(0.0))


@query(f"SELECT user_id, CAST(hit AS BIGINT) AS hit FROM ({_HITS}) h")
def hit_rank(t: Tables) -> DataFrame:
    return _hits(t).select("user_id", F.col("hit").cast("long").alias("hit"))


@query(f"SELECT round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10 FROM ({_HITS}) h")
def recall_at_k(t: Tables) -> DataFrame:
    return _hits(t).agg(F.round(F.avg(within(5)), 6).alias("recall_5"), F.round(F.avg(within(10)), 6).alias("recall_10"))


@query(f"SELECT round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM ({_HITS}) h")
def mrr(t: Tables) -> DataFrame:
    return _hits(t).agg(F.round(F.avg(reciprocal()), 6).alias("mrr"))


@query(f"SELECT category, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr FROM ({_HITS}) h GROUP BY ROLLUP (category)")
def eval_rollup(t: Tables) -> DataFrame:
    return _hits(t).rollup("category").agg(F.count("*").alias("n"), F.round(F.avg(within(5)), 6).alias("recall_5"), F.round(F.avg(reciprocal()), 6).alias("mrr"))


def at_rank(rows: DataFrame, by: str, value: str, rank: DataFrame) -> DataFrame:
    """(by, value) at rank k of each group's sorted values, for rank(by, k). Equal values are counted before the shuffle, so a group's
    window has a row a distinct value, not a row an event."""
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.groupBy(by, value).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))
    return upto.join(rank, by).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(by, value)


@query("""SELECT event_type, median(value) AS p50, list_sort(list(value))[greatest(CAST(floor(count(*) * 0.95) AS INT), 1)] AS p95 FROM events WHERE value > 0 GROUP BY event_type""")
def latency_p50_p95(t: Tables) -> DataFrame:
    rows = t.events.where("value > 0").select("event_type", "value")
    rank = rows.groupBy("event_type").agg(F.greatest(F.floor(F.count("*") * 0.95), F.lit(1)).alias("k"))
    median = rows.groupBy("event_type").agg(F.median("value").alias("p50"))
    return at_rank(rows, "event_type", "value", rank).withColumnRenamed("value", "p95").join(median, "event_type").select("event_type", "p50", "p95")


@query("""SELECT event_type, list_sort(list(value))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90 FROM events GROUP BY event_type""")
def pct_nearest(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", "value")
    rank = rows.groupBy("event_type").agg((F.bround(0.9 * (F.count("*") - 1), 0) + 1).cast("long").alias("k"))
    return at_rank(rows, "event_type", "value", rank).withColumnRenamed("value", "p90")


@query("SELECT user_id, CAST(count(DISTINCT CASE WHEN event_type = 'view' THEN value END) AS BIGINT) AS laws, count(DISTINCT CASE WHEN event_type = 'view' THEN value END) >= 3 AS gated FROM events GROUP BY user_id")
def multilaw_gate(t: Tables) -> DataFrame:
    laws = F.count_distinct(F.when(F.col("event_type") == "view", F.col("value")))
    return t.events.groupBy("user_id").agg(laws.alias("laws"), (laws >= 3).alias("gated"))


_POOL = """(SELECT qid, CASE qid % 9 WHEN 0 THEN 301 WHEN 1 THEN 300 ELSE 40 END AS chars, CASE WHEN qid % 3 > 0 AND doc_id % 4 > 0 THEN CAST(doc_id * 37 % 100 * (qid % 5 + 1) AS DOUBLE) / 500 END AS rerank,
CASE WHEN qid % 6 > 0 THEN CAST(doc_id * 53 % 60 * (qid % 4 + 1) AS DOUBLE) / 240 END AS dense FROM (SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) AS qid FROM documents) d) AS p"""


@query(f"""SELECT qid, CASE WHEN chars > 300 THEN FALSE WHEN r IS NOT NULL THEN r < 0.40 WHEN d IS NOT NULL THEN d < 0.28 ELSE TRUE END AS gated,
CASE WHEN chars > 300 THEN 'exempt_long' WHEN r IS NOT NULL THEN 'rerank' WHEN d IS NOT NULL THEN 'dense' ELSE 'no_signal' END AS tier, CASE WHEN chars > 300 THEN NULL ELSE CAST(coalesce(r, d) AS DOUBLE) END AS top
FROM (SELECT qid, max(chars) AS chars, max(rerank) AS r, max(dense) AS d FROM {_POOL} GROUP BY qid) x""")
def relevance_gate(t: Tables) -> DataFrame:
    best = t.made(_POOL).groupBy("qid").agg(F.max("chars").alias("chars"), F.max("rerank").cast("double").alias("r"), F.max("dense").cast("double").alias("d"))
    return gate(best).select("qid", "gated", "tier", "top")


def gate(best: DataFrame) -> DataFrame:
    """The layered gate over a query's best scores: rerank's floor, else the dense floor, else closed; long queries are exempt."""
    long, r, d = F.col("chars") > 300, F.col("r"), F.col("d")
    gated = F.when(long, False).when(r.isNotNull(), r < 0.40).when(d.isNotNull(), d < 0.28).otherwise(True)
    tier = F.when(long, "exempt_long").when(r.isNotNull(), "rerank").when(d.isNotNull(), "dense").otherwise("no_signal")
    return best.withColumns({"gated": gated, "tier": tier, "top": F.when(~long, F.coalesce(r, d))})


# Questions of up to eight parts, a document a part: how long the part is, and its best scores.
_PARTS = """(SELECT qid, part, CASE WHEN part > 1 AND doc_id % 11 = 0 THEN 301 ELSE 60 END AS chars, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id * 37 % 100 * (qid % 4 + 1) AS DOUBLE) / 500 END AS r, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id * 53 % 60 * (qid % 3 + 1) AS DOUBLE) / 400 END AS d
FROM (SELECT doc_id, CAST(floor(doc_id / 8) AS BIGINT) AS qid, doc_id % 8 + 1 AS part FROM documents) x WHERE part <= qid % 8 + 1) AS p"""


@query(f"""WITH g AS (SELECT qid, part, coalesce(r, d) AS top, CASE WHEN r IS NOT NULL THEN r >= 0.40 WHEN d IS NOT NULL THEN d >= 0.28 ELSE FALSE END AS pass FROM {_PARTS} WHERE part <= 6 AND chars <= 300)
SELECT qid, CASE WHEN count(*) < 2 THEN FALSE ELSE NOT bool_or(pass) END AS gated, CASE WHEN count(*) < 2 THEN 'exempt_long' WHEN bool_or(pass) THEN 'decomposed_pass' ELSE 'decomposed_all_below' END AS tier,
CASE WHEN count(*) < 2 THEN NULL WHEN bool_or(pass) THEN arg_min(top, part) FILTER (WHERE pass) ELSE max(top) END AS top FROM g GROUP BY qid""")
def longquery_gate(t: Tables) -> DataFrame:
    """A long question by its parts: of the first six, those the floor holds for (300 characters), each by the layered gate. The first to
    pass lets it through with its score; with fewer than two such parts it is exempt. A question of no such part has no row."""
    parts = gate(t.made(_PARTS).where("part <= 6 AND chars <= 300"))
    few, passes = F.count("*") < 2, F.bool_or(~F.col("gated"))
    first = F.min(F.when(~F.col("gated"), F.struct("part", "top")))["top"]
    tier = F.when(few, "exempt_long").when(passes, "decomposed_pass").otherwise("decomposed_all_below")
    return parts.groupBy("qid").agg(F.when(few, False).otherwise(~passes).alias("gated"), tier.alias("tier"), F.when(few, None).when(passes, first).otherwise(F.max("top")).alias("top"))


# Questions of five issues each, one a document; an issue expects a law or two and articles of them, and a question has what was retrieved for it.
_ISSUES = "SELECT doc_id, CAST(floor(doc_id / 5) AS BIGINT) AS qid, doc_id % 7 AS law, CASE WHEN doc_id % 2 = 0 THEN (doc_id + 3) % 7 ELSE doc_id % 7 END AS other, doc_id % 4 AS article FROM documents"
_RETRIEVED = "SELECT CAST(floor(doc_id / 5) AS BIGINT) AS qid, (doc_id * 3) % 7 AS law, doc_id % 3 AS article FROM documents WHERE doc_id % 5 < 4"


@query(f"""WITH i AS ({_ISSUES}), h AS ({_RETRIEVED}), e AS (SELECT doc_id, qid, law, article FROM i UNION SELECT doc_id, qid, other, article FROM i),
c AS (SELECT e.doc_id, e.qid, coalesce(bool_or(h.law IS NOT NULL), FALSE) AS law_ok, coalesce(bool_or(h.article = e.article), FALSE) AS art_ok FROM e LEFT JOIN h ON h.qid = e.qid AND h.law = e.law GROUP BY e.doc_id, e.qid),
u AS (SELECT e.qid, count(DISTINCT e.law) AS n, count(DISTINCT CASE WHEN h.law IS NOT NULL THEN e.law END) AS hit FROM e LEFT JOIN h ON h.qid = e.qid AND h.law = e.law GROUP BY e.qid)
SELECT c.qid, round(max(u.hit) / max(u.n), 3) AS union_recall, round(avg(CAST(law_ok AS INT)), 3) AS law_coverage, round(avg(CAST(art_ok AS INT)), 3) AS article_coverage FROM c JOIN u USING (qid) GROUP BY c.qid""")
def issue_coverage(t: Tables) -> DataFrame:
    """Of each question: the share of all expected laws that were retrieved, of issues with any of their laws, and with any article of these."""
    issues, hits = (t.spark.sql(x.replace("FROM documents", "FROM {documents}"), documents=t.documents) for x in (_ISSUES, _RETRIEVED))
    expected = issues.select("doc_id", "qid", F.explode(F.array_distinct(F.array("law", "other"))).alias("law"), "article")
    laws = hits.groupBy("qid", "law").agg(F.collect_set("article").alias("articles"))  # once a law, so that nothing fans out
    seen = expected.join(laws, ["qid", "law"], "left").select("doc_id", "qid", "law", F.col("articles").isNotNull().alias("law_ok"), F.coalesce(F.array_contains("articles", F.col("article")), F.lit(False)).alias("art_ok"))
    union = seen.groupBy("qid").agg(F.count_distinct("law").alias("n"), F.count_distinct(F.when(F.col("law_ok"), F.col("law"))).alias("hit"))
    issue = seen.groupBy("qid", "doc_id").agg(F.bool_or("law_ok").alias("law_ok"), F.bool_or("art_ok").alias("art_ok")).groupBy("qid").agg(F.round(F.avg(F.col("law_ok").cast("int")), 3).alias("law_coverage"), F.round(F.avg(F.col("art_ok").cast("int")), 3).alias("article_coverage"))
    return union.join(issue, "qid").select("qid", F.round(F.col("hit") / F.col("n"), 3).alias("union_recall"), "law_coverage", "article_coverage")


_ROUTED = """(SELECT CASE event_id % 4 WHEN 0 THEN 'citation_lookup' WHEN 1 THEN 'status_lookup' ELSE 'semantic_question' END AS expected, CASE event_id * 7 % 5 WHEN 0 THEN 'citation_miss' WHEN 1 THEN 'status_lookup' WHEN 2 THEN 'citation_lookup' ELSE 'semantic_question' END AS got FROM events) AS r"""


@query(f"SELECT expected, round(avg(CASE WHEN expected = got OR (expected = 'citation_lookup' AND got = 'citation_miss') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_ROUTED} GROUP BY expected")
def routing_accuracy(t: Tables) -> DataFrame:
    right = (F.col("expected") == F.col("got")) | ((F.col("expected") == "citation_lookup") & (F.col("got") == "citation_miss"))
    return t.made(_ROUTED).groupBy("expected").agg(F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def usage_sql(table: str, key: str) -> str:
    """A call of a model for each row of a table: its model and its tokens, asked, found in the cache (more than asked, for some), given."""
    return f"(SELECT {key}, CASE {key} % 3 WHEN 0 THEN 'pro-1' WHEN 1 THEN 'flash-2' ELSE 'other' END AS model, {key} % 5003 AS prompt, {key} * 3 % 6007 AS cached, {key} % 701 AS output FROM {table}) AS u"


COST_SQL = "CASE WHEN model LIKE 'pro%' THEN greatest(0, prompt - cached) * 0.435 + cached * 0.003625 + output * 0.87 WHEN model LIKE 'flash%' THEN greatest(0, prompt - cached) * 0.14 + cached * 0.0035 + output * 0.28 ELSE 0 END / 1000000"
# Dollars a million tokens, missed cache, hit cache, output.
RATES = {"pro": (0.435, 0.003625, 0.87), "flash": (0.14, 0.0035, 0.28)}


def dollars() -> Column:
    missed, cost = F.greatest(F.lit(0), F.col("prompt") - F.col("cached")), F.lit(0.0)
    for prefix, (miss, hit, out) in RATES.items():
        cost = F.when(F.col("model").startswith(prefix), missed * miss + F.col("cached") * hit + F.col("output") * out).otherwise(cost)
    return cost / 1_000_000


@query(f"SELECT event_id, model, round({COST_SQL}, 12)::DOUBLE AS cost FROM {usage_sql('events', 'event_id')}")
def llm_cost(t: Tables) -> DataFrame:
    return t.made(usage_sql("events", "event_id")).select("event_id", "model", F.round(dollars(), 12).alias("cost"))


@query("SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN contains(props, 'error') THEN 'ERROR' WHEN value > 50 THEN 'GATE_FAILED' ELSE 'INGESTED' END AS status FROM events) x GROUP BY status")
def classify_report(t: Tables) -> DataFrame:
    status = F.when(F.col("props").contains("error"), "ERROR").when(F.col("value") > 50, "GATE_FAILED").otherwise("INGESTED")
    return t.events.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_LETTERS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+'))"


@query(f"""SELECT w AS keyword, doc_id FROM (SELECT d.w, d.doc_id, row_number() OVER (PARTITION BY d.w ORDER BY d.doc_id) AS r FROM (SELECT doc_id, unnest({_LETTERS}) AS w FROM documents) d JOIN (SELECT DISTINCT unnest({_LETTERS}) AS w FROM benchmark) b ON b.w = d.w) x WHERE r <= 5""")
def keyword_membership(t: Tables) -> DataFrame:
    """Every word of a benchmark text is a keyword; of the documents that have it, five (the cap is the feature)."""
    each = lambda rows: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))))
    keys = t.benchmark.select(each(t.benchmark).alias("keyword")).distinct()
    found = t.documents.select("doc_id", each(t.documents).alias("keyword")).join(keys, "keyword", "left_semi")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy("doc_id"))).where("r <= 5").select("keyword", "doc_id")
