"""Evaluation of answered questions: citations, refusals, costs, the two routers and the topics that are asked. A run answers one question a
document; its answers, sources and usage are made from ids, so what holds of them is known by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed, lawnum
from docketry.plans import citations as L
from docketry.plans.base import Tables, query
from docketry.plans.dialogue import INTENT, questions_asked, route
from docketry.plans.evaluation import COST_SQL, dollars, usage_sql

# Of four answers one cites, one refuses, one refuses and cites all the same, one says something without a source.
_ANSWERED = f"CASE doc_id % 4 WHEN 0 THEN {L.ANSWER} WHEN 1 THEN 'NUK KAM informacion të mjaftueshëm.' WHEN 2 THEN 'I do not have enough information. ' || {L.ANSWER} ELSE 'Ka disa mundësi.' END"
_GIVEN = f"(SELECT * FROM ({L.CITED}) c WHERE doc_id % 4 IN (0, 2))"


def answers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.expr(_ANSWERED).alias("answer"))


def counted(t: Tables) -> DataFrame:
    """(doc_id, total, verified) of the citations of each answer; an answer without any has a row as well."""
    told = answers(t)
    marks = told.select("doc_id", F.posexplode(lawnum.citations(F.col("answer"))).alias("pos", "c")).select("doc_id", "pos", "c.law", "c.article")
    counts = L.verified(marks, L.given(t)).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"))
    return told.join(counts, "doc_id", "left").select("doc_id", "answer", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("verified", F.lit(0)).alias("verified"))


_COUNTED = f"(SELECT d.doc_id, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.ok, 0) AS BIGINT) AS verified FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE verified) AS ok FROM {_GIVEN} g GROUP BY doc_id) c USING (doc_id))"


@query(f"SELECT doc_id, total, verified, total - verified AS unverified, CASE WHEN total = 0 THEN 1.0 ELSE round(verified / total, 3) END::DOUBLE AS rate FROM {_COUNTED} x")
def citation_summary(t: Tables) -> DataFrame:
    """Of each answer, its citations and those that a source covers; the rate of an answer without citations is 1."""
    rate = F.coalesce(F.round(F.try_divide("verified", "total"), 3), F.lit(1.0))
    return counted(t).select("doc_id", "total", "verified", (F.col("total") - F.col("verified")).alias("unverified"), rate.alias("rate"))


_SCORED = f"(SELECT doc_id, CAST(doc_id * seq * 37 % 61 AS DOUBLE) / 100 AS score FROM ({L.SOURCES}) s) AS s"


@query(f"""SELECT CASE WHEN doc_id % 4 IN (1, 2) THEN 'REFUSED' WHEN verified > 0 THEN 'FABRICATED' ELSE 'ANSWERED-NO-CITE' END AS verdict, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE top < 0.40) AS BIGINT) AS below_floor
FROM {_COUNTED} x JOIN (SELECT doc_id, max(score) AS top FROM {_SCORED} GROUP BY doc_id) y USING (doc_id) GROUP BY 1""")
def abstention(t: Tables) -> DataFrame:
    """Of questions that shouldn't be answered: the answers that refuse, cite nothing that holds, or make up what they cite, and how many of
    them have no source above the floor. Refusing wins over citing."""
    top = t.made(_SCORED).groupBy("doc_id").agg(F.max("score").alias("top"))
    low = F.lower("answer")
    refuses = F.greatest(*(F.contains(low, F.lit(marker)) for marker in fixed.REFUSAL_MARKERS))
    verdict = F.when(refuses, "REFUSED").when(F.col("verified") > 0, "FABRICATED").otherwise("ANSWERED-NO-CITE")
    return counted(t).join(top, "doc_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("top", F.lit(0.0)) < 0.40).alias("below_floor"))


@query(f"""SELECT d.source, CAST(count(*) AS BIGINT) AS n, round(sum(u.cost), 6)::DOUBLE AS cost, CAST(sum(c.total) AS BIGINT) AS citations, round(sum(c.verified) / nullif(sum(c.total), 0), 3)::DOUBLE AS verified_rate, CAST(count(l.law) AS BIGINT) AS relevant,
round(count(l.law) FILTER (WHERE d.doc_id % 3 > 0) / nullif(count(l.law), 0), 3)::DOUBLE AS surfaced FROM (SELECT doc_id, source, {L.RAW_LAW} AS law FROM documents) d JOIN (SELECT doc_id, CAST({COST_SQL} AS DOUBLE) AS cost FROM {usage_sql('documents', 'doc_id')}) u USING (doc_id) JOIN {_COUNTED} c USING (doc_id)
LEFT JOIN (SELECT law FROM {L.LAW_STATUS} x WHERE status <> 'abolisher') l ON l.law = d.law GROUP BY d.source""")
def cost_rollup(t: Tables) -> DataFrame:
    """Of each source's run: what it cost, the share of its citations that hold (null without any), and of questions with an abolished law those
    whose answer was given with a warning (here two of three; null where none has such a law)."""
    abolished = L.law_status(t).where("status <> 'abolisher'").select("law", F.lit(True).alias("relevant"))
    rows = t.documents.select("doc_id", "source", lawnum.canonical(F.expr(L.RAW)).alias("law"), (F.col("doc_id") % 3 > 0).alias("warned")).join(abolished, "law", "left")
    usage = t.made(usage_sql("documents", "doc_id")).select("doc_id", dollars().alias("cost"))
    relevant, surfaced = F.count_if(F.col("relevant")), F.count_if(F.col("relevant") & F.col("warned"))
    full = rows.join(usage, "doc_id").join(counted(t).drop("answer"), "doc_id")
    return full.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("total").alias("citations"), F.round(F.try_divide(F.sum("verified"), F.sum("total")), 3).alias("verified_rate"),
        relevant.alias("relevant"), F.round(F.try_divide(surfaced, relevant), 3).alias("surfaced"),
    )


# What each question should be, what a model says of it, and its milliseconds (null: the model failed and the rules stood in).
_MODEL = "CASE WHEN doc_id % 17 = 5 THEN NULL ELSE doc_id * 37 % 900 + 50 END"
_EXPECTED = f"CASE WHEN doc_id % 10 = 0 THEN 'semantic_question' ELSE {INTENT} END"
_SAID = f"CASE WHEN doc_id % 17 = 5 THEN {INTENT} WHEN doc_id % 7 = 0 THEN 'clarify' ELSE {_EXPECTED} END"


@query(f"""WITH r AS (SELECT doc_id, {INTENT} AS rule, {_EXPECTED} AS expected, {_SAID} AS model, {_MODEL} AS ms FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY ms IS NULL ORDER BY doc_id) AS k, count(ms) OVER () AS timed FROM r)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(rule = expected AS INT)), 6) AS rule_accuracy, round(avg(CAST(model = expected AS INT)), 6) AS model_accuracy, round(avg(CAST(rule = model AS INT)), 6) AS agreement, CAST(min(CASE WHEN k = 1 THEN ms END) AS BIGINT) AS cold_ms,
round(avg(CASE WHEN k > 1 OR timed = 1 THEN ms END), 6) AS warm_mean, round(avg(CASE WHEN k > 1 OR timed = 1 THEN ms END) * avg(CAST(rule = 'semantic_question' AS INT)), 6) AS fallback_overhead FROM w""")
def router_bench(t: Tables) -> DataFrame:
    """The rules and a model as routers: how often each is right, how often they agree, the first call's time and the others' mean (the first's
    too, if it is the only one), and what a question costs on average where the model is asked only when no rule holds."""
    rules = questions_asked(t).select("doc_id", route(F.col("question")).alias("r")).select("doc_id", F.col("r.intent").alias("rule"), (F.col("r.reason") == "no_rule").alias("falls"))
    told = t.made(f"(SELECT doc_id, {_EXPECTED} AS expected, {_SAID} AS model, {_MODEL} AS ms FROM documents) AS m")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    cold, timed, total = F.min_by("ms", F.when(F.col("ms").isNotNull(), F.col("doc_id"))), F.count("ms"), F.sum("ms")
    warm = F.when(timed > 1, (total - cold) / (timed - 1)).otherwise(total.cast("double"))
    return rules.join(told, "doc_id").agg(
        F.count("*").alias("n"), share(F.col("rule") == F.col("expected")).alias("rule_accuracy"), share(F.col("model") == F.col("expected")).alias("model_accuracy"), share(F.col("rule") == F.col("model")).alias("agreement"),
        cold.alias("cold_ms"), F.round(warm, 6).alias("warm_mean"), F.round(warm * F.avg(F.col("falls").cast("double")), 6).alias("fallback_overhead"),
    )


_FORMS = "[" + ", ".join(f"'{q}'" for q in fixed.TOPIC_QUESTIONS) + "]"
_STOPS = ", ".join(f"'{w}'" for w in fixed.TOPIC_STOPWORDS)
_KEYWORDS = f"(SELECT * FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS word FROM documents) x WHERE length(word) >= 6 AND word NOT IN ({_STOPS}))"


@query(f"""WITH k AS ({_KEYWORDS}), t AS (SELECT doc_id, arg_min(word, md5(doc_id || ':' || word)) AS topic FROM k GROUP BY doc_id), o AS (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS r FROM k)
SELECT t.doc_id, t.topic, replace(({_FORMS})[CAST(t.doc_id % 5 AS BIGINT) + 1], '{{topic}}', t.topic) AS query, array_to_string(list_slice(list_prepend(t.doc_id, list(o.doc_id ORDER BY o.doc_id) FILTER (WHERE o.doc_id <> t.doc_id)), 1, 5), ',') AS expected
FROM t JOIN o ON o.word = t.topic AND o.r <= 5 GROUP BY t.doc_id, t.topic""")
def golden_topics(t: Tables) -> DataFrame:
    """A topic question for each document that has a keyword (six letters or more, no stopword): the keyword by a hash that stands for a seeded
    choice, and the documents expected, its own first, then the smallest ids that share the word, five in all (the limit is the feature)."""
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).where((F.length("word") >= 6) & ~F.col("word").isin(*fixed.TOPIC_STOPWORDS))
    topics = words.groupBy("doc_id").agg(F.min_by("word", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "word"))).alias("word"))
    first = words.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))).where("r <= 5").groupBy("word").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    form = F.element_at(F.array(*map(F.lit, fixed.TOPIC_QUESTIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    own = F.array("doc_id")
    expected = F.slice(F.concat(own, F.array_except("ids", own)), 1, 5)
    return topics.join(first, "word").select("doc_id", F.col("word").alias("topic"), F.replace(form, F.lit("{topic}"), F.col("word")).alias("query"), F.array_join(expected.cast("array<string>"), ",").alias("expected"))
