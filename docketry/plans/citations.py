"""Law numbers, citations, registry and catalogue lookups, citation validation, on texts made from document ids and on small registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed, lawnum
from docketry.plans.base import Tables, query

# Texts made from document ids, by expressions that both engines read: what they cite is known by construction, so the SQL
# needs no grammar.
_S, _N, _A, _Y = "CAST(doc_id % 9 + 1 AS STRING)", "CAST(doc_id % 300 + 1 AS STRING)", "CAST(doc_id % 1059 + 1 AS STRING)", "CAST(1999 + doc_id % 20 AS STRING) || '/' || CAST(doc_id % 90 + 1 AS STRING)"
_LAW, _SHORT, _CODE = f"'0' || {_S} || '/L-' || lpad({_N}, 3, '0')", f"'0' || {_S} || '/L-' || {_N}", f"'KUV-0' || {_S} || '/L-' || lpad({_N}, 3, '0') || '-KOD'"

RAW = f"CASE doc_id % 8 WHEN 0 THEN {_S} || ' l' || {_N} WHEN 1 THEN {_S} || 'L' || {_N} WHEN 2 THEN ' 0' || {_S} || ' / L - ' || {_N} WHEN 3 THEN {_CODE} WHEN 4 THEN 'kuv-' || {_S} || '/l' || {_N} || '-kod' WHEN 5 THEN {_Y} WHEN 6 THEN '0' || {_S} || '_L-' || {_N} ELSE {_SHORT} END"
RAW_LAW = f"CASE doc_id % 8 WHEN 3 THEN {_CODE} WHEN 4 THEN 'KUV-' || {_SHORT} || '-KOD' WHEN 5 THEN {_Y} ELSE {_SHORT} END"


@query(f"SELECT doc_id, {RAW_LAW} AS law FROM documents")
def canon_law(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lawnum.canonical(F.expr(RAW)).alias("law"))


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN {_LAW} WHEN 4 THEN {_SHORT} END AS inner_law FROM documents")
def law_inner(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lawnum.inner(lawnum.canonical(F.expr(RAW))).alias("inner_law"))


def _spelled(f: str) -> str:
    return f"{f} || '|NR.' || {f} || '|Nr.' || {f} || '|' || lower({f}) || '|' || replace({f}, '/L-', '/L -')"


@query(f"""SELECT doc_id, {_spelled('law')} || CASE WHEN length(n) < 3 THEN '|' || {_spelled("replace(law, '/L-' || n, '/L-' || lpad(n, 3, '0'))")} ELSE '' END || CASE WHEN within <> '' THEN '|' || within || '|NR.' || within || '|' || lower(within) ELSE '' END AS variants
FROM (SELECT doc_id, {_N} AS n, CASE WHEN doc_id % 2 = 0 THEN {_SHORT} ELSE 'KUV-' || {_SHORT} || '-KOD' END AS law, CASE WHEN doc_id % 2 = 0 THEN '' ELSE {_SHORT} END AS within FROM documents) x""")
def law_variants(t: Tables) -> DataFrame:
    law = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {_SHORT} ELSE 'KUV-' || {_SHORT} || '-KOD' END")
    return t.documents.select("doc_id", F.array_join(lawnum.variants(law), "|").alias("variants"))


QUESTION = f"""CASE doc_id % 12 WHEN 0 THEN 'Çfarë thotë Neni ' || {_A} || ' i Ligjit ' || {_LAW} || '?' WHEN 1 THEN 'neni ' || {_A} || ' i ligjit ' || {_S} || ' l' || {_N} WHEN 2 THEN 'Sipas Nenit ' || {_A} || ' të Ligjit ' || {_CODE}
WHEN 3 THEN 'A është abroguar Ligji ' || {_Y} || '?' WHEN 4 THEN 'neni ' || {_A} || ' i Kodit Penal' WHEN 5 THEN 'neni ' || {_A} || ' i Kodit të Procedurës Penale' WHEN 6 THEN 'neni ' || {_A} WHEN 7 THEN 'Cilat ligje rregullojnë grantet?'
WHEN 8 THEN 'ligji ' || {_S} || '_L' || {_N} WHEN 9 THEN 'Ligji për Trashëgiminë, neni ' || {_A} WHEN 10 THEN 'what does article ' || {_A} || ' of law ' || {_LAW} || ' say?' ELSE 'barkodi penal dhe trashëgimia kulturore' END"""
QUESTION_LAW = f"CASE doc_id % 12 WHEN 0 THEN {_LAW} WHEN 1 THEN {_SHORT} WHEN 2 THEN {_CODE} WHEN 3 THEN {_Y} WHEN 4 THEN 'KUV-06/L-074-KOD' WHEN 5 THEN 'KUV-08/L-032-KOD' WHEN 8 THEN {_SHORT} WHEN 9 THEN '2004/26' WHEN 10 THEN {_LAW} END"
QUESTION_ARTICLE = f"CASE WHEN doc_id % 12 IN (0, 1, 2, 4, 5, 9, 10) THEN {_A} END"


@query(f"SELECT doc_id, {QUESTION_LAW} AS law, {QUESTION_ARTICLE} AS article, CASE WHEN doc_id % 12 IN (4, 5, 9) THEN TRUE WHEN doc_id % 12 IN (0, 1, 2, 3, 8, 10) THEN FALSE END AS by_name FROM documents")
def parse_citation(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lawnum.citation(F.expr(QUESTION)).alias("c")).select("doc_id", "c.law", "c.article", "c.by_name")


@query(f"SELECT doc_id, CASE WHEN doc_id % 12 IN (4, 5, 9) THEN {QUESTION_LAW} END AS law FROM documents")
def named_law(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lawnum.named_law(F.expr(QUESTION)).alias("law"))


@query("SELECT doc_id, doc_id % 12 = 3 AS is_status FROM documents")
def is_status(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.expr(QUESTION).rlike(lawnum.STATUS).alias("is_status"))


# Chunks of laws of twenty articles, one a document; every seventh has no article number but a header, or neither.
_CHUNK = """SELECT doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS law, 'L' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) || '_chunk_' || CAST(doc_id % 20 AS STRING) AS id, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 20 + 1 AS STRING) END AS article,
CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN '## Neni ' || CAST(doc_id % 20 + 1 AS STRING) || chr(10) || 'Lënda' WHEN doc_id % 7 = 0 THEN 'pa titull' WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || 'Neni ' || CAST(doc_id % 20 + 1 AS STRING) || ' fund' ELSE 'Neni ' || CAST(doc_id % 20 + 1 AS STRING) || ' Qëllimi' END AS content, doc_id % 20 + 1 AS n FROM documents"""


def _chunks(t: Tables) -> DataFrame:
    return t.spark.sql(_CHUNK.replace("FROM documents", "FROM {documents}"), documents=t.documents)


@query(f"SELECT doc_id, NOT (doc_id % 7 = 0 AND doc_id % 2 = 1) AS starts FROM ({_CHUNK}) c")
def article_header_match(t: Tables) -> DataFrame:
    return _chunks(t).select("doc_id", lawnum.starts_article(F.col("content"), F.col("n").cast("string")).alias("starts"))


@query(f"SELECT doc_id, CASE WHEN article IS NOT NULL THEN article WHEN doc_id % 2 = 0 THEN CAST(n AS STRING) END AS article FROM ({_CHUNK}) c")
def recover_article(t: Tables) -> DataFrame:
    return _chunks(t).select("doc_id", F.coalesce("article", lawnum.found(F.substring("content", 1, 300), r"(?i)neni\s+([0-9]{1,3})", 1)).alias("article"))


# Every law is asked for one article.
_ASKED = f"SELECT DISTINCT law, law % 20 + 1 AS asked FROM ({_CHUNK}) c"


def _asked(t: Tables) -> DataFrame:
    return _chunks(t).select("law", (F.col("law") % 20 + 1).alias("asked")).distinct()


@query(f"""SELECT law, id, CAST(row_number() OVER (PARTITION BY law ORDER BY CASE WHEN n = asked THEN 0 ELSE 1 END, n, id) AS BIGINT) AS rank FROM
(SELECT c.*, a.asked FROM ({_CHUNK}) c JOIN ({_ASKED}) a USING (law) WHERE c.article IS NOT NULL AND abs(c.n - a.asked) <= 1) x""")
def article_neighbors(t: Tables) -> DataFrame:
    """Of a batch of questions: the article asked for, then those before and after it. An equi-join on law and each of the three numbers."""
    wanted = _asked(t).select("law", "asked", F.explode(F.transform(F.sequence(F.col("asked") - 1, F.col("asked") + 1), lambda n: n.cast("string"))).alias("article"))
    hits = _chunks(t).select("law", "id", "article").join(wanted, ["law", "article"])
    n = F.col("article").cast("int")
    order = Window.partitionBy("law").orderBy((n != F.col("asked")).cast("int"), n, "id")
    return hits.select("law", "id", F.row_number().over(order).cast("long").alias("rank"))


def article_order() -> list:
    """By article number; without one by the number at the end of the id, and last what has neither."""
    n, k = F.expr("try_cast(article AS INT)"), F.regexp_extract("id", r"_chunk_(\d+)$", 1)
    return [F.when(n.isNotNull(), 0).otherwise(1), F.coalesce(n, F.when(k != "", k.cast("int")).otherwise(10**9)), F.col("id")]


@query(f"SELECT law, id, rank FROM (SELECT law, id, CAST(row_number() OVER (PARTITION BY law ORDER BY CAST(article AS INT), id) AS BIGINT) AS rank FROM ({_CHUNK}) c WHERE CAST(article AS INT) <= 10) x WHERE rank <= 5")
def opening_articles(t: Tables) -> DataFrame:
    opening = _chunks(t).where(F.col("article").isin(*map(str, range(1, 11))))
    return opening.select("law", "id", F.row_number().over(Window.partitionBy("law").orderBy(*article_order())).cast("long").alias("rank")).where("rank <= 5")


@query(f"SELECT law, id, CAST(row_number() OVER (PARTITION BY law ORDER BY CASE WHEN article IS NULL THEN 1 ELSE 0 END, CASE WHEN article IS NULL THEN doc_id % 20 ELSE n END, id) AS BIGINT) AS rank FROM ({_CHUNK}) c")
def article_sort(t: Tables) -> DataFrame:
    return _chunks(t).select("law", "id", F.row_number().over(Window.partitionBy("law").orderBy(*article_order())).cast("long").alias("rank"))


_NEAR = "(SELECT law, {key} AS k, max(id) AS other FROM ({chunk}) c WHERE {key} IS NOT NULL GROUP BY law, {key})"


@query(f"""SELECT a.id, coalesce(p.other, pc.other) AS before, coalesce(n.other, nc.other) AS after FROM (SELECT *, doc_id % 20 AS c, CASE WHEN article IS NOT NULL THEN n END AS m FROM ({_CHUNK}) c) a
LEFT JOIN {_NEAR.format(key='CASE WHEN article IS NOT NULL THEN n END', chunk=_CHUNK)} p ON p.law = a.law AND p.k = a.m - 1 LEFT JOIN {_NEAR.format(key='CASE WHEN article IS NOT NULL THEN n END', chunk=_CHUNK)} n ON n.law = a.law AND n.k = a.m + 1
LEFT JOIN {_NEAR.format(key='doc_id % 20', chunk=_CHUNK)} pc ON pc.law = a.law AND pc.k = a.c - 1 LEFT JOIN {_NEAR.format(key='doc_id % 20', chunk=_CHUNK)} nc ON nc.law = a.law AND nc.k = a.c + 1""")
def chunk_adjacency(t: Tables) -> DataFrame:
    """The chunks of the articles before and after; without article numbers those whose ids are next to it."""
    number, place = F.expr("try_cast(article AS INT)"), F.regexp_extract("id", r"_chunk_(\d+)$", 1).cast("int")
    out = _chunks(t).select("law", "id", number.alias("number"), place.alias("place"))
    for name, step in (("before", -1), ("after", 1)):
        for key in ("number", "place"):
            by = out.where(F.col(key).isNotNull()).groupBy("law", (F.col(key) - step).alias(key)).agg(F.max("id").alias(f"{name}_{key}"))  # of repeats the last
            out = out.join(by, ["law", key], "left")
    return out.select("id", F.coalesce("before_number", "before_place").alias("before"), F.coalesce("after_number", "after_place").alias("after"))


@query(f"""SELECT law, id, CAST(row_number() OVER (PARTITION BY law ORDER BY priority, doc_id) AS BIGINT) AS rank FROM (SELECT c.law, c.doc_id, c.id, CASE WHEN c.n = a.asked THEN 1 WHEN abs(c.n - a.asked) = 1 THEN 2 END AS priority,
bool_or(c.n = a.asked AND NOT (c.doc_id % 7 = 0 AND c.doc_id % 2 = 1)) OVER (PARTITION BY c.law) AS any_start, c.doc_id % 7 = 0 AND c.doc_id % 2 = 1 AS untitled FROM ({_CHUNK}) c JOIN ({_ASKED}) a USING (law)) x WHERE any_start AND ((priority = 1 AND NOT untitled) OR priority = 2)""")
def citation_fallback_rank(t: Tables) -> DataFrame:
    """Without article numbers: what starts the article asked for, its neighbours by id, other starts, what mentions it; nothing for a law in which no chunk starts it."""
    rows = _chunks(t).join(_asked(t), "law").withColumn("place", F.regexp_extract("id", r"_chunk_(\d+)$", 1).cast("int"))
    article = F.col("asked").cast("string")
    rows = rows.withColumn("starts", lawnum.starts_article(F.col("content"), article)).withColumn("mentions", lawnum.mentions_article(F.col("content"), article))
    primary = rows.where("starts").groupBy("law").agg(F.min(F.struct("doc_id", "place")).alias("primary"))
    ranked = rows.join(primary, "law").withColumn("priority", F.when(F.col("doc_id") == F.col("primary.doc_id"), 1).when(F.abs(F.col("place") - F.col("primary.place")) == 1, 2).when(F.col("starts"), 3).when(F.col("mentions"), 4))
    return ranked.where("priority IS NOT NULL").select("law", "id", F.row_number().over(Window.partitionBy("law").orderBy("priority", "doc_id")).cast("long").alias("rank"))


# Every document's law, and one spelling under which it is stored (the inner number for some codes, nothing for every fifth).
_WANTED = f"CASE WHEN doc_id % 2 = 0 THEN {_SHORT} ELSE 'KUV-' || {_SHORT} || '-KOD' END"
_STORED_AS = f"CASE doc_id % 5 WHEN 0 THEN 'NR.' || {_WANTED} WHEN 1 THEN lower({_WANTED}) WHEN 2 THEN replace({_WANTED}, '/L-', '/L -') WHEN 3 THEN CASE WHEN doc_id % 2 = 1 THEN 'NR.' || {_SHORT} ELSE {_WANTED} END END"


@query(f"SELECT doc_id, {_STORED_AS} AS found FROM documents")
def variant_probe(t: Tables) -> DataFrame:
    """The first spelling, in the order they are tried, under which a law is stored."""
    tried = t.documents.select("doc_id", F.posexplode(lawnum.variants(F.expr(_WANTED))).alias("pos", "spelling"))
    stored = t.documents.select(F.expr(_STORED_AS).alias("law")).where("law IS NOT NULL").distinct()
    return tried.join(stored, F.col("spelling") == F.col("law"), "left").groupBy("doc_id").agg(F.min_by("law", F.when(F.col("law").isNotNull(), F.col("pos"))).alias("found"))


# A registry of abolishments, one a document: laws by their canonical number, many of them more than once, and dates as gazettes print them.
_NEXT = "'0' || CAST((doc_id + 1) % 9 + 1 AS STRING) || '/L-' || CAST((doc_id + 1) % 300 + 1 AS STRING)"
_REGISTRY = f"""(SELECT doc_id AS id, {_SHORT} AS abolished, CASE WHEN doc_id % 7 = 0 THEN {_NEXT} ELSE {_Y} END AS abolishing, CASE WHEN doc_id % 4 = 0 THEN 'full' ELSE 'partial' END AS kind,
CASE doc_id % 6 WHEN 0 THEN '32.01.2020' WHEN 1 THEN '2020-01-05' WHEN 2 THEN '29.2.2019' WHEN 3 THEN CAST(doc_id % 28 + 1 AS STRING) || '.' || CAST(doc_id % 12 + 1 AS STRING) || '.2018' ELSE lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || '.' || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '.2012' END AS published
FROM documents WHERE doc_id % 5 < 3) AS g"""
_BY_LAW = f"(SELECT abolished AS law, count(*) AS n, string_agg(DISTINCT abolishing, ',' ORDER BY abolishing) AS by_laws, bool_or(kind = 'full') AS fully FROM {_REGISTRY} GROUP BY abolished)"
LAW_STATUS = f"(SELECT coalesce(a.law, b.law) AS law, CASE WHEN a.fully THEN 'fully_abolished' WHEN a.law IS NOT NULL THEN 'partially_abolished' ELSE 'abolisher' END AS status, a.by_laws FROM {_BY_LAW} a FULL JOIN (SELECT DISTINCT abolishing AS law FROM {_REGISTRY}) b ON a.law = b.law)"


@query(f"SELECT law, CAST(n AS BIGINT) AS n, by_laws, fully FROM {_BY_LAW} x")
def registry_by_abolished(t: Tables) -> DataFrame:
    """How often each law was abolished, the distinct laws that did it, in order, and whether one did so fully."""
    return t.made(_REGISTRY).groupBy(F.col("abolished").alias("law")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("abolishing")), ",").alias("by_laws"), F.bool_or(F.col("kind") == "full").alias("fully"))


@query(f"SELECT law, status FROM {LAW_STATUS} x")
def law_status(t: Tables) -> DataFrame:
    edges = t.made(_REGISTRY)
    roles = edges.select(F.col("abolished").alias("law"), F.when(F.col("kind") == "full", 3).otherwise(2).alias("rank")).unionByName(edges.select(F.col("abolishing").alias("law"), F.lit(1).alias("rank")))
    return roles.groupBy("law").agg(F.max("rank").alias("rank")).select("law", F.when(F.col("rank") == 3, "fully_abolished").when(F.col("rank") == 2, "partially_abolished").otherwise("abolisher").alias("status"))


@query(f"SELECT id, published, CAST(CASE WHEN NOT contains(published, '-') THEN try_strptime(published, '%d.%m.%Y') END AS DATE) AS day FROM {_REGISTRY}")
def parse_gazette_date(t: Tables) -> DataFrame:
    return t.made(_REGISTRY).select("id", "published", F.when(F.col("published").rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date("published", "d.M.yyyy")).alias("day"))


# A catalog made from documents: laws as they are typed, some without a number, many more than once.
_CATALOG_SQL = f"""SELECT CASE WHEN doc_id % 10 = 9 THEN NULL ELSE {RAW_LAW} END AS law, CASE doc_id % 8 WHEN 3 THEN {_LAW} WHEN 4 THEN {_SHORT} END AS inner_law, doc_id AS n, 'T' || CAST(doc_id AS VARCHAR) AS title FROM documents"""
_CATALOG_VIEW = f"""(WITH k AS ({_CATALOG_SQL}), own AS (SELECT law, max_by(title, n) AS title FROM k WHERE law IS NOT NULL GROUP BY law), alias AS (SELECT inner_law AS law, min_by(title, n) AS title FROM k WHERE law IS NOT NULL AND inner_law IS NOT NULL GROUP BY inner_law)
SELECT law, title FROM own UNION ALL SELECT law, title FROM alias WHERE law NOT IN (SELECT law FROM own))"""


@query(f"SELECT law, title FROM {_CATALOG_VIEW} v")
def catalog_alias(t: Tables) -> DataFrame:
    """Titles by number: of repeats the last; a code is also found under its inner number, the first of them, unless a law has it."""
    rows = t.documents.where("doc_id % 10 <> 9").select(lawnum.canonical(F.expr(RAW)).alias("law"), F.col("doc_id").alias("n"), F.concat(F.lit("T"), "doc_id").alias("title"))
    own = rows.groupBy("law").agg(F.max_by("title", "n").alias("title"))
    alias = rows.select(lawnum.inner(F.col("law")).alias("law"), "title", "n").where("law IS NOT NULL").groupBy("law").agg(F.min_by("title", "n").alias("title"))
    return own.unionByName(alias.join(own, "law", "left_anti"))


@query(f"""SELECT c.doc_id, r.law IS NOT NULL AS is_abolished, coalesce(r.by_laws, '') AS by_laws, CASE WHEN r.fully THEN 'fully' WHEN r.law IS NOT NULL THEN 'partially' END AS kind, coalesce(a.title, b.title) AS title
FROM (SELECT doc_id, {RAW_LAW} AS law, CASE doc_id % 8 WHEN 3 THEN {_LAW} WHEN 4 THEN {_SHORT} END AS inner_law FROM documents) c LEFT JOIN {_BY_LAW} r ON r.law = c.law LEFT JOIN {_CATALOG_VIEW} a ON a.law = c.law LEFT JOIN {_CATALOG_VIEW} b ON b.law = c.inner_law""")
def enrich_abolished(t: Tables) -> DataFrame:
    """Of each source: whether its law is abolished, by which, how far, and the catalogue's title of it."""
    registry = registry_by_abolished(t).select("law", "by_laws", "fully")
    sources = t.documents.select("doc_id", lawnum.canonical(F.expr(RAW)).alias("law")).join(registry, "law", "left")
    kind = F.when(F.col("fully"), "fully").when(F.col("by_laws").isNotNull(), "partially")
    return sources.join(catalog_lookup(t), "doc_id").select("doc_id", F.col("by_laws").isNotNull().alias("is_abolished"), F.coalesce("by_laws", F.lit("")).alias("by_laws"), kind.alias("kind"), "title")


@query(f"SELECT d.doc_id, coalesce(a.title, b.title) AS title FROM (SELECT doc_id, {RAW_LAW} AS law, CASE doc_id % 8 WHEN 3 THEN {_LAW} WHEN 4 THEN {_SHORT} END AS inner_law FROM documents) d LEFT JOIN {_CATALOG_VIEW} a ON a.law = d.law LEFT JOIN {_CATALOG_VIEW} b ON b.law = d.inner_law")
def catalog_lookup(t: Tables) -> DataFrame:
    asked = t.documents.select("doc_id", lawnum.canonical(F.expr(RAW)).alias("law")).withColumn("inner_law", lawnum.inner(F.col("law")))
    catalog = catalog_alias(t)
    direct, fallback = catalog.select("law", F.col("title").alias("direct")), catalog.select(F.col("law").alias("inner_law"), F.col("title").alias("fallback"))
    return asked.join(direct, "law", "left").join(fallback, "inner_law", "left").select("doc_id", F.coalesce("direct", "fallback").alias("title"))


# An answer a document: an article of a law, a law alone, and a law with the next article. What its sources cover is known by construction.
_B = "CAST(doc_id % 1059 + 2 AS STRING)"
_FIRST, _SECOND, _THIRD = f"'nenit ' || {_A} || ' të Ligjit ' || {_LAW}", f"'Ligji ' || {_Y}", f"'Ligjit Nr. ' || {_LAW} || ', neni ' || {_B}"
ANSWER = f"'Sipas ' || {_FIRST} || ', dhe ' || {_SECOND} || ' si dhe ' || {_THIRD} || ' vlen.'"
_STORED = f"CASE WHEN doc_id % 2 = 0 THEN {_CODE} ELSE {_LAW} END"
SOURCES = f"""SELECT doc_id, 1 AS seq, 's1' AS source, {_STORED} AS law, {_A} AS article, '' AS content FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 2, 's2', {_STORED}, NULL, '## Neni ' || CASE WHEN doc_id % 5 = 0 THEN {_B} ELSE '0' END FROM documents UNION ALL SELECT doc_id, 3, 's3', {_Y}, '1', '' FROM documents WHERE doc_id % 4 = 0"""
CITED = f"""SELECT doc_id, 0 AS pos, {_LAW} AS law, {_A} AS article, doc_id % 3 <> 0 AS verified, CASE WHEN doc_id % 3 <> 0 THEN 's1' END AS source FROM documents
UNION ALL SELECT doc_id, 1, {_Y}, NULL, doc_id % 4 = 0, CASE WHEN doc_id % 4 = 0 THEN 's3' END FROM documents UNION ALL SELECT doc_id, 2, {_LAW}, {_B}, doc_id % 5 = 0, CASE WHEN doc_id % 5 = 0 THEN 's2' END FROM documents"""


def _answers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.expr(ANSWER).alias("answer"))


def cited(t: Tables) -> DataFrame:
    return _answers(t).select("doc_id", F.posexplode(lawnum.citations(F.col("answer"))).alias("pos", "c")).select("doc_id", "pos", "c.law", "c.article")


def verified(marks: DataFrame, sources: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """Of each citation (doc_id, pos, law, article): whether a source of its answer covers it, and which first. Sources are found
    under their law's number and under the number within a code; a citation by either. An article must be a source's own or head its content.
    A law of the authoritative ones (law) verifies a citation without an article, by either number, though no source has it."""
    keys = sources.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("law", lawnum.inner(F.col("law"))))))).select("doc_id", "key", "seq", "source", F.col("article").alias("s_article"), "content")
    asked = marks.withColumn("key", F.coalesce(lawnum.inner(F.col("law")), "law"))
    fits = F.col("article").isNull() | F.coalesce(F.col("s_article") == F.col("article"), F.lit(False)) | lawnum.starts_article(F.col("content"), F.col("article"), fixed.SOURCE_HEADER_REACH)
    hits = asked.join(keys, ["doc_id", "key"], "left").groupBy("doc_id", "pos", "law", "article").agg(F.min(F.when(fits & F.col("source").isNotNull(), F.struct("seq", "source"))).alias("hit"))
    known = F.col("hit").isNotNull()
    if authoritative is not None:
        laws = authoritative.select(F.explode(F.array_compact(F.array("law", lawnum.inner(F.col("law"))))).alias("key")).distinct()
        told = hits.withColumn("key", F.coalesce(lawnum.inner(F.col("law")), "law")).join(laws.withColumn("told", F.lit(True)), "key", "left")
        hits, known = told, known | (F.col("article").isNull() & F.col("told").isNotNull())
    return hits.select("doc_id", "pos", "law", "article", known.alias("verified"), F.col("hit.source").alias("source"))


def given(t: Tables) -> DataFrame:
    return t.spark.sql(SOURCES.replace("FROM documents", "FROM {documents}"), documents=t.documents)


def _checked(t: Tables) -> DataFrame:
    return verified(cited(t), given(t))


@query(CITED)
def validate_citations(t: Tables) -> DataFrame:
    return _checked(t)


@query(f"SELECT doc_id, pos, law, article, verified OR (article IS NULL AND law IN (SELECT {_Y} FROM documents WHERE doc_id % 8 = 1)) AS verified, source FROM ({CITED}) c")
def validate_with_registry(t: Tables) -> DataFrame:
    """Laws that warnings have named (here those of every eighth document) verify a bare citation of theirs."""
    warned = t.documents.where("doc_id % 8 = 1").select(F.expr(_Y).alias("law"))
    return verified(cited(t), given(t), warned)


@query(f"SELECT doc_id, pos, law, article FROM ({CITED}) c")
def extract_citations(t: Tables) -> DataFrame:
    return cited(t)


_MARK = "CASE WHEN {} THEN '' ELSE '" + fixed.UNVERIFIED + "' END"


@query(f"SELECT doc_id, 'Sipas ' || {_FIRST} || {_MARK.format('doc_id % 3 <> 0')} || ', dhe ' || {_SECOND} || {_MARK.format('doc_id % 4 = 0')} || ' si dhe ' || {_THIRD} || {_MARK.format('doc_id % 5 = 0')} || ' vlen.' AS annotated FROM documents")
def annotate_unverified(t: Tables) -> DataFrame:
    truths = F.transform(F.array_sort(F.collect_list(F.struct("pos", "verified"))), lambda x: x["verified"])
    return _answers(t).join(_checked(t).groupBy("doc_id").agg(truths.alias("ok")), "doc_id").select("doc_id", lawnum.annotated(F.col("answer"), F.col("ok")).alias("annotated"))


@query(f"SELECT DISTINCT law FROM (SELECT law FROM ({CITED}) c UNION ALL SELECT {RAW_LAW} FROM documents UNION ALL SELECT CASE doc_id % 8 WHEN 3 THEN {_LAW} WHEN 4 THEN {_SHORT} END FROM documents) x WHERE law IS NOT NULL")
def authoritative_laws(t: Tables) -> DataFrame:
    synthetic = t.documents.select(lawnum.canonical(F.expr(RAW)).alias("law"))
    inners = synthetic.select(lawnum.inner(F.col("law")).alias("law")).where("law IS NOT NULL")
    return cited(t).select("law").unionByName(synthetic).unionByName(inners).distinct()


@query(f"SELECT doc_id, regexp_replace(lower(replace('NR. ' || {RAW}, ' ', '')), '^(nr\\.|nr|n\\.)', '') AS norm FROM documents")
def norm_law(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_replace(F.lower(F.replace(F.expr(f"'NR. ' || {RAW}"), F.lit(" "))), r"^(nr\.|nr|n\.)", "").alias("norm"))


@query(f"SELECT doc_id, regexp_replace({RAW}, '[^A-Za-z0-9_-]', '_', 'g') AS safe, regexp_replace({RAW}, '_', '/') AS law FROM documents")
def dirname_to_law(t: Tables) -> DataFrame:
    raw = F.expr(RAW)
    return t.documents.select("doc_id", F.regexp_replace(raw, r"(?U)[^\w-]", "_").alias("safe"), F.regexp_replace(raw, "^([^_]*)_", "$1/").alias("law"))


# The answer to each question of five sources: it names the laws of all of them or, for every third question, only that of the first.
_NAMED = f"(SELECT CAST(floor(doc_id / 5) AS BIGINT) AS qid, doc_id, {RAW_LAW} AS law FROM documents WHERE doc_id % 5 = 0 OR CAST(floor(doc_id / 5) AS BIGINT) % 3 > 0) AS m"
_WARNING = "'Ligji ' || law || ' (' || CASE WHEN status = 'fully_abolished' THEN 'plotësisht' ELSE 'pjesërisht' END || ')'"


@query(f"""WITH a AS (SELECT qid, 'Sipas ' || string_agg(law, '; ' ORDER BY doc_id) || '.' AS answer FROM {_NAMED} GROUP BY qid),
w AS (SELECT DISTINCT s.qid, s.law, l.status FROM (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS qid, {RAW_LAW} AS law FROM documents) s JOIN {LAW_STATUS} l ON l.law = s.law WHERE l.status <> 'abolisher')
SELECT w.qid, string_agg({_WARNING}, '; ' ORDER BY w.law) AS warnings, NOT bool_and(coalesce(contains(a.answer, w.law), FALSE)) AS banner FROM w LEFT JOIN a ON a.qid = w.qid GROUP BY w.qid""")
def abolish_warnings(t: Tables) -> DataFrame:
    """A warning for each distinct abolished law among a question's sources; no banner where the answer names all of them already."""
    sources = t.documents.select(F.floor(F.col("doc_id") / 5).alias("qid"), lawnum.canonical(F.expr(RAW)).alias("law")).distinct()
    named = t.made(_NAMED).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "law"))), lambda x: x["law"]), "; ").alias("answer"))
    warned = sources.join(law_status(t).where("status <> 'abolisher'"), "law").withColumn("warning", F.expr(_WARNING)).join(named, "qid", "left")
    told = F.bool_and(F.coalesce(F.contains(F.col("answer"), F.col("law")), F.lit(False)))
    return warned.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("law", "warning"))), lambda x: x["warning"]), "; ").alias("warnings"), (~told).alias("banner"))


@query(f"""SELECT law AS asked, law, 'status_verdict' AS kind, CAST(1.0 AS DOUBLE) AS score FROM {LAW_STATUS} x UNION ALL SELECT DISTINCT abolished, abolishing, 'abolishing_law', CAST(0.95 AS DOUBLE) FROM {_REGISTRY}
UNION ALL SELECT DISTINCT abolishing, abolished, 'abolished_law', CAST(0.90 AS DOUBLE) FROM {_REGISTRY}""")
def synthetic_chunks(t: Tables) -> DataFrame:
    """The chunks that answer a question on the status of each law: the verdict, the laws that abolished it and those it abolished."""
    edges = t.made(_REGISTRY).select("abolished", "abolishing").distinct()
    row = lambda asked, law, kind, score: (F.col(asked).alias("asked"), F.col(law).alias("law"), F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    verdicts = law_status(t).select(*row("law", "law", "status_verdict", 1.0))
    return verdicts.unionByName(edges.select(*row("abolished", "abolishing", "abolishing_law", 0.95))).unionByName(edges.select(*row("abolishing", "abolished", "abolished_law", 0.90)))


@query(f"SELECT law, 'Ligji ' || law || ': ' || status || coalesce(' nga ' || replace(by_laws, ',', ', '), '') AS answer FROM {LAW_STATUS} x")
def status_answer(t: Tables) -> DataFrame:
    by = registry_by_abolished(t).select("law", F.regexp_replace("by_laws", ",", ", ").alias("by_laws"))
    return law_status(t).join(by, "law", "left").select("law", F.concat(F.lit("Ligji "), "law", F.lit(": "), "status", F.coalesce(F.concat(F.lit(" nga "), "by_laws"), F.lit(""))).alias("answer"))


@query("SELECT 'L' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS VARCHAR) AS law, CAST(doc_id % 20 + 1 AS VARCHAR) AS article FROM documents WHERE doc_id % 5 = 0")
def missing_articles(t: Tables) -> DataFrame:
    """Articles of a law that were in the ids before and aren't now, however the ids are cut into sections and parts."""
    name = "'L' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING)"
    old = t.documents.select(F.expr(f"{name} || '_art' || CAST(doc_id % 20 + 1 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '_p0' ELSE '' END").alias("id"))
    new = t.documents.where("doc_id % 5 <> 0").select(F.expr(f"{name} || '_d1_art' || CAST(doc_id % 20 + 1 AS STRING)").alias("id"))
    numbers = lambda ids: ids.select(F.regexp_extract("id", "^(L[0-9]+)_", 1).alias("law"), F.regexp_extract("id", r"_art(\d+)", 1).alias("article")).distinct()
    return numbers(old).join(numbers(new), ["law", "article"], "left_anti")
