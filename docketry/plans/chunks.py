"""Article chunking, garble detection and corpus audits. Gazette text is made from documents: their lines become numbered articles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import chunking as C
from docketry.operators.chunk_function import chunk_lines
from docketry.plans.base import Tables, query
from docketry.sources.folders import register
from docketry.streaming.turns import shared_dir

_GAZETTE_SQL = """SELECT 'L' || doc_id AS law, 'Gazeta' || chr(10) || list_aggregate(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN (i - 1) % 5 = 0 THEN 'Kreu ' || CAST((i - 1) // 5 + 1 AS VARCHAR) || ' Pjesa' || chr(10) ELSE '' END || 'Neni ' || CAST((i - 1) % 7 + 1 AS VARCHAR) || chr(10) || l[i]), 'string_agg', chr(10)) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x"""


def gazette(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    blocks = F.transform("l", lambda line, i: F.concat(F.when(i % 5 == 0, F.concat(F.lit("Kreu "), (F.floor(i / 5) + 1).cast("string"), F.lit(" Pjesa\n"))).otherwise(""), F.lit("Neni "), (i % 7 + 1).cast("string"), F.lit("\n"), line))
    return lines.select(F.concat(F.lit("L"), "doc_id").alias("law"), F.concat(F.lit("Gazeta\n"), F.array_join(blocks, "\n")).alias("text"))


# Each line of a document is one article here, so SQL needs no parsing: the same rows by construction.
_ARTICLES_SQL = """SELECT 'L' || doc_id AS law, i, CAST((i - 1) % 7 + 1 AS VARCHAR) AS number, CAST((i - 1) // 5 + 1 AS VARCHAR) AS chapter, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x) y"""


@query("SELECT law, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM (" + _GAZETTE_SQL + ") g")
def gazette_text(t: Tables) -> DataFrame:
    return gazette(t).select("law", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query(f"SELECT law, number, chapter, CAST(count(*) AS BIGINT) AS n FROM ({_ARTICLES_SQL}) a GROUP BY ALL")
def article_boundaries(t: Tables) -> DataFrame:
    lines = C.lines_of(gazette(t))
    upto = Window.partitionBy("law").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("chapter", F.last("chapter", True).over(upto)).where("number IS NOT NULL").groupBy("law", "number", "chapter").agg(F.count("*").alias("n"))


_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_CHUNKS_SQL = f"""WITH a AS (SELECT 'L' || doc_id AS law, i, len(l) AS n, (i - 1) % 7 + 1 AS number, CAST((i - 1) // 5 + 1 AS VARCHAR) AS chapter, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x) y),
b AS (SELECT law, i, number, chapter, trim(line, {_SPACES}) AS bare, trim('Neni ' || number || chr(10) || line || CASE WHEN i % 5 = 0 AND i < n THEN chr(10) || 'Kreu ' || (i // 5 + 1) || ' Pjesa' ELSE '' END, {_SPACES}) AS content FROM a),
c AS (SELECT *, CASE WHEN number <= lag(number) OVER (PARTITION BY law ORDER BY i) THEN 1 ELSE 0 END AS dropped FROM b WHERE length(content) >= 50),
d AS (SELECT *, sum(dropped) OVER (PARTITION BY law ORDER BY i) AS section, CASE WHEN length(content) <= 12000 THEN [content] ELSE list_transform(range(CAST(ceil(length(content) / 12000.0) AS BIGINT)), lambda k: substr(content, k * 12000 + 1, 12000)) END AS parts FROM c)
SELECT law, CAST(number AS VARCHAR) AS number, CASE WHEN length(bare) BETWEEN 3 AND 80 AND NOT contains(substr(bare, 1, length(bare) - 1), '.') AND NOT regexp_matches(bare, '^[0-9]') AND NOT regexp_matches(bare, '^[0-9IVX]+[.\\s]') THEN bare ELSE '' END AS title, chapter,
law || CASE WHEN section > 0 THEN '_d' || CAST(section AS BIGINT) ELSE '' END || '_art' || number || CASE WHEN len(parts) > 1 THEN '_p' || (k - 1) ELSE '' END AS chunk_id, CASE WHEN len(parts) > 1 THEN 'article_part' ELSE 'article' END AS chunk_type, parts[k] AS content FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM d) e"""


@query(_CHUNKS_SQL)
def chunk_law(t: Tables) -> DataFrame:
    return C.chunk_law(gazette(t))


@query(_CHUNKS_SQL)
def chunk_table_function(t: Tables) -> DataFrame:
    """The same chunks from SQL's table function."""
    return chunk_lines(gazette(t).select("law", F.posexplode(F.split("text", "\n")).alias("pos", "line")))


def _folders(t: Tables) -> str:
    """A folder a document, named by its law, with its text in a file (or, for every seventh, none)."""
    register(t.spark)
    path = f"{shared_dir(t.spark)}/laws-{uuid.uuid4().hex}"
    text = F.when(F.col("doc_id") % 7 > 0, F.col("text"))
    folder = F.format_string("folder=%02d_L-%d", F.col("doc_id") % 9, "doc_id")
    made = t.documents.select(folder.alias("folder"), F.lit("part-0.txt").alias("name"), F.to_json(F.struct(text.alias("text")), {"ignoreNullFields": "false"}).cast("binary").alias("content"))
    made.write.format("law_folders").mode("append").save(path)
    return path


@query("""SELECT regexp_replace(printf('%02d_L-%d', doc_id % 9, doc_id), '_', '/') AS law, md5(CASE WHEN doc_id % 7 > 0 THEN text END) AS digest FROM documents WHERE doc_id IN (4, 14, 22, 100, 101)""")
def law_folders(t: Tables) -> DataFrame:
    """Folders through the data source, five laws of them; only their folders are planned."""
    laws = [f"folder={k % 9:02d}/L-{k}" for k in (4, 14, 22, 100, 101)]
    rows = t.spark.read.format("law_folders").option("pattern", "part-*.txt").load(_folders(t)).where(F.col("law").isin(laws))
    text = F.from_json(F.trim(F.col("content").cast("string")), "text string")["text"]
    return rows.select(F.regexp_replace("law", "^folder=", "").alias("law"), F.md5(text).alias("digest"))


@query("""SELECT regexp_replace(f, '_', '/') AS law FROM (SELECT printf('%02d_L-%d', doc_id % 9, doc_id) AS f FROM documents) x ORDER BY f LIMIT 25""")
def law_folders_limit(t: Tables) -> DataFrame:
    """The first 25 folders by name."""
    rows = t.spark.read.format("law_folders").option("pattern", "part-*.txt").option("limit", 25).load(_folders(t))
    return rows.select(F.regexp_replace("law", "^folder=", "").alias("law"))


@query(f"SELECT law, CAST(i AS BIGINT) AS i, number, chapter AS at_chapter FROM ({_ARTICLES_SQL}) a")
def chapter_asof(t: Tables) -> DataFrame:
    w = Window.partitionBy("law").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = C.lines_of(gazette(t)).withColumn("at_chapter", F.last("chapter", True).over(upto)).where("number IS NOT NULL")
    return lines.select("law", F.row_number().over(w).cast("long").alias("i"), "number", "at_chapter")


@query(f"SELECT law, CAST(i AS BIGINT) AS i, CAST((i - 1) // 7 AS BIGINT) AS section FROM ({_ARTICLES_SQL}) a")
def section_counter(t: Tables) -> DataFrame:
    starts = C.lines_of(gazette(t)).where("number IS NOT NULL").withColumnRenamed("pos", "start")
    return C.with_sections(starts).select("law", F.row_number().over(Window.partitionBy("law").orderBy("start")).cast("long").alias("i"), F.col("section").cast("long").alias("section"))


@query("""SELECT 'L' || doc_id AS law, CAST(i AS BIGINT) AS i, CAST(7 + before + 6 * (i - 1) + digits_before + kreu_upto AS BIGINT) AS start, CAST(coalesce(lead(7 + before + 6 * (i - 1) + digits_before + kreu_upto) OVER (PARTITION BY doc_id ORDER BY i), total) AS BIGINT) AS stop FROM
(SELECT doc_id, i, sum(length(line) + 1) OVER w - length(line) - 1 AS before, sum(length(CAST((i - 1) % 7 + 1 AS VARCHAR))) OVER w - length(CAST((i - 1) % 7 + 1 AS VARCHAR)) AS digits_before,
sum(CASE WHEN (i - 1) % 5 = 0 THEN length('Kreu  Pjesa') + 1 + length(CAST((i - 1) // 5 + 1 AS VARCHAR)) ELSE 0 END) OVER w AS kreu_upto, total FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line, total FROM
(SELECT d.doc_id, string_split(d.text, chr(10)) AS l, length(g.text) AS total FROM documents d JOIN (""" + _GAZETTE_SQL + """) g ON g.law = 'L' || d.doc_id) x) y WINDOW w AS (PARTITION BY doc_id ORDER BY i)) z""")
def article_extent(t: Tables) -> DataFrame:
    """Where each article begins in its law's text, in characters, and where the next one does, or the text ends."""
    lines = C.lines_of(gazette(t))
    w = Window.partitionBy("law").orderBy("pos")
    placed = lines.withColumn("start", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") - 1)
    ends = placed.groupBy("law").agg((F.max("start") + F.max_by(F.length("line"), "pos")).alias("total"))
    starts = placed.where("number IS NOT NULL").select("law", "start", F.row_number().over(w).cast("long").alias("i"), F.lead("start").over(w).alias("next"))
    return starts.join(ends, "law").select("law", "i", "start", F.coalesce("next", "total").alias("stop"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 50")
def chunk_min_len(t: Tables) -> DataFrame:
    return t.documents.where(F.length(F.trim("text")) >= C.LEAST_CHARS).select("doc_id")


@query("SELECT doc_id, length(trim(text)) < 500 AS scanned FROM documents")
def looks_scanned(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.length(F.trim("text")) < 500).alias("scanned"))


# What scanners print on every page, and the letters that a text needs.
WATERMARK, LEAST_LETTERS = r"(?i)(scanned\s+(with|by)\s+)?cam\s*scanner|adobe\s+scan", 200
_STAMPED = "text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Scanned with CamScanner' ELSE ' Adobe  Scan' END"


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 200 AS low FROM documents")
def low_text(t: Tables) -> DataFrame:
    """Whether a page has too few letters beside the scanner's mark, which is put on every text here."""
    clean = F.regexp_replace(F.expr(_STAMPED), WATERMARK, " ")
    return t.documents.select("doc_id", (F.length(F.regexp_replace(clean, r"[^\p{L}]", "")) < LEAST_LETTERS).alias("low"))


@query("SELECT page_id, md5(list_aggregate(list_filter(string_split(html, chr(10)), lambda x: NOT contains(x, '....')), 'string_agg', chr(10))) AS body FROM pages")
def strip_toc(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.strip_toc(F.col("html"))).alias("body"))


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '\\p{L}'))"
_BAD = "(regexp_matches(w, '[€{}|]') OR (NOT regexp_matches(w, '[/-]') AND regexp_matches(w, '\\p{L}[0-9]\\p{L}')))"
_GARBLE = f"CASE WHEN len({_WORDS}) < 15 THEN 0 ELSE len(list_filter({_WORDS}, lambda w: {_BAD})) / len({_WORDS}) END"


@query(f"SELECT doc_id, round({_GARBLE}, 6) AS ratio FROM documents")
def garble_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(X.garble_ratio(F.col("text")), 6).alias("ratio"))


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE r > 0.03) AS BIGINT) AS garbled FROM (SELECT source, {_GARBLE} AS r FROM documents) x GROUP BY source")
def garble_by_law(t: Tables) -> DataFrame:
    return t.documents.select("source", X.garble_ratio(F.col("text")).alias("r")).groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("r") > 0.03).alias("garbled"))


@query(f"SELECT doc_id, CASE WHEN r > 0.05 THEN 'ocr' ELSE 'keep' END AS route FROM (SELECT doc_id, {_GARBLE} AS r FROM documents) x")
def ocr_routing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(X.garble_ratio(F.col("text")) > 0.05, "ocr").otherwise("keep").alias("route"))


@query(f"SELECT w, {_BAD} AS corrupt FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) k")
def corrupt_token(t: Tables) -> DataFrame:
    """Every distinct word of all texts, and whether it is garbled."""
    return t.documents.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", X.corrupt_token(F.col("w")).alias("corrupt"))


@query("""SELECT class, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM (SELECT class, count(*) AS n FROM (SELECT CASE WHEN length(t) < 50 THEN 'very_short' WHEN regexp_matches(t, '/uni0[0-9a-fA-F]{3}') THEN 'uni_artifact' WHEN length(t) > 200 AND NOT regexp_matches(t, '[ëçËÇ]') THEN 'missing_diacritics' ELSE 'clean' END AS class
FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN text || ' /uni04f2' ELSE text END AS t FROM documents) x) y GROUP BY class) z""")
def index_audit(t: Tables) -> DataFrame:
    """The first class that each chunk is in, and the shares of the classes."""
    c = F.expr("CASE WHEN doc_id % 9 = 0 THEN text || ' /uni04f2' ELSE text END")
    kind = F.when(F.length(c) < 50, "very_short").when(c.rlike("/uni0[0-9a-fA-F]{3}"), "uni_artifact").when((F.length(c) > 200) & ~c.rlike("[ëçËÇ]"), "missing_diacritics").otherwise("clean")
    counts = t.documents.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))  # four rows at most
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))).select("class", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("pct"))


_SCANS = """(SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'Neni 1 ........ 5' WHEN 1 THEN 'a . . . . b' WHEN 2 THEN 'x -------- y' WHEN 3 THEN 'w ===== z' WHEN 4 THEN 'a    b' WHEN 5 THEN 'ok... fine' WHEN 6 THEN 'p ---- q  r . . . s' ELSE '' END || ' ' || coalesce(text, '') AS raw FROM documents) AS s"""


@query(f"SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(raw, '[ \\t]*\\.(?:[ \\t]*\\.){{3,}}[ \\t]*', ' ', 'g'), '-{{5,}}|_{{5,}}|={{5,}}|•{{5,}}|·{{5,}}|~{{5,}}', ' ', 'g'), '[ \\t]{{3,}}', '  ', 'g')) AS clean FROM {_SCANS}")
def normalize_ocr(t: Tables) -> DataFrame:
    return t.made(_SCANS).select("id", F.md5(X.normalize_ocr(F.col("raw"))).alias("clean"))


@query("SELECT doc_id, md5(substr(text, 1, 10000)) AS head, md5(substr(text, 1, 5000)) AS retry FROM documents")
def embed_input(t: Tables) -> DataFrame:
    # the cap is the feature: what an embedding model takes
    return t.documents.select("doc_id", F.md5(F.left("text", F.lit(10_000))).alias("head"), F.md5(F.left("text", F.lit(5_000))).alias("retry"))


@query("SELECT doc_id, coalesce(lang, '') AS language, md5(substr(text, 1, 32000)) AS content, length(text) > 32000 AS truncated FROM documents")
def chunk_metadata(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.md5(F.left("text", F.lit(32_000))).alias("content"), (F.length("text") > 32_000).alias("truncated"))


@query("SELECT doc_id, CAST(j AS INT) AS j, md5(substr(text, j * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 100) / 900.0), 1) AS BIGINT))) AS j FROM documents) x")
def sliding_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.windows(F.col("text"), 1000, 100)).alias("j", "piece")).select("doc_id", "j", F.md5("piece").alias("digest"))


@query("""SELECT doc_id || '_chunk_' || CAST(j AS VARCHAR) AS id, CAST(n AS BIGINT) AS total FROM (SELECT doc_id, n, unnest(range(0, n)) AS j FROM (SELECT doc_id, CAST(greatest(ceil((length(text) - 100) / 900.0), 1) AS BIGINT) AS n FROM documents) x) y""")
def chunk_ids(t: Tables) -> DataFrame:
    pieces = X.windows(F.col("text"), 1000, 100)
    return t.documents.select("doc_id", F.size(pieces).cast("long").alias("total"), F.posexplode(pieces).alias("j", "piece")).select(F.concat("doc_id", F.lit("_chunk_"), "j").alias("id"), "total")


def _packed_sql(text: str, most: int) -> str:
    """The pieces of a text, in SQL: paragraphs folded from the left, then cuts."""
    first = f"list_transform(regexp_split_to_array({text}, '\\n\\s*\\n'), lambda p: {{'parts': CAST([] AS VARCHAR[]), 'now': p, 'size': length(p) + 2}})"
    fold = f"list_reduce({first}, lambda a, x: CASE WHEN a.size + x.size > {most} THEN {{'parts': list_append(a.parts, a.now), 'now': x.now, 'size': x.size}} ELSE {{'parts': a.parts, 'now': a.now || chr(10) || chr(10) || x.now, 'size': a.size + x.size}} END)"
    cut = f"flatten(list_transform(list_append(f.parts, f.now), lambda p: list_transform(range(greatest(CAST(ceil(length(p) / {most}.0) AS BIGINT), 1)), lambda k: substr(p, k * {most} + 1, {most}))))"
    return f"CASE WHEN length({text}) <= {most} THEN [{text}] ELSE (SELECT {cut} FROM (SELECT {fold} AS f) z) END"


@query(f"""SELECT doc_id, CAST(i - 1 AS INT) AS part, CAST(length(p[i]) AS INT) AS chars, md5(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_packed_sql('t', 1000)} AS p FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents) a) b) c""")
def pack_paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(C.pack_paragraphs(F.regexp_replace("text", "\n", "\n\n"), 1000)).alias("part", "piece")).select("doc_id", "part", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


@query("SELECT law, md5(substr(text, length('Gazeta') + 2)) AS digest, CAST(length(text) - length('Gazeta') - 1 AS BIGINT) AS n FROM (" + _GAZETTE_SQL + ") g")
def strip_header(t: Tables) -> DataFrame:
    """The body of each law, without what comes before its first article or chapter."""
    return C.strip_header(gazette(t)).select("law", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n"))


_TITLES = """(SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'Lënda' WHEN 1 THEN '1. Shprehjet' WHEN 2 THEN 'Ka. pikë' WHEN 3 THEN 'IV. Pjesa' WHEN 4 THEN 'ab' WHEN 5 THEN 'Programi i punës.' WHEN 6 THEN repeat('a', doc_id % 5 + 78) WHEN 7 THEN 'IVpjesa ' || CAST(doc_id AS STRING) ELSE 'X ' || CAST(doc_id AS STRING) END AS line FROM documents) AS h"""


@query(f"SELECT id, length(line) BETWEEN 3 AND 80 AND NOT contains(substr(line, 1, length(line) - 1), '.') AND NOT regexp_matches(line, '^[0-9]') AND NOT regexp_matches(line, '^[0-9IVX]+[.\\s]') AS ok FROM {_TITLES}")
def detect_title(t: Tables) -> DataFrame:
    return t.made(_TITLES).select("id", C.is_title(F.col("line")).alias("ok"))


_IDS = """(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '02/L-' || CAST(doc_id AS STRING) WHEN 1 THEN 'KUV 06/L.' || CAST(doc_id AS STRING) ELSE 'Kodi_ë-' || CAST(doc_id AS STRING) END AS law, doc_id % 4 AS section, CAST(doc_id % 200 + 1 AS STRING) AS number, doc_id % 5 AS part, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 1 END AS parts FROM documents) AS i"""
_SAFE = "regexp_replace(law, '[^\\p{L}\\p{N}_-]', '_', 'g')"  # letters of every alphabet are kept


@query(f"SELECT law, {_SAFE} AS safe FROM {_IDS} GROUP BY law")
def safe_id(t: Tables) -> DataFrame:
    return t.made(_IDS).select("law", C.safe_id(F.col("law")).alias("safe")).distinct()


@query(f"SELECT law, number, {_SAFE} || CASE WHEN section > 0 THEN '_d' || CAST(section AS VARCHAR) ELSE '' END || '_art' || number || CASE WHEN parts > 1 THEN '_p' || CAST(part AS VARCHAR) ELSE '' END AS chunk_id FROM {_IDS}")
def chunk_id(t: Tables) -> DataFrame:
    return t.made(_IDS).select("law", "number", C.chunk_name(F.col("law"), F.col("section"), F.col("number"), F.col("part"), F.col("parts")).alias("chunk_id"))


@query(f"""WITH k AS ({_CHUNKS_SQL}), g AS ({_GAZETTE_SQL}), o AS (SELECT law, list_distinct(list(number)) AS numbers FROM ({_ARTICLES_SQL}) a GROUP BY law),
n AS (SELECT law, count(*) AS n, count(DISTINCT chunk_id) AS d, list_distinct(list(number)) AS numbers FROM k GROUP BY law)
SELECT g.law, CASE WHEN n.law IS NULL THEN 'no_chunks' WHEN {_GARBLE.replace("text", "g.text")} > 0.03 THEN 'garbled' WHEN n.n <> n.d THEN 'duplicate_ids' WHEN len(list_filter(o.numbers, lambda x: NOT list_contains(n.numbers, x))) > 0 THEN 'missing_articles' WHEN length(g.text) < 0.8 * (length(g.text) + CASE WHEN CAST(substr(g.law, 2) AS BIGINT) % 4 = 0 THEN 400 ELSE 0 END) THEN 'too_short' ELSE 'ok' END AS verdict
FROM g LEFT JOIN o USING (law) LEFT JOIN n USING (law)""")
def reingest_gate(t: Tables) -> DataFrame:
    """Whether a law's new chunks may replace the old: not if the text is garbled, ids repeat, an article that was there is missing, or
    the text is much shorter than the raw one (here: longer by 400 characters for every fourth law)."""
    laws = gazette(t)
    old = C.lines_of(laws).where("number IS NOT NULL").groupBy("law").agg(F.collect_set("number").alias("old"))
    new = C.chunk_law(laws).groupBy("law").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("d"), F.collect_set("number").alias("new"))
    raw = F.length("text") + F.when(F.substring("law", 2, 20).cast("long") % 4 == 0, 400).otherwise(0)
    facts = laws.select("law", X.garble_ratio(F.col("text")).alias("garble"), (F.length("text") < 0.8 * raw).alias("short")).join(old, "law", "left").join(new, "law", "left")
    ladder = F.when(F.col("n").isNull(), "no_chunks").when(F.col("garble") > 0.03, "garbled").when(F.col("n") != F.col("d"), "duplicate_ids").when(F.size(F.array_except("old", "new")) > 0, "missing_articles").when(F.col("short"), "too_short").otherwise("ok")
    return facts.select("law", ladder.alias("verdict"))


# The questions that are asked of an article.
ARTICLE_QUESTIONS = ("Çfarë thotë Neni {n} i Ligjit {law}?", "Çfarë përcakton Neni {n} i ligjit {law}?", "Më trego përmbajtjen e Nenit {n} të Ligjit {law}.", "Cila është dispozita e Nenit {n} në Ligjin {law}?", "Sipas Ligjit {law}, Neni {n}, çfarë rregullohet?")
_FORM = "[" + ", ".join(f"'{q}'" for q in ARTICLE_QUESTIONS) + "]"


@query(f"""SELECT law, number, title, replace(replace(({_FORM})[CAST(number AS BIGINT) % 5 + 1], '{{n}}', number), '{{law}}', law) AS query FROM (SELECT law, number, title, row_number() OVER (PARTITION BY law ORDER BY md5(law || number || title), chunk_id) AS r FROM ({_CHUNKS_SQL}) k
WHERE length(title) BETWEEN 3 AND 60 AND NOT regexp_matches(lower(title), '^(ligji|në ligjin|neni)') AND NOT regexp_matches(title, '[0-9]{{4}}/[0-9]')) x WHERE r = 1""")
def golden_candidates(t: Tables) -> DataFrame:
    """A question for one article of each law: of those with a real title, the first by a hash that stands for a seeded shuffle."""
    title = F.col("title")
    good = C.chunk_law(gazette(t)).where(F.length(title).between(3, 60) & ~F.lower(title).rlike("^(ligji|në ligjin|neni)") & ~title.rlike("[0-9]{4}/[0-9]"))
    shuffled = Window.partitionBy("law").orderBy(F.md5(F.concat("law", "number", "title")), "chunk_id")
    one = good.withColumn("r", F.row_number().over(shuffled)).where("r = 1")
    form = F.element_at(F.array(*map(F.lit, ARTICLE_QUESTIONS)), (F.col("number").cast("int") % 5 + 1))
    return one.select("law", "number", "title", F.replace(F.replace(form, F.lit("{n}"), F.col("number")), F.lit("{law}"), F.col("law")).alias("query"))


@query()
def recursive_chunks(t: Tables) -> DataFrame:
    """Chunks at the coarsest separators; the walk over pieces isn't told in SQL (tests hold it to its properties)."""
    from docketry.operators.splitting import chunks

    return chunks(t.documents).select("doc_id", "j", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))
