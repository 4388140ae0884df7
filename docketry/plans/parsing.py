"""Document parsers, templates and text utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import language_model as L
from docketry.operators import parsing as P
from docketry.plans.base import Tables, query
from docketry.sources import charsets as C

_CONTROL, _SPACE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_ADDRESS = "https?://(?:[a-zA-Z0-9$-_@.&+!*(),]|%[0-9a-fA-F][0-9a-fA-F])+"
_CLEAN = f"trim(regexp_replace(regexp_replace(text, '{_CONTROL}', '', 'g'), '{_SPACE}', ' ', 'g'))"
_PREPROCESSED = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{_CONTROL}', '', 'g'), '{_ADDRESS}', '', 'g'), '{_SPACE}', ' ', 'g'))"


@query(f"SELECT doc_id, md5(CASE WHEN regexp_matches(t, '^[\\s.,;:!?]*$') THEN '' ELSE t END) AS clean FROM (SELECT doc_id, {_PREPROCESSED} AS t FROM documents) x")
def preprocess_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.preprocess(F.col("text"))).alias("clean"))


@query(f"SELECT doc_id, md5({_CLEAN}) AS clean, md5(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13))) AS normal FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean"), F.md5(X.trimmed(F.lower(X.compatible(F.col("text"))))).alias("normal"))


@query("""SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n[ \\t]*\\n'), lambda p: trim(regexp_replace(p, '[ \\t\\r\\n]+', ' ', 'g'))), lambda p: length(p) >= 50) AS p FROM documents) x""")
def extract_paragraphs(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", X.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 50).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


# Documents of six kinds, made from the documents' lines: a title, then every third line under a header of the kind.
_KIND = "CASE doc_id % 6 WHEN 0 THEN 'law' WHEN 1 THEN 'regulation' WHEN 2 THEN 'case_law' WHEN 3 THEN 'contract' WHEN 4 THEN 'article' ELSE 'other' END"
_CASE = ", ".join(f"'{h}'" for h in P.CASE_HEADERS)
_ARTICLE = ", ".join(f"'{h}'" for h in P.ARTICLE_HEADERS)


def _head(i: str, at: str) -> str:
    n = f"CAST({i} AS STRING)"
    return f"""CASE doc_id % 6 WHEN 0 THEN 'Article ' || {n} || ' Scope' WHEN 1 THEN 'Chapter IV Part' WHEN 2 THEN {at.format(list=_CASE, n=9)} || ' of it' WHEN 3 THEN '(a) between A' || {n} || ', dated the 3rd May 2021' WHEN 4 THEN {at.format(list=_ARTICLE, n=8)} || ' (19' || lpad(CAST({i} % 100 AS STRING), 2, '0') || ')' ELSE 'PART ' || {n} END"""


_LINES_SQL = f"""(SELECT doc_id, {_KIND} AS kind, i, 'x ' || regexp_replace(lower(l[i + 1]), '\\s+$', '') AS line, {_head('i', '[{list}][i % {n} + 1]')} AS head FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b) c"""


def _papers(t: Tables) -> DataFrame:
    """(doc_id, kind, text)"""
    lines = t.documents.select("doc_id", F.expr(_KIND).alias("kind"), F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("x "), F.regexp_replace(F.lower(x), r"\s+$", ""))).alias("l"))
    headed = F.expr(f"transform(l, (x, i) -> CASE WHEN i % 3 = 1 THEN {_head('i', 'element_at(array({list}), i % {n} + 1)')} || '\\n' ELSE '' END || x)")
    return lines.select("doc_id", "kind", F.concat(F.lit("A title of\n two lines \n\n"), F.array_join(headed, "\n")).alias("text"))


def _bodies(t: Tables) -> DataFrame:
    return _papers(t).select("doc_id", "kind", P.title_and_body(F.col("text")).alias("p")).select("doc_id", "kind", "p.title", "p.body")


@query("SELECT doc_id, 'A title of two lines' AS title FROM documents")
def extract_title(t: Tables) -> DataFrame:
    return _bodies(t).select("doc_id", "title")


_SECTIONS_SQL = f"SELECT doc_id, kind, CAST((i + 2) // 3 AS BIGINT) AS section, CASE WHEN i = 0 THEN 'MAIN' ELSE head END AS title, md5(string_agg(line, chr(10) ORDER BY i) OVER (PARTITION BY doc_id, (i + 2) // 3)) AS content FROM {_LINES_SQL} WHERE kind <> 'contract' AND (i > 0 OR kind = 'other') QUALIFY i = min(i) OVER (PARTITION BY doc_id, (i + 2) // 3)"


@query(_SECTIONS_SQL)
def parse_document(t: Tables) -> DataFrame:
    """The sections of every document, by the parser of its kind (contracts have clauses instead)."""
    return P.sections(_bodies(t), "doc_id").select("doc_id", "kind", "section", "title", F.md5("content").alias("content"))


@query(f"SELECT * FROM ({_SECTIONS_SQL}) s WHERE kind = 'case_law'")
def parse_case_law(t: Tables) -> DataFrame:
    return P.sections(_bodies(t).where("kind = 'case_law'"), "doc_id").select("doc_id", "kind", "section", "title", F.md5("content").alias("content"))


@query(f"SELECT * FROM ({_SECTIONS_SQL}) s WHERE kind = 'other'")
def parse_generic(t: Tables) -> DataFrame:
    return P.sections(_bodies(t).where("kind = 'other'"), "doc_id").select("doc_id", "kind", "section", "title", F.md5("content").alias("content"))


@query(f"SELECT doc_id, CAST(i AS VARCHAR) AS number, 'Scope' AS title FROM {_LINES_SQL} WHERE kind = 'law' AND i % 3 = 1")
def parse_law(t: Tables) -> DataFrame:
    laws = _bodies(t).where("kind IN ('law', 'regulation')")
    return laws.select("doc_id", F.explode(P.law_articles(F.col("body"))).alias("a")).select("doc_id", "a.number", "a.title")


@query(f"SELECT doc_id, CAST(count(*) FILTER (WHERE i % 3 = 1) AS BIGINT) AS n, coalesce(string_agg('3rd May 2021', ',') FILTER (WHERE i % 3 = 1), '') AS dates, coalesce(string_agg('A' || i, ',' ORDER BY i) FILTER (WHERE i % 3 = 1), '') AS parties FROM {_LINES_SQL} WHERE kind = 'contract' GROUP BY doc_id")
def parse_contract(t: Tables) -> DataFrame:
    b = F.col("body")
    return _bodies(t).where("kind = 'contract'").select("doc_id", F.size(P.clauses(b)).cast("long").alias("n"), F.array_join(P.dates(b), ",").alias("dates"), F.array_join(P.parties(b), ",").alias("parties"))


@query(f"SELECT doc_id, coalesce(string_agg('(19' || lpad(CAST(i % 100 AS VARCHAR), 2, '0') || ')', '' ORDER BY i) FILTER (WHERE i % 3 = 1), '') AS years FROM {_LINES_SQL} WHERE kind = 'article' GROUP BY doc_id")
def parse_article(t: Tables) -> DataFrame:
    return _bodies(t).where("kind = 'article'").select("doc_id", F.array_join(P.years_cited(F.col("body")), "").alias("years"))


@query("""SELECT doc_id, CAST(s AS BIGINT) AS section, md5(max(CASE WHEN head THEN line END)) AS head, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head)) AS body FROM (SELECT doc_id, i, line, head, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM
(SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line, length(unnest(l)) < 60 AS head FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x) y) z WHERE s > 0 GROUP BY doc_id, s HAVING count(*) FILTER (WHERE NOT head) > 0""")
def section_state_machine(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.length("line") < 60).withColumn("s", F.sum(F.col("head").cast("long")).over(w)).where("s > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    each = marked.groupBy("doc_id", F.col("s").alias("section")).agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), body.alias("b"), F.count_if(~F.col("head")).alias("n")).where("n > 0")
    return each.select("doc_id", "section", F.md5("h").alias("head"), F.md5("b").alias("body"))


_GRAMS_SQL = """SELECT doc_id, lang, substr(w, k, 3) AS gram FROM (SELECT doc_id, lang, w, unnest(range(1, length(w) - 1)) AS k FROM (SELECT doc_id, lang, '_' || unnest(regexp_extract_all(lower(text), '\\p{L}+')) || '_' AS w FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20 OR lang IS NOT NULL) x) y"""
_LEARNED = "doc_id % 4 <> 2 AND lang IS NOT NULL"


@query(f"""WITH g AS ({_GRAMS_SQL}),
kept AS (SELECT lang, gram, n FROM (SELECT lang, gram, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS r FROM g WHERE {_LEARNED} GROUP BY lang, gram) x WHERE r <= {L.GRAMS}),
model AS (SELECT v.gram, s.lang, CAST(round(1000 * ln((coalesce(k.n, 0) + 0.5::DOUBLE) / (s.total + 0.5::DOUBLE * (SELECT count(DISTINCT gram) FROM kept)))) AS BIGINT) AS w
  FROM (SELECT DISTINCT gram FROM kept) v CROSS JOIN (SELECT lang, sum(n)::BIGINT AS total FROM kept GROUP BY lang) s LEFT JOIN kept k ON k.lang = s.lang AND k.gram = v.gram),
sums AS (SELECT g.doc_id, m.lang, sum(m.w)::BIGINT AS w FROM g JOIN model m USING (gram) JOIN documents d ON d.doc_id = g.doc_id WHERE length(trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20 GROUP BY g.doc_id, m.lang),
parts AS (SELECT doc_id, lang, exp((w - max(w) OVER (PARTITION BY doc_id)) / 1000.0::DOUBLE) AS part FROM sums),
p AS (SELECT doc_id, lang, part / sum(part) OVER (PARTITION BY doc_id) AS p FROM parts)
SELECT d.doc_id, b.lang, round(b.p, 6) AS confidence, coalesce(b.lang IN ('en', 'de'), FALSE) AS supported
FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, lang DESC) AS r FROM p) b ON b.doc_id = d.doc_id AND b.r = 1""")
def detect_language(t: Tables) -> DataFrame:
    """The likeliest language of each text and its probability; the model is counted on three rows in four."""
    return L.detect(t.documents, L.learn(t.documents.where(_LEARNED)), supported=("en", "de"))


# The kinds of a template's variables.
VARIABLE_KINDS = ("text", "date", "number", "select")
# A template a document: tokens in its body, and what was declared of them (a name twice, an unknown kind, a name left out).
_BODY = "'Dear {{name}}, on {{ day_' || CAST(doc_id % 3 AS STRING) || ' }} ' || CASE WHEN doc_id % 2 = 0 THEN '{{sum}} ' ELSE '' END || 'you {{name}}'"
_DECLARED = """'[{"name": "name", "type": "number"}, {"name": "place", "type": "city"}, {"name": "", "type": "text"}' || CASE WHEN doc_id % 2 = 1 THEN ', {"name": "name", "type": "date", "required": false}' ELSE '' END || ']'"""


@query("""SELECT doc_id, 'name:' || CASE WHEN doc_id % 2 = 1 THEN 'date:false' ELSE 'number:true' END || ',place:text:true,day_' || doc_id % 3 || ':text:true' || CASE WHEN doc_id % 2 = 0 THEN ',sum:text:true' ELSE '' END AS variables FROM documents""")
def template_vars(t: Tables) -> DataFrame:
    """Declared variables, of a name the last, kinds that aren't known as text; then the tokens that nobody declared."""
    declared = F.filter(F.from_json(F.expr(_DECLARED), "array<struct<name:string,type:string,required:boolean>>"), lambda v: F.coalesce(F.trim(v["name"]), F.lit("")) != "")
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.expr(_BODY), F.lit(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"), F.lit(1)), lambda x: F.trim(x)))
    rows = t.documents.select("doc_id", declared.alias("declared"), tokens.alias("tokens")).withColumn("names", F.array_distinct(F.transform("declared", lambda v: F.trim(v["name"]))))
    last = F.transform("names", lambda n: F.element_at(F.filter("declared", lambda v: F.trim(v["name"]) == n), -1))
    shown = F.transform(last, lambda v: F.concat_ws(":", F.trim(v["name"]), F.when(v["type"].isin(*VARIABLE_KINDS), v["type"]).otherwise("text"), F.coalesce(v["required"], F.lit(True)).cast("string")))
    more = F.transform(F.array_except("tokens", "names"), lambda n: F.concat(n, F.lit(":text:true")))
    return rows.select("doc_id", F.array_join(F.concat(shown, more), ",").alias("variables"))


_REPLIES = """(SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"title": "T' || CAST(doc_id AS STRING) || '", "language": "sq"}' || chr(10) || '```' WHEN 1 THEN 'here: {"title": "B {x}"} done' WHEN 2 THEN 'nothing'
WHEN 3 THEN '{"title": "C' || chr(10) WHEN 4 THEN '{"language": "en", "title": null}' ELSE '```' || chr(10) || '{"title": "D", "more": {"title": "E"}}' || chr(10) || '```' END AS reply FROM documents) AS r"""


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'T' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'B {x}' WHEN 5 THEN 'D' END AS title, CASE doc_id % 6 WHEN 0 THEN 'sq' WHEN 4 THEN 'en' END AS language FROM documents")
def template_json(t: Tables) -> DataFrame:
    body = F.regexp_extract(F.regexp_replace("reply", r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return t.made(_REPLIES).select("id", F.from_json(body, "title string, language string").alias("j")).select("id", "j.title", "j.language")


_LISTS = """(SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '["a' || CAST(doc_id AS STRING) || '", "b, c"]' WHEN 1 THEN 'c, d' || CAST(doc_id AS STRING) || ' ,, ' WHEN 2 THEN '' WHEN 3 THEN '[]' ELSE CAST(doc_id AS STRING) END AS raw FROM documents) AS v"""


@query("SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'a' || CAST(doc_id AS VARCHAR) || '|b, c' WHEN 1 THEN 'c|d' || CAST(doc_id AS VARCHAR) WHEN 4 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS items FROM documents")
def parse_list_field(t: Tables) -> DataFrame:
    """A list that is written as JSON or between commas."""
    parts = F.filter(F.transform(F.split("raw", ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.made(_LISTS).select("id", F.array_join(F.coalesce(F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")), parts), "|").alias("items"))


_META_URL = "CASE page_id % 4 WHEN 0 THEN url || '/ligji_2021-03-' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0') WHEN 1 THEN url || '/aktgjykim' WHEN 2 THEN url || '/kontrate' ELSE url END"


@query(f"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(regexp_extract(u, '([^/]+)/*$', 1), ''), 'doc-' || page_id) AS title,
CASE page_id % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'case_law' WHEN 2 THEN 'contract' ELSE CASE WHEN regexp_matches(lower(u), 'ligj|law') THEN 'law' ELSE 'other' END END AS kind, CASE WHEN page_id % 4 = 0 THEN CAST('2021-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) ELSE try_cast(nullif(regexp_extract(u, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0), '') AS DATE) END AS day FROM (SELECT *, {_META_URL} AS u FROM pages) p""")
def normalize_meta(t: Tables) -> DataFrame:
    """Title (of the page, else the name's last part, else the id), kind by words in the name, and the date in it."""
    rows = t.pages.select("page_id", "html", F.expr(_META_URL).alias("u"))
    name, low = F.nullif(F.regexp_extract("u", "([^/]+)/*$", 1), F.lit("")), F.lower("u")
    title = F.nullif(F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)), F.lit(""))
    kind = F.when(low.rlike("aktgjykim|case"), "case_law").when(low.rlike("kontrat|contract"), "contract").when(low.rlike("ligj|law"), "law").otherwise("other")
    return rows.select("page_id", F.coalesce(title, name, F.concat(F.lit("doc-"), F.col("page_id"))).alias("title"), kind.alias("kind"), F.try_to_date(F.nullif(F.regexp_extract("u", r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), "yyyy-MM-dd").alias("day"))


@query("""SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, line AS text FROM (SELECT doc_id, unnest(range(len(l))) AS i, trim(unnest(l), ' ' || chr(9) || chr(13) || chr(10)) AS line FROM
(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x) y WHERE line <> ''""")
def docx_paragraphs(t: Tables) -> DataFrame:
    """Word files (made here from documents) through the reader of docketry.sources."""
    from docketry.sources.files import docx_bytes, docx_paragraphs as read

    return read(docx_bytes(t.documents.select(F.col("doc_id").alias("id"), "text")))


@query("""SELECT doc_id AS id, md5(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (WHERE line <> ''), '')) AS digest FROM (SELECT doc_id, unnest(range(len(l))) AS i, trim(unnest(l), ' ' || chr(9) || chr(13) || chr(10)) AS line FROM
(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x) y GROUP BY doc_id""")
def docx_text(t: Tables) -> DataFrame:
    """Word files (made here from documents) as whole texts."""
    from docketry.sources import files

    return files.docx_text(files.docx_bytes(t.documents.select(F.col("doc_id").alias("id"), "text"))).select("id", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM documents")
def txt_decode(t: Tables) -> DataFrame:
    """Texts as bytes in six charsets, by id, read back without being told which."""
    texts = C.decoded(C.encoded(t.documents), C.Detector(C.learn(t.documents.where("doc_id % 4 <> 2"))), "doc_id")
    return texts.select("doc_id", F.md5(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).alias("digest"))
