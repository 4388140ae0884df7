"""Document parsers as expressions over a text's lines: a header opens a section, the lines after it are its body. A text is a row from
beginning to end, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What begins a section, by kind of document; and what else is looked for.
LAW_HEADERS = (r"^(?:CHAPTER|Chapter)\s+([IVXLCDM0-9]+)", r"^(?:SECTION|Section)\s+(\d+)", r"^(?:ARTICLE|Article)\s+(\d+)", r"^\d+\.\s+", r"^[A-Z][A-Za-z\s]+:$")
CASE_HEADERS = ("FACTS", "BACKGROUND", "PROCEDURAL HISTORY", "ISSUES", "ANALYSIS", "DISCUSSION", "CONCLUSION", "ORDER", "JUDGMENT")
ARTICLE_HEADERS = ("ABSTRACT", "INTRODUCTION", "BACKGROUND", "METHODOLOGY", "ANALYSIS", "DISCUSSION", "CONCLUSION", "REFERENCES")
LAW_ARTICLE = r"Article\s+(\d+)[.\s\n]+([^\n]+)"
CLAUSE = r"((?:\d+\.|\([a-z]\)|\([0-9]\))\s+([^\n]+))"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATED = rf"(?i)(?:dated|effective|as of).*?(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\s+\d{{4}})"
PARTY = r"(?i)(?:between|party of the first part|party of the second part)\s+([^,\n]+)"
YEAR_CITED = r"\(\d{4}\)"
LONGEST_TITLE_LINE, LONGEST_HEADER = 200, 100
# White space, and that of one line; where the title's block ends: before an empty line or a long one.
SPACE, BLANK = " \t\n\x0B\f\r", r"[ \t\x0B\f\r]*"
TITLE_END = rf"\n(?={BLANK}(?:\n|\z|\S[^\n]{{{LONGEST_TITLE_LINE - 2},}}\S))"
KINDS = ("law", "regulation", "case_law", "contract", "article", "other")


def header(kind: str, line: Column) -> Column:
    """Whether a line opens a section in a document of the kind."""
    if kind in ("law", "regulation"):
        return line.rlike("|".join(LAW_HEADERS))
    if kind in ("case_law", "article"):
        return F.upper(line).rlike(f"^(?:{'|'.join(CASE_HEADERS if kind == 'case_law' else ARTICLE_HEADERS)})")
    return (F.length(line) < LONGEST_HEADER) & (line == F.upper(line)) & (line != F.lower(line))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def title_and_body(text: Column) -> Column:
    """struct(title, body): the first block of lines, up to an empty one or, after the first, a long one; and what follows it."""
    parts = F.split(F.ltrim(text, F.lit(SPACE)), TITLE_END, 2)
    title = F.array_join(F.transform(F.split(F.get(parts, F.lit(0)), "\n"), _bare), " ")
    return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(_bare(F.get(parts, F.lit(1))), F.lit("")).alias("body"))


def _if_header(kind: str):
    return lambda line, k: F.when(header(kind, line), k)


def sections(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, section, title, content) of texts(keys, kind, body). What comes before the first header goes, or is MAIN in documents
    of other kinds; a last header without a body is no section."""
    bare = F.filter(F.transform(F.split("body", "\n"), _bare), lambda x: x != "")
    # a line is looked at by its kind's rule alone
    at = {kinds: F.filter(F.transform("lines", _if_header(kinds[0])), lambda k: k.isNotNull()) for kinds in (("law", "regulation"), ("case_law",), ("article",), ("other",))}
    opens = F.coalesce(*(F.when(F.col("kind").isin(*kinds), found) for kinds, found in at.items()), F.array().cast("array<int>"))
    ends = F.concat(F.slice("opens", 2, F.greatest(F.size("opens"), F.lit(1))), F.array(F.size("lines")))
    rows = texts.select(*keys, "kind", bare.alias("lines")).withColumn("opens", opens).withColumn("spans", F.arrays_zip("opens", ends.alias("ends")))
    # of other kinds, what comes before the first header
    before = F.coalesce(F.get("opens", F.lit(0)), F.size("lines"))
    main = F.when((F.col("kind") == "other") & (before > 0), F.array(F.struct(F.lit(0).cast("long").alias("section"), F.lit("MAIN").alias("title"), F.array_join(F.slice("lines", 1, before), "\n").alias("content"))))
    content = lambda s: F.array_join(F.slice("lines", s["opens"] + 2, s["ends"] - s["opens"] - 1), "\n")
    headed = F.transform(F.filter("spans", lambda s: s["opens"].isNotNull()), lambda s, k: F.struct((k + 1).cast("long").alias("section"), F.get("lines", s["opens"]).alias("title"), content(s).alias("content")))
    found = F.concat(F.coalesce(main, F.array().cast("array<struct<section:bigint,title:string,content:string>>")), headed)
    each = rows.select(*keys, "kind", F.size("opens").alias("last"), F.explode(found).alias("s"))
    return each.where((F.col("s.content") != "") | (F.col("s.section") < F.col("last"))).select(*keys, "kind", "s.section", "s.title", "s.content")


def law_articles(text: Column) -> Column:
    """struct(number, title) of every article."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(LAW_ARTICLE), F.lit(1)).alias("number"), F.transform(F.regexp_extract_all(text, F.lit(LAW_ARTICLE), F.lit(2)), lambda x: F.trim(x)).alias("title"))


def clauses(text: Column) -> Column:
    """struct(number, content) of every numbered clause."""
    return F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(1)), lambda x: F.trim(x)).alias("number"), F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(2)), lambda x: F.trim(x)).alias("content"))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATED), F.lit(1))


def parties(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARTY), F.lit(1))


def years_cited(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(YEAR_CITED), F.lit(0))
