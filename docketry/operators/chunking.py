"""Structured texts into addressable articles, as relational steps over lines: no regex offsets, no per-document loops.

A law's lines are exploded with their positions; boundaries are flagged; windows partitioned by law give extents, chapters
(as-of: the last one begun), section numbers and chunk ids. Laws are independent, so the work spreads over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import trimmed

# Boundaries, and sizes in characters.
ARTICLE_LINE = r"(?i)^\s*Neni\s+(\d{1,4})\s*(?:[.\-–—:]\s*(.{1,80}?))?\s*$"
CHAPTER_LINE = r"(?i)^\s*Kreu\s+([IVXLCDM]+|\d+)\b\s*(.*)$"
LEAST_CHARS, SPLIT_CHARS = 50, 12_000


def lines_of(laws: DataFrame) -> DataFrame:
    """(law, pos, line) with the boundaries that begin on it."""
    lines = laws.select("law", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number, chapter = F.regexp_extract("line", ARTICLE_LINE, 1), F.regexp_extract("line", CHAPTER_LINE, 1)
    return lines.withColumns({"number": F.nullif(number, F.lit("")), "inline_title": F.nullif(F.regexp_extract("line", ARTICLE_LINE, 2), F.lit("")), "chapter": F.nullif(chapter, F.lit(""))})


def strip_header(laws: DataFrame) -> DataFrame:
    """(law, body): each text from its first article or chapter on; a text without either is all body. No row leaves its place."""
    lines = F.split("text", "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(ARTICLE_LINE) | x.rlike(CHAPTER_LINE)), True)
    return laws.select("law", F.when(first > 1, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(F.col("text")).alias("body"))


def is_title(line: Column) -> Column:
    return F.length(line).between(3, 80) & ~F.substring(line, 1, F.length(line) - 1).contains(".") & ~line.rlike(r"^\d") & ~line.rlike(r"^[\dIVX]+[.\s]")


def pack_paragraphs(text: Column, most: int = SPLIT_CHARS) -> Column:
    """Paragraphs joined greedily up to `most` characters (two more counted for each); what is longer still is cut."""
    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p) + 2
        full = (acc["size"] + n > most) & (acc["size"] > 0)
        return F.when(full, F.struct(F.concat(acc["parts"], F.array(acc["now"])).alias("parts"), p.alias("now"), n.alias("size"))).otherwise(F.struct(acc["parts"].alias("parts"), F.when(acc["size"] == 0, p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)).alias("now"), (acc["size"] + n).alias("size")))

    packed = F.aggregate(F.split(text, r"\n\s*\n"), empty, step, lambda a: F.concat(a["parts"], F.array(a["now"])))
    cut = F.flatten(F.transform(packed, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / most) - 1, F.lit(0)).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)


def articles(laws: DataFrame) -> DataFrame:
    """(law, start, number, title, chapter, content): one row an article, too short ones dropped."""
    in_order = Window.partitionBy("law").orderBy("pos")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines_of(laws).withColumns({"art": F.sum(F.col("number").isNotNull().cast("int")).over(upto), "in_chapter": F.last("chapter", True).over(upto)})
    body = lines.where("art > 0")
    parts = body.groupBy("law", "art").agg(
        F.min("pos").alias("start"),
        F.max("number").alias("number"),
        F.max("inline_title").alias("inline_title"),
        F.min_by("in_chapter", "pos").alias("chapter"),
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"),  # collected once, read twice
    )
    parts = parts.withColumns({"content": F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "trimmed": F.transform(F.slice("lines", 1, 4), lambda x: F.trim(x["line"]))})
    next_line = F.get(F.filter(F.slice("trimmed", 2, 3), lambda s: s != ""), F.lit(0))
    title = F.coalesce(F.col("inline_title"), F.when(is_title(next_line), next_line), F.lit(""))
    return parts.withColumns({"title": title, "content": trimmed(F.col("content")), "chapter": F.coalesce("chapter", F.lit(""))}).where(F.length("content") >= LEAST_CHARS).select("law", "start", "number", "title", "chapter", "content")


def with_sections(rows: DataFrame) -> DataFrame:
    """A law may hold several texts: the section goes up where article numbers don't."""
    w = Window.partitionBy("law").orderBy("start")
    n = F.col("number").cast("int")
    return rows.withColumn("drop", F.coalesce((n <= F.lag(n).over(w)).cast("int"), F.lit(0))).withColumn("section", F.sum("drop").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("drop")


def safe_id(law: Column) -> Column:
    return F.regexp_replace(law, r"(?U)[^\w-]", "_")


def chunk_name(law: Column, section: Column, number: Column, part: Column, parts: Column) -> Column:
    """The chunk's id: law, section where there are several, article, and part where it was cut."""
    return F.concat(safe_id(law), F.when(section > 0, F.concat(F.lit("_d"), section)).otherwise(""), F.lit("_art"), number, F.when(parts > 1, F.concat(F.lit("_p"), part)).otherwise(""))


def chunk_law(laws: DataFrame, most: int = SPLIT_CHARS) -> DataFrame:
    """(law, number, title, chapter, chunk_id, chunk_type, content) of laws(law, text)."""
    rows = with_sections(articles(laws)).withColumn("parts", pack_paragraphs(F.col("content"), most))
    exploded = rows.select("*", F.posexplode("parts").alias("part", "piece"), F.size("parts").alias("n"))
    many = F.col("n") > 1
    name = chunk_name(*map(F.col, ("law", "section", "number", "part", "n")))
    return exploded.select("law", "number", "title", "chapter", name.alias("chunk_id"), F.when(many, "article_part").otherwise("article").alias("chunk_type"), F.col("piece").alias("content"))
