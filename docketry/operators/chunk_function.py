"""The chunker as a table function of SQL: SELECT * FROM chunk_laws(TABLE(lines), most => 12000).

The table argument has a row a line (law, pos, line). The function asks Spark for its partitioning (by law, whatever its type) and order
(by pos) itself, holds one article at a time, and gives out an article's chunks as soon as the next one begins. Rows are those of
`chunking.chunk_law`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from docketry.operators.chunking import ARTICLE_LINE, CHAPTER_LINE, LEAST_CHARS, SPLIT_CHARS

_SPACE = " \t\n\x0b\f\r"
#: The boundaries of `chunking`; their ends are those of Java, which knows more line ends.
_ARTICLE, _CHAPTER = (re.compile(x.replace("(.", "([^\n\r\x85  ]"), re.ASCII) for x in (ARTICLE_LINE, CHAPTER_LINE))
_NO_TITLE = re.compile(r"\d|[\dIVX]+[.\s]", re.ASCII)
_BLANK = re.compile(rf"\n[{_SPACE}]*\n")


def pack(text: str, most: int) -> list[str]:
    """Paragraphs joined up to `most` characters (two more counted for each); what is longer still is cut."""
    if len(text) <= most:
        return [text]
    held, size, out = [], 0, []
    for paragraph in _BLANK.split(text):
        if held and size and size + len(paragraph) + 2 > most:
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(paragraph)
        size += len(paragraph) + 2
    out.append("\n\n".join(held))
    return [part[k : k + most] for part in out for k in range(0, max(1, len(part)), most)]


class _Article:
    """The article that is being read."""

    def __init__(self, number: str, title: str | None, chapter: str | None, line: str) -> None:
        self.number, self.inline_title, self.chapter, self.lines = number, title, chapter, [line]

    def title(self) -> str:
        if self.inline_title is not None:
            return self.inline_title
        line = next(filter(None, (x.strip(" ") for x in self.lines[1:4])), "")
        return line if 3 <= len(line) <= 80 and "." not in line[:-1] and not _NO_TITLE.match(line) else ""


class ChunkLaws:
    """A law's lines in, its chunks out."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("chunk_laws takes a table of law, pos, line")
        types = {f.name: f.dataType for f in lines.dataType.fields}
        if missing := {"law", "pos", "line"} - types.keys():
            raise ValueError(f"chunk_laws misses columns {sorted(missing)}")
        names = ("number", "title", "chapter", "chunk_id", "chunk_type", "content")
        schema = StructType([StructField("law", types["law"]), *(StructField(n, StringType()) for n in names)])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("law")], orderBy=[OrderingColumn("pos")])

    def __init__(self) -> None:
        self.article: _Article | None = None
        self.chapter: str | None = None
        self.law, self.section, self.before, self.most = None, 0, None, SPLIT_CHARS

    def eval(self, row, most: int = SPLIT_CHARS) -> Iterator[tuple]:
        self.law, self.most = row["law"], most
        line = row["line"] or ""
        if chapter := _CHAPTER.match(line):
            self.chapter = chapter[1]
        if header := _ARTICLE.match(line):
            yield from self._chunks()
            self.article = _Article(header[1], header[2] or None, self.chapter, line)
        elif self.article is not None:
            self.article.lines.append(line)

    def terminate(self) -> Iterator[tuple]:
        yield from self._chunks()

    def _chunks(self) -> Iterator[tuple]:
        article, self.article = self.article, None
        content = "\n".join(article.lines).strip(_SPACE) if article else ""
        if len(content) < LEAST_CHARS:
            return
        number = int(article.number)
        if self.before is not None and number <= self.before:
            self.section += 1
        self.before = number
        parts = pack(content, self.most)
        name = re.sub(r"[^\w-]", "_", str(self.law)) + (f"_d{self.section}" if self.section else "") + f"_art{article.number}"
        for k, part in enumerate(parts):
            yield self.law, article.number, article.title(), article.chapter or "", name + (f"_p{k}" if len(parts) > 1 else ""), "article_part" if len(parts) > 1 else "article", part


def register(spark: SparkSession, name: str = "chunk_laws") -> None:
    spark.udtf.register(name, F.udtf(ChunkLaws))


def chunk_lines(lines: DataFrame, most: int = SPLIT_CHARS) -> DataFrame:
    """The chunks of lines(law, pos, line), through SQL."""
    spark = lines.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM chunk_laws(TABLE(SELECT law, pos, line FROM {lines}), most => {most})", lines=lines, most=most)
