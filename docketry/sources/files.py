"""Files as tables: text of any bytes, and paragraphs of Word files (a zip with XML inside), a piece of a batch at a time."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.batches import pieces

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def text_files(files: DataFrame) -> DataFrame:
    """Bytes as text, invalid sequences replaced."""
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def docx_bytes(rows: DataFrame) -> DataFrame:
    """(id, content): each text as a minimal Word file, a paragraph a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text in batch["text"].to_pylist():
                body = ET.Element(f"{_W}body")
                for line in (text or "").split("\n"):
                    ET.SubElement(ET.SubElement(ET.SubElement(body, f"{_W}p"), f"{_W}r"), f"{_W}t").text = line
                root = ET.Element(f"{_W}document")
                root.append(body)
                with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
                    z.writestr("word/document.xml", ET.tostring(root))
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.binary())], ["id", "content"])

    return rows.select("id", "text").mapInArrow(run, "id long, content binary")


def _paragraphs(content: bytes | None) -> list[str]:
    """The paragraphs that aren't empty, stripped; none of what isn't a Word file."""
    try:
        root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []
    found = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return list(filter(None, found))


def docx_text(files: DataFrame) -> DataFrame:
    """(id, text): each file's paragraphs, a blank line between; empty if it can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(["\n\n".join(_paragraphs(c)) for c in batch["content"].to_pylist()], pa.string())], ["id", "text"])

    return files.select("id", "content").mapInArrow(run, "id long, text string")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(id, pos, text) of the paragraphs that aren't empty; a file that can't be opened has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            rows = []
            for key, content in zip(batch["id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows += [{"id": key, "pos": k, "text": s} for k, s in enumerate(_paragraphs(content))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("text", pa.string())]))

    return files.select("id", "content").mapInArrow(run, "id long, pos int, text string")
