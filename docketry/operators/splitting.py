"""Texts into overlapping chunks at the coarsest separator that keeps them short: paragraphs, lines, words, characters."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Separators, the coarsest first; longest chunk and overlap in characters.
SEPARATORS, SIZE, OVERLAP = ("\n\n", "\n", " ", ""), 1000, 100


def _atoms(text: str, level: int, size: int) -> Iterator[list[str]]:
    """Runs of pieces that may be joined with one another; a piece keeps the separator it begins with, and is shorter than `size` or can't be split."""
    while SEPARATORS[level] and SEPARATORS[level] not in text:
        level += 1
    separator, run = SEPARATORS[level], []
    pieces = re.split(f"(?={re.escape(separator)})", text) if len(separator) < 2 else re.split("(?=\n\n)(?<!\n)|(?<=\n\n)(?=\n\n)", text)
    for piece in filter(None, pieces if separator else list(text)):
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            yield run
            run = []
        if level + 1 < len(SEPARATORS):
            yield from _atoms(piece, level + 1, size)
        else:
            yield [piece]
    if run:
        yield run


def split(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text, in order: pieces of a run joined up to `size`, each chunk beginning with up to `overlap` characters of the last."""
    out: list[str] = []
    for run in _atoms(text, 0, size):
        held: deque[str] = deque()
        length = 0
        for piece in run:
            if held and length + len(piece) > size:
                out.append("".join(held).strip())
                while held and (length > overlap or length + len(piece) > size):
                    length -= len(held.popleft())
            held.append(piece)
            length += len(piece)
        out.append("".join(held).strip())
    return [chunk for chunk in out if chunk]


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, j, chunk) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = split(text or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["doc_id", "j", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, j int, chunk string")
