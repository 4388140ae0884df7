"""Fill-in-the-middle: a text is cut at two places between its units, and the middle moves to the end.

A unit is a word with the white space before it, or white space that no word follows. The matcher runs twice over a text and
keeps nothing: the first pass counts the units, the second advances a lazy iterator to the two ranks that are drawn and
notes where it stands; the pieces are then cut from the text itself. Draws depend on the seed and doc_id alone, so a row has the
same cut wherever it is processed. `restored` takes an output apart at its marks (no piece holds one, since texts with marks
stay plain, and no piece can run into a mark, since marks don't overlap themselves).

Rows without doc_id are no documents. A null text is empty; empty texts, and texts that hold a mark, stay plain. A very long
text needs no more than itself and its output. A text of white space alone is one unit. Repeated rows are transformed each by
itself, alike; an empty table gives no rows. Both ranks may be equal (an empty middle) or at an end (an empty prefix or suffix).
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import slices, texts_of

SEED = 42
#: Percent of the texts that are transformed, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def draws(doc_id: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4]) for at in (0, 4, 8, 12))


def count_units(text: str) -> int:
    """First pass."""
    return sum(1 for _ in _UNIT.finditer(text))


def offsets(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` and the first `high` units end."""
    units = _UNIT.finditer(text)
    first = next(islice(units, low - 1, None)).end() if low else 0
    return first, next(islice(units, high - low - 1, None)).end() if high > low else first


def cut(doc_id: int, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    n = count_units(text)
    one, two, whether, order = draws(doc_id, seed)
    if not text or whether % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = offsets(text, low, high)
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [cut(d, t, seed, rate, suffix_first) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            n, form, before, middle, output = zip(*made, strict=True) if made else ((),) * 5
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """`transform` with digests in place of the output, and of the text that is rebuilt from it."""
    text = restored(F.col("output"), F.col("form"))
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256")
    )


#: The same rows from DuckDB, which keeps lists of units where the operator keeps none.
SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents WHERE doc_id IS NOT NULL),
e AS (
    SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
p AS (
    SELECT *, array_to_string(units[1:least(one, two)], '') AS p, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS m,
           array_to_string(units[greatest(one, two) + 1:], '') AS s
    FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
