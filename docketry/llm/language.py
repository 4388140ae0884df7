"""Language identification by compression: each language has a zstandard raw-content dictionary of its own text, and a text
belongs to the language whose dictionary makes it smallest.

Texts are reduced to their words in lower case and compressed in blocks, each on its own, so that a long text is measured against the dictionary and
not against itself; all blocks of the whole text count. Where the smallest sum isn't smaller than the next by MARGIN of it,
the verdict is narrow and the document is rejected.

A dictionary is made of a bounded sample of labelled rows: SAMPLE_CELLS rows a language, one for each residue of a hash of
doc_id, PIECE bytes of each. Null texts and texts without a letter are `und` with score 0 and rejected. Rows without lang
aren't learned from. Where no row is labelled every prediction is `und`. Repeated rows get one verdict each. Of languages with the smallest
size in common the commonest is told, with score 0.5, and rejected. A very long text is compressed whole. Columns other than doc_id, text and lang are
ignored (`keep_identified` keeps them), whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import slices

SAMPLE_CELLS = 256
PIECE = 2048
BLOCK = 1024
LEVEL = 3
MARGIN = 0.003
STEEPNESS = 60.0
UNKNOWN = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """The text's words in lower case, one space between them: digits, marks and markup tell no language."""
    return _NO_LETTERS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    """Whether no label of the row may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """The text that each language's dictionary holds, from rows that aren't held out; the commonest language, which wins ties, first."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    spread = F.xxhash64("doc_id")
    cells = rows.select("lang", "doc_id", spread.alias("h")).groupBy("lang", F.pmod("h", F.lit(SAMPLE_CELLS)).alias("cell")).agg(F.min(F.struct("h", "doc_id")).alias("first"), F.count("*").alias("rows"))
    # at most SAMPLE_CELLS rows a language
    chosen = F.broadcast(cells.select("lang", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), "rows"))
    sample = rows.select("lang", "doc_id", "text").join(chosen, ["lang", "doc_id"]).select("lang", "h", "rows", F.substring("text", 1, PIECE).alias("piece")).distinct()
    parts: dict[str, list[str]] = {}
    rows: dict[str, int] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        parts.setdefault(row["lang"], []).append(letters(row["piece"]))
        rows[row["lang"]] = rows.get(row["lang"], 0) + row["rows"]
    common = sorted(parts, key=lambda lang: (-rows[lang], lang))
    return {lang: "\n".join(parts[lang]).encode() for lang in common}


class Scorer:
    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = list(texts)
        self.compressors = []
        for lang in self.langs:
            words = zstandard.ZstdCompressionDict(texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = letters(text).encode()
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        return self.langs[order[0]], 1 - math.exp(-STEEPNESS * margin) / 2, margin < MARGIN


def identify(docs: DataFrame, learned: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row with a doc_id."""
    texts = dictionaries(docs) if learned is None else learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(texts)
        for batch in slices(batches):
            langs, scores, rejected = zip(*map(scorer.score, batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is told; all their columns stay as they are."""
    texts = dictionaries(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(texts)
        for batch in slices(batches):
            yield batch.filter(pa.array([not scorer.score(t)[2] for t in batch["text"].to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
