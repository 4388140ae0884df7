"""Text as Column expressions: folding, tokens, garble, cleaning, paragraphs."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketry.functions.batches import pieces

# Words that retrieval ignores, and the token pattern.
STOPWORDS = (
    "dhe ose por se që qe këtë kete këtu ketu kjo ky këto keto këta keta një nje nuk është eshte janë jane kanë kane ka kishte ku si kur "
    "për per me në ne nga i e të te së se u u' po do duhet mund më me vetëm vetem këtij ketij kësaj kesaj këtyre ketyre "
    "ligji ligjit ligjin ligje ligjet neni nenit nenin nenet neneve"
).split()
TOKEN = r"[A-Za-zëçËÇ]+|[0-9]+"
LEAST_LETTERS = 3
GARBLE_LEAST_WORDS = 15


def fold_text(s: str) -> str:
    return s.lower().replace("ë", "e").replace("ç", "c")


FOLDED_STOPWORDS = sorted({fold_text(w) for w in STOPWORDS})


def fold(c: Column) -> Column:
    """Lower case without the two diacritics; the length stays."""
    return F.translate(F.lower(c), "ëç", "ec")


def tokens(c: Column) -> Column:
    """Folded tokens, of three characters or more unless digits, without stopwords; repeats stay."""
    # the whole text is folded once; runs of fewer letters aren't even taken out
    found = F.regexp_extract_all(fold(c), F.lit(f"[a-z]{{{LEAST_LETTERS},}}|[0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(FOLDED_STOPWORDS))


def trimmed(c: Column) -> Column:
    """Without white space at either end, of every kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def corrupt_token(t: Column) -> Column:
    """Characters that only bad scans have, or a digit between letters unless the token is a number with a slash or dash."""
    return t.rlike(r"[€{}|]") | (~t.rlike(r"[/-]") & t.rlike(r"\p{L}[0-9]\p{L}"))


def garble_ratio(c: Column) -> Column:
    """Share of words with a letter that are corrupt; 0 for texts of few words."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    n = F.size(words)
    return F.when(n < GARBLE_LEAST_WORDS, 0.0).otherwise(F.size(F.filter(words, corrupt_token)) / n)


def normalize_ocr(c: Column) -> Column:
    """Dot leaders, long runs of fill characters and wide gaps."""
    c = F.regexp_replace(c, r"[ \t]*\.(?:[ \t]*\.){3,}[ \t]*", " ")
    c = F.regexp_replace(c, r"([-_=•·~])\1{4,}", " ")
    return F.regexp_replace(c, r"[ \t]{3,}", "  ")


def strip_toc(c: Column) -> Column:
    """Without lines that have leaders of four dots or more."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.contains("....")), "\n")


# Control characters, addresses, lines of marks alone.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ADDRESS = r"https?://(?:[a-zA-Z0-9$-_@.&+!*(),]|%[0-9a-fA-F][0-9a-fA-F])+"
MARKS_ALONE = r"^[\s.,;:!?]*$"


def clean_text(c: Column) -> Column:
    """Without control characters, white space collapsed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, CONTROL, ""), r"(?U)\s+", " "))


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """A piece of a batch at a time."""
    out = [pa.array((t and unicodedata.normalize("NFKC", t) for t in piece["t"].to_pylist()), pa.string()) for piece in pieces([pa.RecordBatch.from_arrays([texts], ["t"])], "t")]
    return pa.concat_arrays(out)


def compatible(c: Column) -> Column:
    """NFKC, which the engine has no expression for; texts of ASCII alone are so already, and don't leave it."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def preprocess(c: Column) -> Column:
    """NFKC, without control characters and addresses, white space collapsed; nothing if only marks are left."""
    c = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(compatible(c), CONTROL, ""), ADDRESS, ""), r"(?U)\s+", " "))
    return F.when(c.rlike(MARKS_ALONE), "").otherwise(c)


def paragraphs(c: Column, least: int) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), clean_text), lambda p: F.length(p) >= least)


def windows(c: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each beginning `overlap` before the last one's end."""
    step = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.length(c) - overlap) / step) - 1, F.lit(0)).cast("int")), lambda k: F.substring(c, k * step + 1, F.lit(size)))
