"""Bytes as text when nobody says in which charset they are.

Order of proof: a byte order mark; bytes that alternate with zeros (UTF-16); what the automaton of UTF-8 accepts; then the single-byte
charsets whose tables have all the bytes, by how likely each character that the bytes would mean is after the two before it (a capital after
a full stop, not in a word), and how likely, small or capital, among the ASCII that stands near (which tells the language). Runs of three with a
character beyond ASCII, and runs of ASCII near one, are counted in Spark over texts that are known; the commonest (RUNS, PAIRS) are the model, so it is
bounded. What a text repeats is no further evidence: a run counts once a text, in learning and in telling.
Bytes that nothing accepts are read as UTF-8 with replacements; nothing fails.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.batches import pieces

SINGLE = ("windows-1252", "mac_roman", "cp850")
WIDE = ("utf-16-le", "utf-16-be")
CHARSETS = ("utf-8", *WIDE, *SINGLE)
#: Runs of three characters in the model; what stands before and after a text in it.
RUNS, EDGE = 100_000, "\n\n"
#: How far what stands near reaches; pairs of a run of three in ASCII and a letter near it in the model; how many times a run counts as seen before it is.
NEAR, PAIRS, UNSEEN = 14, 200_000, 20
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))

# The UTF-8 automaton: what may follow. States: 0 start, 1-3 so many continuation bytes, 4-7 the first of them restricted, 8 dead.
_FOLLOWS = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
_LEADS = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))


def _automaton() -> list[list[int]]:
    table = [[8] * 256 for _ in range(9)]
    for low, high, to in _LEADS:
        table[0][low : high + 1] = [to] * (high - low + 1)
    for state in (1, 2, 3):
        table[state][0x80:0xC0] = [state - 1] * 64
    for state, (low, high, to) in _FOLLOWS.items():
        table[state][low : high + 1] = [to] * (high - low + 1)
    return table


_UTF8 = _automaton()


def is_utf8(data: bytes) -> bool:
    """Only bytes beyond ASCII move the automaton out of its start, so runs of ASCII are skipped."""
    high = np.flatnonzero(np.frombuffer(data, np.uint8) > 127)
    state, after = 0, -1
    for at in high.tolist():
        if state and at != after + 1:
            return False  # ASCII where a continuation is due
        state, after = _UTF8[state][data[at]], at
        if state == 8:
            return False
    return state == 0


class Model(NamedTuple):
    """What is known of texts: runs of three characters, and runs of three in ASCII with a letter near them; in how many texts each is."""

    runs: list[tuple[str, int]]
    near: list[tuple[int, str, int]]


def learn(docs: DataFrame) -> Model:
    """The commonest runs of three characters with one beyond ASCII, and what stands near such characters."""
    runs = F.array_distinct(F.regexp_extract_all(F.concat(F.lit(EDGE), "text", F.lit(EDGE)), F.lit(r"(?s)(?=([^\x00-\x7F]..|.[^\x00-\x7F].|..[^\x00-\x7F]))"), F.lit(1)))
    counts = docs.select(F.explode(runs).alias("run")).groupBy("run").count()
    common = [(r.run, r["count"]) for r in counts.orderBy(F.desc("count"), "run").limit(RUNS).collect()]
    pairs = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    near = pairs.orderBy(F.desc("n"), "pair").limit(PAIRS).toArrow()
    return Model(common, [(pair >> 21, chr(pair & 0x1FFFFF), n) for pair, n in zip(near["pair"].to_pylist(), near["n"].to_pylist(), strict=True)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a piece a run in ASCII has a letter near it: the run's number and the small letter as one number."""
    for batch in pieces(batches, "text"):
        found = [np.zeros(0, np.int64)]
        for text in batch["text"].to_pylist():
            held = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            low = text.lower()
            small = held if low == text else np.frombuffer((low if len(low) == len(text) else "".join(map(_small, text))).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            at = _places(held)
            run = _around(held, at)
            found.append(np.unique((run << 21 | small[at][:, None])[run >= 0]))
        pair, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])


def _small(c: str) -> str:
    """The small letter, where that is one character."""
    return low if len(low := c.lower()) == 1 else c


def _places(held: np.ndarray) -> np.ndarray:
    """Where characters beyond ASCII are, of each with the same neighbours the first."""
    wide = np.pad(held, 1, constant_values=ord(EDGE[0]))
    at = np.flatnonzero(held > 127)
    return at[np.unique(wide[at] << 42 | held[at] << 21 | wide[at + 2], return_index=True)[1]]


def _around(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row a place: the numbers of the runs of three characters near it, -1 for one that isn't all ASCII."""
    wide = np.pad(held, NEAR, constant_values=128)
    plain = wide < 128
    runs = np.where(plain[:-2] & plain[1:-1] & plain[2:], wide[:-2] << 14 | wide[1:-1] << 7 | wide[2:], -1)
    return runs[at[:, None] + np.arange(2 * NEAR - 1)]


class _Counts:
    """Counts by a whole number, 0 where there is none."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.keys = np.array(sorted(counts) or [-1], np.int64)
        self.values = np.array([counts.get(k, 0) for k in self.keys.tolist()], np.float64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class Detector:
    """What charset bytes are in, by a learned model."""

    def __init__(self, model: Model) -> None:
        self.tables, self.known, self.letters = {}, {}, {}
        times, letters = {}, {}
        for run, letter, n in model.near:
            times[run], letters[letter] = times.get(run, 0) + n, letters.get(letter, 0) + n
        numbers = {letter: k for k, letter in enumerate(sorted(letters))}
        self.times, self.near = _Counts(times), _Counts({run << 21 | numbers[letter]: n for run, letter, n in model.near})
        self.share = np.array([letters[c] + 1 for c in numbers] + [1]) / max(1, sum(letters.values()))  # the last: no letter of the model
        for charset in SINGLE:
            triples, first, last = {}, {}, {}
            for run, n in model.runs:
                try:
                    a, b, c = run.encode(charset)
                except (UnicodeEncodeError, ValueError):
                    continue
                for table, key in ((triples, a << 16 | b << 8 | c), (first, a << 8 | b), (last, b << 8 | c)):
                    table[key] = table.get(key, 0) + n
            self.tables[charset] = tuple(map(_Counts, (triples, first, last)))
            known = np.zeros(256, bool)
            for byte in range(256):
                known[byte] = bytes([byte]).decode(charset, "ignore") != ""
            self.known[charset] = known
            self.letters[charset] = np.array([numbers.get(_small(bytes([byte]).decode(charset, "replace")), len(numbers)) for byte in range(256)], np.int64)

    def likelihood(self, charset: str, runs: np.ndarray, beyond: np.ndarray) -> float:
        """Of runs of three bytes, each with one beyond ASCII: how likely the third is after the first two, up to what is the same in
        every charset. `beyond`: whether one of those two is beyond ASCII (two of ASCII are as common in any charset)."""
        triples, first, last = self.tables[charset]
        pair = last[runs & 0xFFFF]
        seen = triples[runs] + 0.5 * (pair + 0.5) / (pair + 50)  # a run that wasn't seen: less than one, more for a common pair
        before = np.where(beyond, first[runs >> 8] + 10, 1.0)
        return float(np.log(seen / before).sum())

    def nearness(self, charset: str, high: np.ndarray, around: np.ndarray, times: np.ndarray) -> float:
        """How likely the letters of bytes beyond ASCII are, each among the runs `around` it (seen so many `times`): the mean of what each run says."""
        letter = self.letters[charset][high]
        share = self.share[letter][:, None]
        said = (self.near[around << 21 | letter[:, None]] + UNSEEN * share) / (times + UNSEEN)
        seen = around >= 0
        return float(np.log(np.where(seen, said, 0).sum(axis=1) / np.maximum(1, seen.sum(axis=1)), out=np.zeros(len(high)), where=seen.any(axis=1)).sum())

    def detect(self, data: bytes) -> str:
        for mark, charset in _MARKS:
            if data.startswith(mark):
                return charset
        held = np.frombuffer(data, np.uint8)
        if len(held) >= 2 and len(held) % 2 == 0:
            zeros = [float((held[k::2] == 0).mean()) for k in (0, 1)]
            if max(zeros) > 0.3 and min(zeros) < 0.05:
                return WIDE[0] if zeros[1] > zeros[0] else WIDE[1]
        if is_utf8(data):
            return "utf-8"
        fits = [c for c in SINGLE if self.known[c][held].all()]
        if not fits:
            return "utf-8"
        edge = np.frombuffer(EDGE.encode(), np.uint8)
        wide = np.concatenate([edge, held, edge]).astype(np.int64)
        high = wide > 127
        at = np.flatnonzero(high[:-2] | high[1:-1] | high[2:])
        runs, first = np.unique(wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2], return_index=True)
        beyond = (high[at] | high[at + 1])[first]
        places = _places(held.astype(np.int64))
        letters, around = held[places], _around(held.astype(np.int64), places)
        times = self.times[around]
        return max(fits, key=lambda c: (self.likelihood(c, runs, beyond) + self.nearness(c, letters, around, times), -SINGLE.index(c)))

    def decode(self, data: bytes) -> tuple[str, str]:
        """(charset, text)."""
        charset = self.detect(data)
        try:
            return charset, data.decode(charset).removeprefix("﻿")
        except UnicodeDecodeError:
            return "utf-8", data.decode("utf-8", "replace")


def decoded(files: DataFrame, detector: Detector, key: str = "path") -> DataFrame:
    """key, charset, text of files(key, content); no content is the empty text."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            found = [detector.decode(c or b"") for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([c for c, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], [key, "charset", "text"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, charset string, text string")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, charset, content: each text in the charset of its id, or in UTF-8 if that lacks a character of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                charset = CHARSETS[doc_id % len(CHARSETS)]
                try:
                    made.append((charset, (text or "").encode(charset)))
                except UnicodeEncodeError:
                    made.append(("utf-8", text.encode()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([c for c, _ in made], pa.string()), pa.array([b for _, b in made], pa.binary())], ["doc_id", "charset", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, charset string, content binary")
