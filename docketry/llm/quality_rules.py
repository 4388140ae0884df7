"""Quality rules: counts that any text must satisfy, then gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled rows (TRAIN_ROWS), with monotonic constraints: more symbols, repeated
lines, repeated words or capitals never raise a document's quality. A grown ensemble is a few numpy node arrays (feature,
threshold, children, value), and scoring walks all rows of a batch down all trees at once.

Rows without doc_id are no documents. Null texts have no words and fail the base rule, as empty ones do. Repeated rows get one verdict each. Without labels
of both classes the trees are empty and the base rule decides alone. A very long text is counted whole. Columns other than doc_id and text
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import slices, texts_of
from docketry.llm.language import held_out

#: Fixed values of the base rule.
LEAST_WORDS = 10
MOST_REPEATED = 20  # hundredths of the words
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the trees are grown on, at most.
TRAIN_ROWS = 8000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 64, 20, 1.0
KEEP_AT = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "marks", "distinct_words", "line_length")
#: -1: quality may only fall as the feature rises; 0: free.
DIRECTIONS = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0, 0])
_CAPITALS, _DIGITS, _MARKS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!?;:=/\\@^~{}\[\]_]")


def _repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in WINDOW-word windows that are found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key, span = ids.astype(np.int64), 1
    ranks = max(distinct, 1)
    out = key[:n].copy()
    for k in range(1, WINDOW):
        if ranks * distinct >= 1 << 62:
            _, out = np.unique(out, return_inverse=True)
            ranks = int(out.max()) + 1
        out = out * distinct + key[k : k + n]
        ranks *= distinct
        span += 1
    order = np.argsort(out, kind="stable")
    same = out[order][1:] == out[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, FEATURES) of a whole text."""
    data = text.encode()
    words = data.split()  # bytes: cut at \\x20 and \\x09-\\x0D alone
    n = len(words)
    solid = b"".join(words)
    word_chars = len(solid) - len(solid.translate(None, _LEADS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, n)
    repeated = _repeated_words(ids, len(known))
    chars, some = max(word_chars, 1), max(n, 1)
    capitals = len(_CAPITALS.findall(text))
    features = (np.log1p(n), word_chars / some, symbols / some, dup / max(lines, 1), repeated / some, capitals / chars, len(_DIGITS.findall(text)) / chars, len(_MARKS.findall(text)) / chars, len(known) / some, np.log1p(word_chars / max(lines, 1)))
    return (n, word_chars, symbols, dup, repeated), tuple(float(x) for x in features)


#: Bytes that begin a code point; counting them counts characters.
_LEADS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


@dataclass
class Trees:
    """Node arrays of all trees, one after the other; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of quality for every row of x."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def quality(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of a logistic loss on histogram splits. A constrained split whose children go the wrong way is refused, and
    the middle of its children bounds what lies below them, so that the ensemble is monotone."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))) if len(y) else 20.0
    if not len(y) or y.min() == y.max():
        return Trees(*(np.array(v, int) for v in (roots, feature)), np.array([]), np.array([], int), np.array([], int), np.array([]), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    score = np.full(len(y), base)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, me), (right, me)):
            column.append(v)
        value.append(RATE * float(np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high)))
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, cuts in enumerate(edges) if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS else ():
            if not len(cuts):
                continue
            b = binned[f][rows]
            lg, lh, n = (np.cumsum(np.bincount(b, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            lv, rv = (np.clip(-a / (c + RIDGE), low, high) for a, c in ((lg, lh), (total_g - lg, total_h - lh)))
            gain = -(lg * lv + (lh + RIDGE) * lv * lv / 2) - ((total_g - lg) * rv + (total_h - lh + RIDGE) * rv * rv / 2)
            v = np.clip(-total_g / (total_h + RIDGE), low, high)
            gain += total_g * v + (total_h + RIDGE) * v * v / 2
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS) | (DIRECTIONS[f] * (rv - lv) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(lv[k]), float(rv[k])))
        if best[1] is not None:
            f, k, lv, rv = best[1]
            feature[me], threshold[me] = f, float(edges[f][k])
            mid, way = (lv + rv) / 2, DIRECTIONS[f]
            under = binned[f][rows] <= k
            left[me] = node(rows[under], g, h, depth + 1, mid if way < 0 else low, mid if way > 0 else high)
            right[me] = node(rows[~under], g, h, depth + 1, mid if way > 0 else low, mid if way < 0 else high)
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        first = len(feature)
        roots.append(node(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = Trees(np.array([0]), *(np.array(c[first:]) - (first if c is left or c is right else 0) for c in (feature, threshold, left, right, value)), 0.0)
        score = score + tree.margin(x)
    return Trees(*(np.array(v) for v in (roots, feature, threshold, left, right, value)), base)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, quality of at most `rows` labelled rows that aren't held out, spread by a hash of doc_id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    return texts_of(docs).join(F.broadcast(chosen), "doc_id")  # `rows` pairs of numbers at most


def _statistics(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = [counts(t) for t in batch["text"].to_pylist()]
    return np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS)), np.array([f for _, f in found]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees grown on at most `rows` labelled rows; only their statistics come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(list(_statistics(batch)[1]), pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    sample = labelled_sample(docs, labels, rows).select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, features array<double>")
    found = sorted((r["doc_id"], r["quality"], r["features"]) for r in sample.collect())
    return grow(np.array([f for _, _, f in found]).reshape(-1, len(FEATURES)), np.array([q for _, q, _ in found], float))


def judge(docs: DataFrame, labels: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, score of every row."""
    model = fit(docs, labels) if trees is None else trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, x = _statistics(batch)
            failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])
            score = model.quality(x)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(n[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (score >= KEEP_AT)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return texts_of(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
