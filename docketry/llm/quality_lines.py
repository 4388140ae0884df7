"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are its own character statistics and those of the lines before and after it; the chain's weights join
neighbouring labels. Marginals come from the forward-backward pass, and a document's quality is the mean marginal of its
lines, weighted by their length, put on the scale of the labels by a logistic curve.

Only documents are labelled, so the lines' labels are latent: the field's weights and the curve are learned together, by the
likelihood of the documents' labels under the curve of their mean marginals. A document of good and bad lines may be bad as a whole
without its good lines being so. The sample is bounded: TRAIN_ROWS labelled documents, of each a run of at most TRAIN_LINES
lines; the lines' features are computed by the executors, and only these numbers come to the driver.

Null and empty texts are one empty line and are scored like any other; a very long text is scored whole. Repeated rows are scored each.
Rows without doc_id aren't scored; `keep_good` judges them by their text. Columns other than doc_id and text are ignored, and kept
by `keep_good` whatever their names. Without labels of both classes every score is 1. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import slices
from docketry.llm.language import held_out
from docketry.llm.quality_rules import labelled_sample

#: Labelled documents that the field is trained on, at most, and lines of each.
TRAIN_ROWS, TRAIN_LINES = 3000, 32
STEPS, RATE, RIDGE, CHAIN_RIDGE, NUDGE = 200, 0.1, 1e-3, 1e-2, 1e-3
GOOD_AT = 0.7

_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "symbol": [*b"#*$%&|<>"],
    "mark": [*b"!?;:=/\\@^~{}[]_"],
    "stop": [*b".,'\"-()"],
    "space": [32, *range(9, 14)],
    "high": [*range(128, 256)],
}
OWN = len(_CLASSES) + 5
FEATURES = 3 * OWN + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes and one, number of lines of each text) of all lines of the texts."""
    parts = [t.encode().split(b"\n") for t in texts]
    n = np.array([len(p) for p in parts])
    lines = [line for p in parts for line in p]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    buffer = np.frombuffer(b"\n".join(lines), np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    own = np.zeros((len(lines), OWN))
    some = np.maximum(lengths, 1)
    for k, codes in enumerate(_CLASSES.values()):
        flags = np.zeros(256, np.uint8)
        flags[codes] = 1
        total = np.concatenate(([0], np.cumsum(flags[buffer], dtype=np.int64)))
        own[:, k] = (total[starts + lengths] - total[starts]) / some
    k = len(_CLASSES)
    own[:, k] = np.log1p(lengths) / 6
    own[:, k + 1] = lengths == 0
    at = 0
    for p in parts:
        seen: set[bytes] = set()
        for j, line in enumerate(p, at):
            words = line.split()
            if words:
                own[j, k + 2] = line in seen
                own[j, k + 3] = 1 - len(set(words)) / len(words)
                own[j, k + 4] = max(0, len(words) - 60) / len(words)
                seen.add(line)
        at += len(p)
    first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.empty(0, int)
    last = np.cumsum(n) - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack((own, before, after, np.ones((len(lines), 1)))), lengths + 1.0, n


@dataclass
class Field:
    weights: np.ndarray  # of the features, for good against bad
    chain: np.ndarray  # of neighbouring labels
    slope: float
    offset: float

    def marginals(self, x: np.ndarray, n: np.ndarray, shift: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of good for each line, expected counts of neighbouring labels, log partition) of the chains; `shift` is
        added to each line's weight of good."""
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ self.weights + shift
        first = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        m, first = n[order], first[order]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        longest = int(m[0]) if len(m) else 0
        active = [int(np.searchsorted(-m, -t, "left")) for t in range(longest)]  # chains with more than t lines
        for t in range(longest):
            at = first[: active[t]] + t
            alpha[at] = e[at] + (np.logaddexp(alpha[at - 1, :1] + self.chain[0], alpha[at - 1, 1:] + self.chain[1]) if t else 0)
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            ahead = e[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(ahead[:, :1] + self.chain[:, 0], ahead[:, 1:] + self.chain[:, 1])
        z_first = np.logaddexp(*(alpha[first + m - 1].T)) if len(m) else np.empty(0)
        z = np.empty(len(x))
        place = np.repeat(np.arange(len(m)), m)
        z[np.repeat(first, m) + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)] = z_first[place]
        good = np.exp(alpha[:, 1] + beta[:, 1] - z)
        inner = np.ones(len(x), bool)
        inner[first] = False  # lines with one before them
        at = np.flatnonzero(inner)
        pairs = np.array([[np.exp(alpha[at - 1, a] + self.chain[a, b] + e[at, b] + beta[at, b] - z[at]).sum() for b in (0, 1)] for a in (0, 1)])
        return np.clip(good, 0, 1), pairs, float(z_first.sum())

    def documents(self, texts: list[str]) -> np.ndarray:
        """The quality of each text, from 0 to 1."""
        x, length, n = line_features(texts)
        return self.scaled(aggregate(self.marginals(x, n)[0], length, n))

    def scaled(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.offset)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def aggregate(good: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines of each document."""
    first = np.cumsum(n) - n
    return np.add.reduceat(good * length, first) / np.add.reduceat(length, first) if len(n) else np.empty(0)


def train(x: np.ndarray, length: np.ndarray, n: np.ndarray, quality: np.ndarray) -> Field:
    """Maximum likelihood of the documents' labels by Adam. How a document's likelihood moves with the weights of its lines is how their
    marginals move when every line is shifted by its share in it, as covariances are symmetric: two more passes a step."""
    if not len(quality) or quality.min() == quality.max():
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 30.0)
    first = np.cumsum(n) - n
    share = length / np.repeat(np.add.reduceat(length, first), n)
    theta = np.concatenate((np.zeros(FEATURES + 4), (2.0, 0.0)))
    ridge = np.concatenate((np.full(FEATURES, RIDGE), np.full(4, CHAIN_RIDGE), np.zeros(2)))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    field = Field(theta[:FEATURES], theta[FEATURES:-2].reshape(2, 2), 1.0, 0.0)
    for step in range(1, STEPS + 1):
        field.weights, field.chain, field.slope, field.offset = theta[:FEATURES], theta[FEATURES:-2].reshape(2, 2), float(theta[-2]), float(theta[-1])
        whole = aggregate(field.marginals(x, n)[0], length, n)
        miss = quality - field.scaled(whole)
        s = np.clip(whole, 1e-4, 1 - 1e-4)
        pull = NUDGE * share * np.repeat(miss * field.slope / (s * (1 - s)), n)
        (up, pairs_up, _), (down, pairs_down, _) = field.marginals(x, n, pull), field.marginals(x, n, -pull)
        gradient = np.concatenate((x.T @ (up - down) / (2 * NUDGE), (pairs_up - pairs_down).ravel() / (2 * NUDGE), (miss @ _logit(whole), miss.sum()))) / len(n) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta[-2] = max(theta[-2], 0.1)
    field.weights, field.chain, field.slope, field.offset = theta[:FEATURES], theta[FEATURES:-2].reshape(2, 2), float(theta[-2]), float(theta[-1])
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """The field of at most `rows` labelled documents, of whose lines the executors send the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, length, n = line_features(batch["text"].to_pylist())
            ends = np.cumsum(n)
            lines, lengths = [], []
            for doc, m, end in zip(batch["doc_id"].to_pylist(), n.tolist(), ends.tolist(), strict=True):
                skip = zlib.crc32(str(doc).encode()) % max(1, m - TRAIN_LINES + 1)
                own = slice(end - m + skip, min(end, end - m + skip + TRAIN_LINES))
                lines.append(x[own].astype("<f4").tobytes())
                lengths.append(length[own].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(lines, pa.binary()), pa.array(lengths, pa.binary())], ["doc_id", "quality", "x", "length"])

    sample = labelled_sample(docs, labels, rows).select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary, length binary")
    found = sorted((r["doc_id"], r["quality"], bytes(r["x"]), bytes(r["length"])) for r in sample.collect())  # at most rows x TRAIN_LINES lines
    x = np.frombuffer(b"".join(f for _, _, f, _ in found), "<f4").reshape(-1, FEATURES).astype(np.float64)
    length = np.frombuffer(b"".join(f for _, _, _, f in found), "<f4").astype(np.float64)
    return train(x, length, np.array([len(f) // 4 for _, _, _, f in found], np.int64), np.array([q for _, q, _, _ in found], float))


def score(docs: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row with a doc_id."""
    model = fit(docs, labels) if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.documents(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= GOOD_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are predicted good; all their columns stay as they are."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.documents([t or "" for t in batch["text"].to_pylist()]) >= GOOD_AT))

    return docs.mapInArrow(run, docs.schema)
