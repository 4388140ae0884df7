"""Near-duplicates by similarity: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked, and
classes are the connected components of the links.

Minima of the sets under fixed hash functions only say which documents are compared: what shares all minima of a band and has a
near sketch is a candidate. In each connected class of candidates every pair is then decided by the exact counts of its
sets, unless both documents are in one class already. Texts of any length take part.

Rows without doc_id are no documents. Null and empty texts have no words: equal sets, one class. Repeated doc_ids keep all their
rows. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import components, saved, slices, texts_of
from docketry.llm.simhash import RUN, SEED, linked, with_pivots

#: What is taken as near-duplicates: sets of 5-word shingles with a Jaccard similarity of 0.8 or more.
SHINGLE, _SHARE = 5, (4, 5)
SIMILAR = _SHARE[0] / _SHARE[1]
#: Its candidates share all minima of one of 30 bands of 5 (a pair at 0.8 has none in common once in 150,000 times), and of 64
#: bits of minima at most SKETCH_RADIUS differ (at 0.8, 6.4 do on average).
BANDS, BAND_ROWS, SKETCH_RADIUS = 30, 5, 18
#: Shingles of one class that a task holds of one piece.
PIECE = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTOR, _TERM = (np.array([xxhash.xxh32_intdigest(b"%s %d" % (n, k), SEED) | o for k in range(BANDS * BAND_ROWS)], np.uint32) for n, o in ((b"factor", 1), (b"term", 0)))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (words as in simhash.fingerprint; all words of a shorter text are one)."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):  # the order of the words counts: all is mixed after each
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(values: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions of all bands."""
    low, out = (values >> np.uint64(32)).astype(np.uint32), np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1 << 12):
        out = np.minimum(out, (low[k : k + (1 << 12), None] * _FACTOR + _TERM).min(axis=0))
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, same (a digest of the shingle set), words (its size), fp (a bit of each of 64 minima) and keys (one of each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same, words, fps, keys = [], [], [], []
            for t in batch["text"]:
                found = shingle_set(t.as_py())
                low = _minima(found)
                same.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                words.append(len(found))
                fps.append(np.packbits((low[:64] * np.uint32(0x9E3779B1)) >> np.uint32(31), bitorder="little").view(np.int64)[0])
                keys.append([xxhash.xxh64_intdigest(b, k) for k, b in enumerate(map(bytes, low.reshape(BANDS, -1)))])
            columns = [np.array(same, np.uint64).view(np.int64), np.array(words, np.int64), np.array(fps, np.int64)]
            listed = pa.array(list(np.array(keys, np.uint64).reshape(len(same), BANDS).view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns), listed], ["doc_id", "same", "words", "fp", "keys"])

    return texts_of(docs).mapInArrow(run, "doc_id long, same long, words long, fp long, keys array<long>")


def exact_links(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the rows whose sets have a Jaccard similarity of SIMILAR or more, by exact counts, walked as in simhash.run_links."""
    size = np.array(list(map(len, sets)), np.int64)
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    rows = [ranks[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    mark, waiting, out = np.zeros(len(values), bool), np.arange(len(sets)), []
    while len(waiting):
        frontier, waiting = [int(waiting[0])], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            close = waiting if side is None else waiting[side[waiting] != side[at]]
            close = close[_SHARE[1] * np.minimum(size[close], size[at]) >= _SHARE[0] * np.maximum(size[close], size[at])]
            mark[rows[at]] = True
            both = np.array([np.count_nonzero(mark[rows[x]]) for x in close.tolist()], np.int64)
            mark[rows[at]] = False
            close = close[_SHARE[1] * both >= _SHARE[0] * (size[close] + size[at] - both)]
            if len(close):
                out += [(int(nodes[at]), int(x)) for x in nodes[close]]
                waiting = waiting[~np.isin(waiting, close, assume_unique=True)]
                frontier += close.tolist()
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by exact similarity within each (root, lo, hi) of rows sorted by it: one piece of a class, or two."""
    last, sets, nodes, pieces = None, [], [], []

    def done() -> pa.RecordBatch:
        side = np.array(pieces) if last[1] != last[2] else None
        found = np.array(exact_links(sets, np.array(nodes, np.int64), side), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        for key, piece, node, found in zip(zip(*(batch[c].to_pylist() for c in ("root", "lo", "hi")), strict=True), batch["piece"].to_pylist(), batch["node"].to_pylist(), batch["found"], strict=True):
            if key != last:
                if len(sets) > 1:
                    yield done()
                last, sets, nodes, pieces = key, [], [], []
            sets.append(np.frombuffer(found.as_py(), np.uint64))
            nodes.append(node)
            pieces.append(piece)
    if len(sets) > 1:
        yield done()


def _sets(docs: DataFrame) -> DataFrame:
    """Of rows (root, lo, hi, piece, node, text), the text's shingle set in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([shingle_set(t.as_py()).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["root"], batch["node"], batch["pieces"], found], ["root", "node", "pieces", "found"])

    return docs.mapInArrow(run, "root long, node long, pieces long, found binary")


def links(docs: DataFrame, run: int = RUN, piece: int = PIECE) -> DataFrame:
    """(a, b) doc_id pairs that connect all documents whose word-shingle sets have a Jaccard similarity of SIMILAR or more.

    Equal sets are one row. Rows that share the minima of a band, and whose bits of minima differ in at most SKETCH_RADIUS places,
    are candidates; these only say which documents are compared. In each connected class of candidates all sets are compared
    exactly, a piece of it or two pieces to a task.
    """
    rows = saved(_sketches(docs))
    distinct = saved(rows.groupBy("same").agg(F.min(F.struct("doc_id", "words", "fp", "keys")).alias("r")).select("same", F.col("r.doc_id").alias("node"), "r.words", "r.fp", "r.keys"))
    equal = rows.select("doc_id", "same").join(distinct.select("same", "node"), "same").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    sketches = saved(with_pivots(distinct.where("words > 0").select("fp", "node", "keys")))
    members = linked(sketches, F.col("keys"), BANDS, run, SKETCH_RADIUS)
    sized = members.join(distinct.groupBy("node").agg(F.sum("words").alias("words")), "node")
    parts = sized.groupBy("root").agg(F.ceil(F.sum("words") / piece).alias("pieces"))
    members = saved(members.join(parts, "root"))
    own = _sets(texts_of(docs).join(members, F.col("doc_id") == F.col("node")).select("root", "node", "pieces", "text"))
    own = own.withColumn("piece", F.pmod(F.xxhash64("node"), "pieces")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
    own = own.select("root", F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", "node", "found")
    verified = own.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_verify, "a long, b long")
    return equal.unionByName(verified)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those of whose class a smaller doc_id is there: one row of each class stays, all columns kept.

    Classes are the connected components of the pairs of `links`: pairs with an exact Jaccard similarity of SIMILAR or more.
    Of repeated doc_ids all rows of the one that stays are kept.
    """
    gone = components(links(docs)).where("node <> root").select("node")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["node"], "left_anti")
