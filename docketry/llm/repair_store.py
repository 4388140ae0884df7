"""Token-id output: ids of whole texts in shards compressed by a Re-Pair grammar, in ascending doc_id order.

A shard is one row of a Parquet table in the shared folder: the documents' ids, the symbols of each document, the rules
(pairs of symbols that a nonterminal stands for) and every rule's expansion length. Frequent pairs within a document are
replaced by nonterminals round after round, the most frequent pairs of a round together: those within a STEP of the commonest,
if they are used LEAST_USES times or more, below which a rule takes more bytes than it saves. Rounds end when no pair is left that
gains (uses that overlap, as in a run of one symbol, count once), when a round takes less than LEAST_SHARE of the symbols away, or when the
numbers of 16 bits are used up: 15,278 beside the vocabulary, which on a full shard is what ends the grammar. The expansion lengths
let a reader skip to any id of any document without expanding what comes before it.

Rows without doc_id are no documents. Null texts are empty; an empty document holds its end id alone. Repeated doc_ids keep all their rows. A very
long text fills a shard of its own, whole. An empty table gives an empty store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.byte_bpe import BATCH, END_ID, byte_bpe, default_vocabulary
from docketry.llm.common import slices, stored, texts_of

VOCABULARY = 50_257
SHARD_IDS = 1 << 20
#: A rule takes 8 bytes (two symbols, its length) and each use saves 2.
LEAST_USES = 5
STEP = 16
LEAST_SHARE = 0.003
_NO_PAIR = np.uint32(0xFFFFFFFF)
_TABLE_BITS = 20


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - _TABLE_BITS)


def _frequent(codes: np.ndarray, slot: np.ndarray, most: int) -> np.ndarray:
    """The pairs of a round, most frequent first (ties: the smaller number); of those that share a slot, the first."""
    often = np.bincount(slot, minlength=1 << _TABLE_BITS).astype(np.int32)
    ordered = np.sort(codes[often[slot] >= LEAST_USES])  # rarer pairs aren't even sorted
    ordered = ordered[: np.searchsorted(ordered, _NO_PAIR)]
    if not len(ordered):
        return ordered
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    n = np.diff(np.append(start, len(ordered)))
    take = np.flatnonzero(n >= max(LEAST_USES, int(n.max()) // STEP))
    chosen = ordered[start[take[np.argsort(-n[take], kind="stable")][:most]]]
    return chosen[np.sort(np.unique(_slot(chosen), return_index=True)[1])]


def _every_other(at: np.ndarray) -> np.ndarray:
    """Which places to keep so that no two are neighbours: of each run of neighbours the first, the third and so on."""
    run = np.concatenate(([True], np.diff(at) != 1))[: len(at)]
    return (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0


def compress(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, number of symbols of each document, rules) of the documents' ids; a rule k stands for VOCABULARY + k."""
    counts = np.array([len(d) for d in docs], np.int64)
    symbols = np.concatenate(docs).astype(np.uint16) if len(docs) else np.empty(0, np.uint16)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules = [np.empty((0, 2), np.uint16)]
    done = 0
    while len(symbols) > 1:
        codes = (symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:]
        codes[last[:-1]] = _NO_PAIR
        again = np.flatnonzero(codes[1:] == codes[:-1]) + 1  # within a run of one symbol, whose pairs overlap
        codes[again[_every_other(again)]] = _NO_PAIR
        slot = _slot(codes)
        for most in ((1 << 16) - 1 - VOCABULARY - done, 1):  # where pairs that overlap take each other's uses, the commonest alone
            chosen = _frequent(codes, slot, most)
            table = np.full(1 << _TABLE_BITS, -1, np.int32)
            table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
            rule = table[slot]
            hit = np.flatnonzero(rule >= 0)
            hit = hit[codes[hit] == chosen[rule[hit]]]
            hit = hit[_every_other(hit)]
            which = rule[hit]
            gains = np.bincount(which, minlength=len(chosen)) >= LEAST_USES
            if gains.any() or most < 1:
                break
        if not gains.any():
            break
        hit, which = hit[gains[which]], (np.cumsum(gains) - 1)[which[gains[which]]]
        symbols[hit] = (VOCABULARY + done + which).astype(np.uint16)
        last[hit] = last[hit + 1]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, last = symbols[keep], last[keep]
        new = chosen[gains]
        rules.append(np.stack((new >> np.uint32(16), new & np.uint32(0xFFFF)), 1).astype(np.uint16))
        done += len(new)
        if len(hit) < LEAST_SHARE * len(keep):
            break
    held = np.zeros(len(docs), np.int64)
    held[counts > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return symbols, held, np.concatenate(rules)


def lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule's nonterminal expands to."""
    out = [1] * VOCABULARY
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[VOCABULARY:], np.int64)


_BASE = [k.to_bytes(2, "little") for k in range(VOCABULARY)]


def expansions(rules: np.ndarray) -> list[bytes]:
    """The ids of every symbol, as little-endian 16-bit integers."""
    out = list(_BASE)
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return out


class Shard:
    """Random access to one row of the store."""

    def __init__(self, row: dict) -> None:
        self.rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
        self.symbols = np.frombuffer(row["symbols"], "<u2")
        self.ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
        self.lengths = np.concatenate((np.ones(VOCABULARY, np.int64), np.frombuffer(row["rule_lengths"], "<u4")))
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.expanded: list[bytes] | None = None

    def _symbols(self, k: int) -> np.ndarray:
        return self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]

    def document(self, k: int) -> bytes:
        """All ids of the shard's document k."""
        if self.expanded is None:
            self.expanded = expansions(self.rules)
        return b"".join(map(self.expanded.__getitem__, self._symbols(k).tolist()))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of the shard, one after the other; where each ends)."""
        if self.expanded is None:
            self.expanded = expansions(self.rules)
        start = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[self.symbols]
        ends = np.cumsum(n)
        pool = np.frombuffer(b"".join(self.expanded), "<u2")
        ids = pool[np.repeat(start[self.symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[self.ends]

    def part(self, k: int, start: int, stop: int) -> list[int]:
        """Ids start to stop of document k; only symbols that reach into them are expanded."""
        symbols, out = self._symbols(k), []
        ends = np.cumsum(self.lengths[symbols])
        stop = min(stop, int(ends[-1]))
        if start >= stop:
            return out
        i = int(np.searchsorted(ends, start, "right"))
        at = int(ends[i] - self.lengths[symbols[i]])
        while at < stop:
            stack = [int(symbols[i])]
            while stack:
                s = stack.pop()
                n = int(self.lengths[s])
                if at + n <= start or at >= stop:
                    at += n
                elif s < VOCABULARY:
                    out.append(s)
                    at += 1
                else:
                    a, b = self.rules[s - VOCABULARY].tolist()
                    stack += [b, a]
            i += 1
        return out


_STORE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_symbols", pa.binary()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])
_STORE_SQL = "part int, shard int, ids_before long, n_ids long, doc_ids binary, doc_symbols binary, rules binary, rule_lengths binary, symbols binary"


def write_store(docs: DataFrame, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text, append END_ID to each document, and store the ids; returns the store as read back."""
    path = vocabulary or default_vocabulary()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(path), TaskContext.get().partitionId()
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        held = before = shard = 0

        def row() -> pa.RecordBatch:
            symbols, counts, rules = compress(ids)
            values = [part, shard, before, held, np.array(doc_ids, "<i8").tobytes(), counts.astype("<u4").tobytes(), rules.astype("<u2").tobytes(), lengths(rules).astype("<u4").tobytes(), symbols.astype("<u2").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _STORE, strict=True)], schema=_STORE)

        end = np.array([END_ID], np.uint16)
        for batch in slices(batches, BATCH):
            for doc_id, found in zip(batch["doc_id"].to_pylist(), bpe.encode_arrays(batch["text"].to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.concatenate((found, end)))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield row()
                    before, shard, held, doc_ids, ids = before + held, shard + 1, 0, [], []
        if doc_ids:
            yield row()

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(shards, _STORE_SQL), "token-ids")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(store: DataFrame) -> DataFrame:
    """Per document of the store, decoded: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The sums before each part are taken over one row a written part, which is as many rows as the writing stage had tasks.
    """
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                shard = Shard(row)
                ids, ends = shard.documents()
                wide = ids.astype("<u4")
                n = np.diff(ends, prepend=0)
                crcs = [zlib.crc32(wide[e - m : e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                starts = row["part_start"] + row["ids_before"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())], schema=_DIGEST)

    # one row a written part: its size is known, far below any broadcast limit
    return store.join(F.broadcast(parts), "part").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the store and digest what is read back from it."""
    return read_digests(write_store(docs, vocabulary))
