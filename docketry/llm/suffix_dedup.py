"""Repeated passages: every byte that lies in a LENGTH-byte string which also starts in a document of smaller doc_id goes.

All suffixes of a corpus can't be shuffled, so the suffixes that can be repeated are found first, without loss. Every
LENGTH-byte string holds one anchor, the GRAM-byte string in it with the smallest hash (the leftmost of equals), and equal
strings hold it at the same place; so a string that starts in two documents has its anchor's gram in both. Grams are
dealt by hash, and only anchors whose gram is in two documents send on the suffixes that they own.

Those are dealt by gram into suffix buckets, and a task sorts one bucket at a time. Suffixes are ordered by their first and
last 8 bytes; ties are resolved by ranks, computed before, of a difference-cover sample: positions whose residue modulo 7 is 0, 1 or
3 are ranked by the 42 bytes that follow them (by doubling), and any two positions have a common distance of less than 7 to
sample positions. So memory is bounded by the bucket, however long the passages are that tie.

Hot passages: occurrences of a gram that one task sees in several documents are known to be shared, and only those of the
smallest doc_id are dealt by gram; equal pieces in one task are settled there in the same way. A gram with more than HEAVY
occurrences even so has its suffixes dealt one by one, by their own content.

Strings are judged on the input, overlaps count, matches never cross documents. Rows without doc_id are no documents. Null texts are empty; texts shorter than
LENGTH bytes lose nothing. Rows that share a doc_id are each judged
against documents of smaller doc_id, never against one another. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import saved, slices, texts_of

LENGTH = 50
GRAM = 16
HEAVY = 1 << 17
#: Anchors that a task holds before it sends them on.
HELD = 1 << 22
#: A suffix bucket is sorted in parts of about PART rows, which hold all rows of a gram; PARTS is the most that a bucket has.
PART, PARTS = 1 << 14, 64
#: Difference cover modulo PERIOD: every distance is a difference of two of its residues.
PERIOD, COVER = 7, (0, 1, 3)
DEPTH = 42
_BLOCK = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS = [np.uint64(pow(_MULTIPLIER, 1 << k, 1 << 64)) for k in range(4)]
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each position on (rows of a matrix, or along an array)."""
    h = data.astype(np.uint64) + np.uint64(1)
    for k, power in enumerate(_POWERS):
        h = h[..., : -(1 << k)] * power + h[..., 1 << k :]
    return _mixed(h)


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    if span < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - span : width - span + n])
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, first string it owns, place of the gram in that string, number of strings) of the anchors of documents that
    follow one another in `data` and end at `ends`."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    hashes = _gram_hashes(data)
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_minimum(keys, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
    inside = np.ones(len(data), bool)
    starts = np.concatenate(([0], ends[:-1]))
    inside[np.maximum(ends[:, None] - np.arange(1, LENGTH), starts[:, None])[ends > starts]] = False
    begin = np.flatnonzero(inside[: len(owner)])
    owner = owner[begin]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (np.diff(begin) != 1)))) if len(begin) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(begin)))
    place = owner[first]
    return hashes[place], begin[first], place - begin[first], count


# --- packed columns -------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Differences of the values, byte planes apart: what repeats is together."""
    v = np.diff(values.astype(np.int64), prepend=0).astype(kind)
    return v.view(np.uint8).reshape(len(v), -1).T.tobytes()


def _unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).ravel()
    return np.cumsum(v.astype(np.int64))


#: Names of a blob's columns; docs and offsets are stored as differences, in 8 bytes of which most are zero.
_KINDS = {"doc": "<i8", "at": "<i8", "hash": "<u8", "place": "u1", "count": "u1", "known": "u1", "part": "u1", "copy": "<u4", "mask": "<u8"}


def pack(**columns: np.ndarray) -> bytes:
    n, parts = len(next(iter(columns.values()))), []
    for name, values in columns.items():
        if name == "text":
            parts.append(values.tobytes())
        elif name in ("doc", "at"):
            parts.append(_planes(values, "<i8"))
        else:
            parts.append(values.astype(_KINDS[name]).view(np.uint8).reshape(n, -1).T.tobytes() if name != "hash" else values.astype("<u8").tobytes())
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *names: str) -> dict[str, np.ndarray]:
    n, data, at, out = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, {}
    for name in names:
        if name == "text":
            out[name] = np.frombuffer(data, np.uint8, offset=at)
            break
        size = n * np.dtype(_KINDS[name]).itemsize
        part, at = data[at : at + size], at + size
        if name in ("doc", "at"):
            out[name] = _unplanes(part, n, "<i8") if n else np.empty(0, np.int64)
        elif name == "hash":
            out[name] = np.frombuffer(part, "<u8")
        else:
            out[name] = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(-1, n).T).view(_KINDS[name]).ravel() if n else np.empty(0, _KINDS[name])
    return out


def _by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        rows = order[a:b]
        yield int(bucket[rows[0]]), {k: v[rows] for k, v in columns.items()}


_ROWS = pa.schema([("b", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_ROWS_SQL = "b int, kind int, blob binary"


def _row(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], schema=_ROWS)


#: Document buckets are dealt by doc_id times a factor modulo a prime, which Spark and numpy compute alike and without overflow.
_PRIME, _FACTOR = (1 << 31) - 1, 1_103_515_245


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return doc % _PRIME * _FACTOR % _PRIME % buckets


def _grouped(hashes: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, number of the hash for each row in that order)."""
    order = np.argsort(hashes, kind="stable" if stable else None)
    h = hashes[order]
    return order, np.cumsum(np.concatenate(([False], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)


# --- finding grams that are in two documents ------------------------------------------------------------------------------


def _find_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for gram buckets (kind 0), and anchors that are known to be shared for document buckets (kind 1)."""
    held: list[tuple[np.ndarray, ...]] = []

    def scan(pieces: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in pieces])
        h, at, place, count = anchors(data, ends)
        k = np.searchsorted(ends, at, "right")
        doc, shift = np.array([d for d, _, _ in pieces]), np.array([o for _, o, _ in pieces]) - (ends - [len(p) for _, _, p in pieces])
        held.append((h, doc[k], at + shift[k], place.astype(np.uint8), count.astype(np.uint8)))

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, doc, at, place, count = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order, group = _grouped(h)
        if not len(order):
            return
        first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        shared, later = np.empty(len(h), bool), np.empty(len(h), bool)
        shared[order] = (low != high)[group]
        later[order] = doc[order] != low[group]
        columns = {"hash": h, "doc": doc, "at": at, "place": place, "count": count, "known": shared.astype(np.uint8)}
        sent = np.flatnonzero(~later)
        for b, rows in _by_bucket((h[sent] % np.uint64(buckets)).astype(np.int64), {k: v[sent] for k, v in columns.items()}):
            yield _row(b, 0, pack(**rows))
        rest = np.flatnonzero(later)
        for b, rows in _by_bucket(_doc_bucket(doc[rest], buckets), {k: columns[k][rest] for k in ("doc", "at", "place", "count")}):
            yield _row(b, 1, pack(**rows))

    waiting: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in slices(batches):
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            data = text.encode()
            for o in range(0, max(1, len(data) - LENGTH + 1), _BLOCK):  # strings of a long text are dealt to pieces by their start
                piece = data[o : o + _BLOCK + LENGTH - 1]
                waiting.append((doc, o, piece))
                size += len(piece)
                if size >= _BLOCK:
                    scan(waiting)
                    waiting, size = [], 0
                    if sum(len(rows[0]) for rows in held) >= HELD:
                        yield from flush()
    if waiting:
        scan(waiting)
    yield from flush()


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows of one bucket after the other."""
    bucket, rows = None, []
    for batch in batches:
        for b, kind, blob in zip(batch["b"].to_pylist(), batch["kind"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            if b != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = b
            rows.append((kind, blob))
    if rows:
        yield bucket, rows


class _Outbox:
    """Rows for document buckets, held back until there are many."""

    def __init__(self, buckets: int, *names: str) -> None:
        self.buckets, self.names, self.held, self.size = buckets, names, [], 0

    def put(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.size += len(columns["doc"])
        if self.size > 1 << 21:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = {k: np.concatenate([c[k] for c in self.held]) for k in self.names}
            by = np.lexsort((columns["at"], columns["doc"]))
            columns = {k: v[by] for k, v in columns.items()}
            for b, rows in _by_bucket(_doc_bucket(columns["doc"], self.buckets), columns):
                yield _row(b, 1, pack(**rows))
        self.held, self.size = [], 0


def _find_shared(batches: Iterator[pa.RecordBatch], buckets: int, heavy: int) -> Iterator[pa.RecordBatch]:
    """Anchors whose gram is in two documents, for document buckets (kind 1), and grams with very many of them (kind 2)."""
    out = _Outbox(buckets, "doc", "at", "place", "count")
    for b, rows in _buckets_of(batches):
        for kind, blob in rows:
            if kind == 1:
                yield _row(b, 1, blob)
        found = [unpack(blob, "hash", "doc", "at", "place", "count", "known") for kind, blob in rows if kind == 0]
        if not found:
            continue
        h, doc, at, place, count, known = (np.concatenate([f[k] for f in found]) for k in ("hash", "doc", "at", "place", "count", "known"))
        order, group = _grouped(h)
        if not len(order):
            continue
        first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        d = doc[order]
        shared = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.maximum.reduceat(known[order], first).astype(bool)
        many = h[order[first]][np.diff(np.append(first, len(h))) > heavy]
        if len(many):
            yield _row(b, 2, many.astype("<u8").tobytes())
        keep = order[shared[group]]
        yield from out.put(doc=doc[keep], at=at[keep], place=place[keep], count=count[keep])
    yield from out.flush()


# --- suffixes of shared anchors -----------------------------------------------------------------------------------------


def _buffer(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[int]]:
    """(bytes, doc_ids in ascending order, start of each, their texts, and each row's place among these): a doc_id is there once
    for each of its different texts, in their order."""
    rows = list(zip(docs["doc_id"].to_pylist(), (t.encode() for t in docs["text"].to_pylist()), strict=True))
    distinct = sorted(set(rows))
    place = {key: k for k, key in enumerate(distinct)}
    texts = [t for _, t in distinct]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.array([d for d, _ in distinct], np.int64), starts, texts, [place[key] for key in rows]


def _cut_out(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes [at, at + size) of each row, one row after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _send_suffixes(docs: pa.Table, shared: pa.Table, buckets: int, heavy: np.ndarray) -> pa.Table:
    """Strings of shared anchors for suffix buckets (kind 0), and strings already seen to be repeated for document buckets (kind 1)."""
    out: list[pa.RecordBatch] = []
    data, ids, starts, _, _ = _buffer(docs)
    found = [unpack(blob, "doc", "at", "place", "count") for blob in shared["blob"].to_pylist()]
    if found and len(ids):
        doc, at, place, count = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in ("doc", "at", "place", "count"))
        low, high = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
        texts = high - low  # an anchor is tried in each text of its doc_id
        copy = np.arange(int(texts.sum())) - np.repeat(np.cumsum(texts) - texts, texts)
        doc, at, place, count, low = (np.repeat(v, texts) for v in (doc, at, place, count, low))
        k = low + copy
        fits = starts[k] + at + count + LENGTH - 1 <= starts[k + 1]
        doc, at, place, count, copy, k = (v[fits] for v in (doc, at, place, count, copy, k))
        here = starts[k] + at
        if len(here):
            by = np.lexsort((at, doc))
            doc, at, place, count, copy, here = (v[by] for v in (doc, at, place, count, copy, here))
            padded = np.concatenate((data, np.zeros(2 * LENGTH, np.uint8)))
            hashes = np.concatenate([_gram_hashes(padded[(here + place)[a : a + _BLOCK // 16, None] + np.arange(GRAM)])[:, 0] for a in range(0, len(here), _BLOCK // 16)])
            if len(heavy) and (hot := np.isin(hashes, heavy)).any():
                each = np.repeat(np.flatnonzero(hot), count[hot])
                step = np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                one = np.ones(len(each), np.int64)
                whole = _row_hashes(padded, here[each] + step, one)
                doc, at, copy, here, count, hashes = (np.concatenate((v[~hot], w)) for v, w in ((doc, doc[each]), (at, at[each] + step), (copy, copy[each]), (here, here[each] + step), (count, one), (hashes, whole)))
            keep, done = _settle(padded, here, count, doc)
            for b, rows in _by_bucket(_doc_bucket(doc[done], buckets), {"doc": doc[done], "at": at[done], "copy": copy[done], "mask": (np.uint64(1) << count[done].astype(np.uint64)) - np.uint64(1)}):
                out.append(_row(b, 1, pack(**rows)))
            for b, rows in _by_bucket((hashes[keep] % np.uint64(buckets)).astype(np.int64), {"doc": doc[keep], "at": at[keep], "count": count[keep], "copy": copy[keep], "here": here[keep], "part": (hashes[keep] // np.uint64(buckets) % np.uint64(PARTS)).astype(np.uint8)}):
                text = _cut_out(data, rows["here"], rows["count"] + LENGTH - 1)
                out.append(_row(b, 0, pack(doc=rows["doc"], at=rows["at"], count=rows["count"], copy=rows["copy"], part=rows["part"], text=text)))
    return pa.Table.from_batches(out, _ROWS)


def _row_hashes(data: np.ndarray, here: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the bytes that each row's strings cover."""
    weights = np.full(2 * LENGTH, _MULTIPLIER, np.uint64).cumprod()
    out = np.empty(len(here), np.uint64)
    for a in range(0, len(here), 1 << 16):
        size = count[a : a + (1 << 16), None] + LENGTH - 1
        rows = data[here[a : a + (1 << 16), None] + np.arange(2 * LENGTH - GRAM)]
        rows = np.where(np.arange(2 * LENGTH - GRAM) < size, rows.astype(np.uint64) + np.uint64(1), np.uint64(0))
        out[a : a + (1 << 16)] = _mixed(rows @ weights[: 2 * LENGTH - GRAM] + size[:, 0].astype(np.uint64))
    return out


def _settle(data: np.ndarray, here: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows to be sorted elsewhere, rows that equal one of a smaller doc_id here); rows of equal bytes are compared, not only their hashes."""
    order, group = _grouped(_row_hashes(data, here, count), stable=True)
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    lead = order[first][group]  # the first row of the same hash: of the smallest doc_id, as rows come in that order
    low = np.minimum.reduceat(doc[order], first)[group]
    later = np.flatnonzero((doc[order] > low) & (count[order] == count[lead]) & (doc[lead] == low))
    same = np.zeros(len(order), bool)
    for a in range(0, len(later), 1 << 16):
        rows = later[a : a + (1 << 16)]
        size = count[order[rows], None] + LENGTH - 1
        span = np.arange(2 * LENGTH - GRAM)
        equal = (data[here[order[rows], None] + span] == data[here[lead[rows], None] + span]) | (span >= size)
        same[rows] = equal.all(axis=1)
    return np.sort(order[~same]), np.sort(order[same])


# --- one suffix bucket at a time -------------------------------------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1])))
    return out


def _cover_ranks(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the sample positions that suffixes starting at `starts` reach, by their next DEPTH bytes, by doubling, and the number of
    each period's first rank among them; `words` are the 8 bytes from each position on."""
    n, step = len(words) // PERIOD, len(COVER)
    reached = np.bincount(starts // PERIOD, minlength=n + 1)[: n + 1] - np.bincount(np.minimum((starts + PERIOD + DEPTH) // PERIOD + 1, n), minlength=n + 1)[: n + 1]
    periods = np.flatnonzero(np.cumsum(reached)[:n] > 0)
    number = np.zeros(n, np.int64)
    number[periods] = step * np.arange(len(periods))
    r7 = _dense(words[(periods[:, None] * PERIOD + np.array(COVER)).ravel()] >> np.uint64(8))

    def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        after = np.zeros(len(left), np.int64)
        after[: max(0, len(left) - shift)] = right[shift:]
        return _dense((left << 32) | after)

    r14 = joined(r7, r7, step)
    r28 = joined(r14, r14, 2 * step)
    return joined(r28, r14, 4 * step), number


def first_documents(text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte suffix start, the smallest document among the suffixes with the same LENGTH bytes."""
    padded = np.concatenate((text, np.zeros(2 * LENGTH + PERIOD, np.uint8)))
    words = padded.astype(np.uint64)
    for k in (1, 2, 4):
        words = (words[:-k] << np.uint64(8 * k)) | words[k:]
    out = docs.copy()
    head, tail = words[starts], words[starts + LENGTH - 8]
    order = np.lexsort((tail, head))
    h, t = head[order], tail[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    tied = order[size[group] > 1]
    tie = group[size[group] > 1]
    if not len(tied):
        return out
    position = starts[tied]
    ranks, number = _cover_ranks(words, position)
    place = np.zeros(PERIOD, np.int64)
    place[list(COVER)] = range(len(COVER))
    for distance in range(PERIOD):  # any two tied suffixes meet at one distance at least
        at = position + distance
        rows = np.flatnonzero(np.isin(at % PERIOD, COVER))
        if not len(rows):
            continue
        by, same = _grouped(((tie[rows] << 32) | ranks[number[at[rows] // PERIOD] + place[at[rows] % PERIOD]]).view(np.uint64))
        edge = np.flatnonzero(np.concatenate(([True], np.diff(same) != 0)))
        who = tied[rows[by]]
        out[who] = np.minimum(out[who], np.minimum.reduceat(docs[who], edge)[same])
    return out


def _parts(part: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of one or more whole parts, about PART at a time."""
    order = np.argsort(part, kind="stable")
    n = np.bincount(part, minlength=PARTS)
    first = done = 0
    for k in range(PARTS):
        done += int(n[k])
        if done - first >= PART or (k == PARTS - 1 and done > first):
            yield order[first:done]
            first = done


def _sort_buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Which strings of each row also start in a smaller document (a bit each), for document buckets."""
    out = _Outbox(buckets, "doc", "at", "copy", "mask")
    for b, rows in _buckets_of(batches):
        for kind, blob in rows:
            if kind == 1:
                yield _row(b, 1, blob)
        found = [unpack(blob, "doc", "at", "count", "copy", "part", "text") for kind, blob in rows if kind == 0]
        if not found:
            continue
        doc, at, count, copy, part, text = (np.concatenate([f[k] for f in found]) for k in ("doc", "at", "count", "copy", "part", "text"))
        found = rows = None
        size = count.astype(np.int64) + LENGTH - 1
        start = np.cumsum(size) - size
        for own in _parts(part):
            n = count[own].astype(np.int64)
            here = np.cumsum(size[own]) - size[own]
            row = np.repeat(np.arange(len(own)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            who = doc[own]
            repeated = first_documents(_cut_out(text, start[own], size[own]), here[row] + step, who[row]) < who[row]
            mask = np.zeros(len(own), np.uint64)
            np.bitwise_or.at(mask, row[repeated], np.uint64(1) << step[repeated].astype(np.uint64))
            keep = mask != 0
            yield from out.put(doc=who[keep], at=at[own][keep], copy=copy[own][keep], mask=mask[keep])
    yield from out.flush()


# --- taking the bytes out ----------------------------------------------------------------------------------------------------


def _removed(docs: pa.Table, strings: pa.Table) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """(whether each byte of each text goes, the texts, and each row's place among them)."""
    data, ids, starts, texts, place = _buffer(docs)
    edge = np.zeros(len(data) + 1, np.int64)
    for blob in strings["blob"].to_pylist():
        f = unpack(blob, "doc", "at", "copy", "mask")
        k = np.searchsorted(ids, f["doc"]) + f["copy"]
        here = starts[k] + f["at"]
        for bit in range(LENGTH - GRAM + 1):
            begin = here[(f["mask"] >> np.uint64(bit)) & np.uint64(1) == 1] + bit
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [gone[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], texts, place


def _digest(docs: pa.Table, strings: pa.Table) -> pa.Table:
    gone, texts, place = _removed(docs, strings)
    by = []
    for g, data in zip(gone, texts, strict=True):
        spans = int((g[1:] & ~g[:-1]).sum() + g[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~g].tobytes() if spans else data
        by.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*(by[k] for k in place), strict=True)) if place else [[]] * 4
    return pa.table({"doc_id": pa.array(docs["doc_id"].to_pylist(), pa.int64()), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})


def _kept_texts(docs: pa.Table, strings: pa.Table) -> pa.Table:
    gone, texts, place = _removed(docs, strings)
    kept = [np.frombuffer(t, np.uint8)[~g].tobytes().decode(errors="ignore") for g, t in zip(gone, texts, strict=True)]
    rest = [c for c in docs.column_names if c not in ("b", "text")]
    return pa.Table.from_arrays([*(docs[c] for c in rest), pa.array([kept[k] for k in place], pa.string())], [*rest, "text"])


def _applied(docs: DataFrame, take_out: Callable, schema: str, heavy: int, buckets: int | None) -> DataFrame:
    """docs has doc_id, text and what take_out hands on; each document bucket is small, as there are more of them the more
    splits the input has."""
    buckets = buckets or max(64, 4 * docs.rdd.getNumPartitions())
    grams = texts_of(docs).mapInArrow(partial(_find_anchors, buckets=buckets), _ROWS_SQL)
    shared = saved(grams.repartition("b").sortWithinPartitions("b").mapInArrow(partial(_find_shared, buckets=buckets, heavy=heavy), _ROWS_SQL))
    # a gram is here only with over `heavy` occurrences of its own: at most one for as many anchors
    hot = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["blob"], "<u8") for r in shared.where("kind = 2").collect())])
    dealt = docs.withColumn("b", F.pmod(F.pmod(F.pmod("doc_id", F.lit(_PRIME)) * F.lit(_FACTOR).cast("long"), F.lit(_PRIME)), F.lit(buckets)).cast("int"))
    strings = dealt.groupBy("b").cogroup(shared.where("kind = 1").groupBy("b")).applyInArrow(lambda d, s: _send_suffixes(d, s, buckets, hot), _ROWS_SQL)
    strings = strings.repartition("b").sortWithinPartitions("b").mapInArrow(partial(_sort_buckets, buckets=buckets), _ROWS_SQL)
    return dealt.groupBy("b").cogroup(strings.groupBy("b")).applyInArrow(take_out, schema)


def digests(docs: DataFrame, heavy: int = HEAVY, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _applied(texts_of(docs), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", heavy, buckets)


def without_repeats(docs: DataFrame, heavy: int = HEAVY, buckets: int | None = None) -> DataFrame:
    """Every row with a doc_id, with the repeated bytes of its text taken out and n_chars, if there is one, counted anew; bytes of letters that
    were cut in two go with them."""
    names = [c for c in docs.columns if c not in ("doc_id", "text", "b")]
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*names, *([F.col("b")] if "b" in docs.columns else [])).alias("rest") if names or "b" in docs.columns else F.lit(None).cast("struct<x:int>").alias("rest"))
    kept = _applied(rows, _kept_texts, f"doc_id long, rest {rows.schema['rest'].dataType.simpleString()}, text string", heavy, buckets)
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*((back[c] if back.get(c) is not None else F.col("rest")[c]).alias(c) for c in docs.columns))
